"""Audio columns: lossless 8-bit WAV storage, polyphase resampling, log-mel frames and
hysteresis segmentation, stored as fixed-shape Arrow tensors with time spans."""

from __future__ import annotations

import hashlib
import struct
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_texts, col, materialize

RATE = 16_000
UP, DOWN = 2, 5
FRAME, HOP, MELS = 256, 128, 16
UNIT = 576
PAD = 255
#: Frames of one tensor, and frames that are computed at once.
TENSOR_FRAMES = 64
BLOCK_FRAMES = 4096


def payload_of(text: bytes) -> bytes:
    """The text's bytes, filled up with 255 to a positive multiple of 576."""
    size = max(1, -(-len(text) // UNIT)) * UNIT
    return text + bytes([PAD]) * (size - len(text))


def to_wav(payload: bytes, rate: int = RATE) -> bytes:
    """Canonical RIFF/WAVE file: PCM, one channel, unsigned 8-bit samples."""
    odd = len(payload) % 2
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload) + odd, b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(payload))
    return head + payload + b"\0" * odd


def from_wav(media: bytes) -> tuple[bytes, int]:
    """(samples, rate) read from a WAV file by walking its chunks."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, rate = 12, 0
    while at + 8 <= len(media):
        name, size = media[at : at + 4], int.from_bytes(media[at + 4 : at + 8], "little")
        if name == b"fmt ":
            kind, channels, rate, _, _, bits = struct.unpack("<HHIIHH", media[at + 8 : at + 24])
            if (kind, channels, bits) != (1, 1, 8):
                raise ValueError("only 8-bit mono PCM")
        elif name == b"data":
            return media[at + 8 : at + 8 + size], rate
        at += 8 + size + size % 2
    raise ValueError("no samples")


@cache
def _phases() -> tuple[np.ndarray, int]:
    """Windowed-sinc low-pass, split into UP phases of equal length (taps reversed)."""
    half = 8 * DOWN
    t = np.arange(-half, half + 1)
    taps = np.sinc(t / DOWN) / DOWN * np.hamming(len(t)) * UP
    taps = np.r_[taps, np.zeros(-len(taps) % UP)]
    return np.ascontiguousarray(taps.reshape(-1, UP).T[:, ::-1]).astype(np.float32), half


def resample(x: np.ndarray) -> np.ndarray:
    """Polyphase resampling by UP / DOWN; length ceil(len * UP / DOWN)."""
    phases, half = _phases()
    width = phases.shape[1]
    n = -(-len(x) * UP // DOWN)
    y = np.empty(n, np.float32)
    padded = np.concatenate([np.zeros(width, np.float32), x, np.zeros(width + half, np.float32)])
    windows = np.lib.stride_tricks.sliding_window_view(padded, width)
    for r in range(UP):
        out = y[r::UP]
        first = r * DOWN + half  # place on the upsampled grid of this phase's first output
        phase, k = first % UP, first // UP
        for at in range(0, len(out), 1 << 16):
            m = min(1 << 16, len(out) - at)
            lo = k + 1 + at * DOWN
            out[at : at + m] = np.ascontiguousarray(windows[lo : lo + (m - 1) * DOWN + 1 : DOWN]) @ phases[phase]
    return y


@cache
def _mel() -> tuple[np.ndarray, np.ndarray]:
    rate = RATE * UP / DOWN
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(0, mel(rate / 2), MELS + 2) / 2595) - 1)
    f = np.fft.rfftfreq(FRAME, 1 / rate)[:, None]
    up, down = (f - edges[:-2]) / (edges[1:-1] - edges[:-2]), (edges[2:] - f) / (edges[2:] - edges[1:-1])
    return np.maximum(0, np.minimum(up, down)).astype(np.float32), np.hanning(FRAME).astype(np.float32)


def log_mel(y: np.ndarray) -> np.ndarray:
    """Overlapped log-mel frames (frames, MELS), the tail filled with silence; one frame at least."""
    bank, window = _mel()
    n = max(1, -(-max(0, len(y) - FRAME) // HOP) + 1)
    y = np.concatenate([y, np.zeros(max(0, (n - 1) * HOP + FRAME - len(y)), np.float32)])
    frames = np.lib.stride_tricks.sliding_window_view(y, FRAME)[::HOP][:n]
    out = np.empty((n, MELS), np.float32)
    for at in range(0, n, BLOCK_FRAMES):
        spec = np.abs(np.fft.rfft(frames[at : at + BLOCK_FRAMES] * window, axis=1)).astype(np.float32)
        out[at : at + BLOCK_FRAMES] = np.log((spec * spec) @ bank + np.float32(1e-6))
    return out


def segments(mel: np.ndarray, margin: float = 0.5) -> np.ndarray:
    """(first, end) frames of loud stretches: on above median + margin, off below median - margin."""
    level = mel.mean(axis=1)
    mid = np.median(level)
    mark = np.where(level > mid + margin, 1, np.where(level < mid - margin, -1, 0))
    last = np.maximum.accumulate(np.where(mark != 0, np.arange(len(mark)), -1))
    on = np.where(last >= 0, mark[last], -1) == 1
    edge = np.flatnonzero(np.diff(np.r_[False, on, False]))
    return edge.reshape(-1, 2)


_TENSOR = pa.fixed_shape_tensor(pa.float32(), [TENSOR_FRAMES, MELS])
_SPAN = pa.struct([("start_s", pa.float64()), ("end_s", pa.float64())])
_CHUNKS = pa.schema(
    [("chunk", pa.int64()), ("start_s", pa.float64()), ("end_s", pa.float64()), ("frames", pa.int64()), ("active_frames", pa.int64()), ("segments", pa.list_(_SPAN)), ("log_mel", _TENSOR)]
)


def chunks(media: bytes) -> pa.RecordBatch:
    """Log-mel tensors of a stored file, TENSOR_FRAMES frames each, with their time spans.

    The last tensor is filled up with the floor of log power; frames counts those before. A
    loud stretch stands with the tensor in which it begins, as its whole time span.
    """
    payload, rate = from_wav(media)
    mel = log_mel(resample((np.frombuffer(payload, np.uint8).astype(np.float32) - 128) / 128))
    loud = segments(mel)
    second = rate * UP / DOWN
    begin = lambda f: f * HOP / second
    end = lambda f: ((f - 1) * HOP + FRAME) / second
    k = -(-len(mel) // TENSOR_FRAMES)
    full = np.full((k * TENSOR_FRAMES, MELS), np.float32(np.log(1e-6)), np.float32)
    full[: len(mel)] = mel
    first = np.arange(k) * TENSOR_FRAMES
    last = np.minimum(first + TENSOR_FRAMES, len(mel))
    on = np.zeros(len(mel) + 1, np.int64)
    on[loud[:, 0]] += 1
    on[loud[:, 1]] -= 1
    active = np.add.reduceat(np.cumsum(on[:-1]), first)
    spans = pa.StructArray.from_arrays([pa.array(begin(loud[:, 0])), pa.array(end(loud[:, 1]))], fields=list(_SPAN))
    held = pa.ListArray.from_arrays(np.searchsorted(loud[:, 0], np.r_[first, len(mel)]).astype(np.int32), spans)
    tensor = pa.ExtensionArray.from_storage(_TENSOR, pa.FixedSizeListArray.from_arrays(pa.array(full.ravel()), TENSOR_FRAMES * MELS))
    cols = [pa.array(np.arange(k)), pa.array(begin(first)), pa.array(end(last)), pa.array(last - first), pa.array(active), held, tensor]
    return pa.RecordBatch.from_arrays(cols, schema=_CHUNKS.with_metadata({"rate": str(rate)}))


def pack(batch: pa.RecordBatch) -> bytes:
    """The batch as an Arrow stream, extension type included."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpack(data: bytes) -> pa.RecordBatch:
    with pa.ipc.open_stream(data) as stream:
        return stream.read_next_batch()


def feature(batch: pa.RecordBatch) -> str:
    """Rate, frames, loud stretches and mean log-mel bands of a file's tensors, as text."""
    rate = batch.schema.metadata[b"rate"].decode()
    frames = batch.column("frames").to_numpy()
    mel = batch.column("log_mel").storage.flatten().to_numpy().reshape(-1, MELS)[: frames.sum()]
    means = ",".join(f"{v + 0.0:.2f}" for v in np.round(mel.mean(axis=0, dtype=np.float64), 2))
    active = int(batch.column("active_frames").to_numpy().sum())
    return f"rate={rate};frames={len(mel)};segments={len(batch.column('segments').flatten())};active={active};mel={means}"


def describe(media: bytes) -> dict:
    """What the stored form holds, read back from the file's bytes, and its tensors."""
    payload, _ = from_wav(media)
    return {
        "payload_bytes": len(payload),
        "payload_sha256": hashlib.sha256(payload).hexdigest(),
        "tail_crc32": zlib.crc32(payload[-32:]),
        "media_bytes": len(media),
        "media_sha256": hashlib.sha256(media).hexdigest(),
        "tensors": pack(chunks(media)),
    }


_DESCRIBED = pa.struct([("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("tensors", pa.binary())])


def _store(texts: pa.Array) -> pa.Array:
    return pa.array((to_wav(payload_of(t)) for t in byte_texts(texts)), pa.binary())


def _describe(media: pa.Array) -> pa.Array:
    return pa.array((describe(m) for m in media.to_pylist()), _DESCRIBED)


def stored(text_col: str = "text"):
    """Column: the text's bytes as a WAV file; null texts count as empty."""
    return F.arrow_udf(_store, "binary")(col(text_col).cast("string"))


def described(media):
    """Column: struct of sizes, digests and packed tensors of a non-null WAV column."""
    kind = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, tensors binary"
    return F.arrow_udf(_describe, kind)(media)


def features(tensors):
    """Column: feature text of a non-null column of packed tensors."""
    return F.arrow_udf(lambda x: pa.array((feature(unpack(t)) for t in x.to_pylist()), pa.string()), "string")(tensors)


def media_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes and media (a WAV file) of every row of docs, as a stored table.

    Null texts count as empty; ids keep their type, repeated rows repeat, other columns are left out.
    Empty input gives an empty table.
    """
    size = F.octet_length(F.coalesce(col(text_col).cast("string"), F.lit(""))).cast("long")
    return materialize(docs.select(col(id_col).alias("id"), size.alias("n_bytes"), stored(text_col).alias("media")), "audio-media", "zstd")


def analysed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: id, n_bytes, sizes and digests of the stored form, tensors, feature.

    The WAV files are stored as Parquet (media_table()) and read back for sizes, digests and tensors.
    tensors is an Arrow stream (unpack() reads it) of fixed_shape_tensor rows with their time
    spans; they are stored as well and the feature comes from what is read back. Null texts
    count as empty, and every row has one tensor at least; ids keep their type, repeated rows
    repeat, other columns are left out. Empty input gives an empty result.
    """
    rows = media_table(docs, id_col, text_col).select("id", "n_bytes", described(F.col("media")).alias("d"))
    rows = materialize(rows.select("id", "n_bytes", "d.*"), "audio-tensors", "zstd")
    return rows.withColumn("feature", features("tensors")).withColumnRenamed("id", id_col)


def tensors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The tensors of analysed() as rows: id, chunk, start_s, end_s, frames, active_frames,
    segments and log_mel, TENSOR_FRAMES x MELS floats, row-major.

    as_tensors() turns a collected column into Arrow's fixed_shape_tensor type. Null texts count as empty,
    repeated rows repeat, empty input gives an empty result.
    """

    def run(batches):
        for batch in batches:
            for k, data in enumerate(batch.column("tensors").to_pylist()):
                got = unpack(data)
                flat = got.column("log_mel").storage.flatten()
                mel = pa.ListArray.from_arrays(np.arange(got.num_rows + 1, dtype=np.int32) * TENSOR_FRAMES * MELS, flat)
                ident = batch.column("id").take(pa.array([k] * got.num_rows, pa.int64()))
                yield pa.RecordBatch.from_arrays([ident, *got.columns[:-1], mel], ["id", *_CHUNKS.names])

    rows = media_table(docs, id_col, text_col).select("id", described(F.col("media")).alias("d")).select("id", "d.tensors")
    kind = dict(rows.dtypes)["id"]
    spans = "array<struct<start_s:double,end_s:double>>"
    return rows.mapInArrow(run, f"id {kind}, chunk long, start_s double, end_s double, frames long, active_frames long, segments {spans}, log_mel array<float>")


def as_tensors(column: pa.ChunkedArray) -> pa.Array:
    """A collected log_mel column as an Arrow fixed_shape_tensor array."""
    flat = column.combine_chunks().flatten().cast(pa.float32())
    return pa.ExtensionArray.from_storage(_TENSOR, pa.FixedSizeListArray.from_arrays(flat, TENSOR_FRAMES * MELS))
