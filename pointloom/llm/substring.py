"""Substring deduplication with difference-cover anchors.

A perfect difference set D modulo 21 has, for any two places p and q, an offset below 21
with which both p + offset and q + offset fall on D. Equal windows of 35 words therefore
share an equal anchor of 35 - 21 + 1 = 15 words that starts at a cover position in both.
Only anchors (5 of 21 positions) are hashed first; windows around anchors that occur again
are then hashed whole (128 bits) and kept if they occur again.

Documents are dealt into groups; a group sends each of its distinct hashes once to the
bucket of its range, packed in binary rows, and gets a bit back for each. So a passage that
a third of all documents share is one hash per group, not one per document. Text is
shuffled once: Spark reuses that exchange in all three passes over a group.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_texts, col, mix64, shuffle_parts, starts_of

WINDOW = 35
# A perfect difference set of order 4.
PERIOD, COVER = 21, (0, 1, 4, 14, 16)
ANCHOR = WINDOW - PERIOD + 1
#: Bytes of text that one group of documents holds at most about, and of text whose anchors (or
#: windows, of which there can be as many as words) meet in one bucket.
GROUP_BYTES, BUCKET_BYTES = 48 << 20, (384 << 20, 96 << 20)

_R = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95))
_INV = tuple(np.uint64(pow(int(r), -1, 1 << 64)) for r in _R)


class _Powers:
    """Powers of the two multipliers and of their inverses modulo 2 ** 64, grown as needed."""

    size = 0
    tables: list[tuple[np.ndarray, np.ndarray]] = []

    @classmethod
    def get(cls, which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > cls.size:
            cls.size = max(n, 2 * cls.size, 1 << 14)
            with np.errstate(over="ignore"):
                cls.tables = [tuple(np.cumprod(np.r_[np.uint64(1), np.full(cls.size - 1, x)]) for x in pair) for pair in zip(_R, _INV)]
        up, down = cls.tables[which]
        return up[:n], down[:n]


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def window_hashes(w: np.ndarray, width: int, which: int = 0) -> np.ndarray:
    """Hash of the words [p, p + width) for every p."""
    n = len(w) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = _Powers.get(which, len(w))
    with np.errstate(over="ignore"):
        s = np.zeros(len(w) + 1, np.uint64)
        np.cumsum((mix64(w ^ np.uint64(0xA5A5A5A5)) if which else w) * up, out=s[1:])
        return mix64((s[width:] - s[:-width]) * down[:n])


def _cover(n: int) -> np.ndarray:
    """Cover positions of anchors in a document of n words."""
    at = np.arange(-(-n // PERIOD) * PERIOD).reshape(-1, PERIOD)[:, COVER].ravel()
    return at[at <= n - ANCHOR]


class _Group:
    """A group's documents as word hashes, with their anchors."""

    def __init__(self, texts: list[bytes]):
        self.words = []
        hashes, self.places = [], []
        for text in texts:
            w = word_hashes(text.split())
            self.words.append(w)
            at = _cover(len(w)) if len(w) >= WINDOW else np.zeros(0, np.int64)
            self.places.append(at)
            hashes.append(window_hashes(w, ANCHOR)[at] if len(at) else np.zeros(0, np.uint64))
        self.starts = starts_of(np.array([len(h) for h in hashes], np.int64))
        self.distinct, self.inverse, counts = np.unique(np.concatenate([np.zeros(0, np.uint64), *hashes]), return_inverse=True, return_counts=True)
        self.local = counts > 1

    def candidates(self, again: np.ndarray):
        """Per document: starts of windows that hold an anchor which occurs again."""
        flag = again[self.inverse] if len(self.inverse) else np.zeros(0, bool)
        for k, (w, at) in enumerate(zip(self.words, self.places)):
            own = at[flag[self.starts[k] : self.starts[k + 1]]]
            if not len(own):
                yield np.zeros(0, np.int64)
                continue
            seen = np.zeros(len(w) + 1, np.int32)
            seen[own + 1] = 1
            seen = np.cumsum(seen)
            n = len(w) - WINDOW + 1
            yield np.flatnonzero(seen[PERIOD : PERIOD + n] > seen[:n])

    def windows(self, again: np.ndarray):
        """The candidate windows' distinct 128-bit hashes, which occur twice here, and who has which."""
        self.cand = list(self.candidates(again))
        one, two = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
        for w, p in zip(self.words, self.cand):
            if len(p):
                one.append(window_hashes(w, WINDOW)[p])
                two.append(window_hashes(w, WINDOW, 1)[p])
        return distinct_pairs(np.concatenate(one), np.concatenate(two))


def distinct_pairs(one: np.ndarray, two: np.ndarray):
    """Sorted distinct pairs, which of them occur more than once, and the inverse."""
    order = np.lexsort((two, one))
    a, b = one[order], two[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    rank = np.cumsum(new) - 1
    inverse = np.empty(len(a), np.int64)
    inverse[order] = rank
    count = np.bincount(rank, minlength=int(new.sum())) if len(a) else np.zeros(0, np.int64)
    return a[new], b[new], count > 1, inverse


def _bounds(one: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket's range begins and ends in sorted hashes."""
    edges = [(b << 64) // buckets for b in range(1, buckets)]
    return np.r_[0, np.searchsorted(one, np.array(edges, np.uint64)), len(one)].astype(np.int64)


_SENT = "bucket long, pid long, one binary, two binary, local binary"
_REPLY = "pid long, stage long, bucket long, n long, bits binary"


def _send(pid: int, one: np.ndarray, two: np.ndarray | None, local: np.ndarray, buckets: int) -> pa.Table:
    at = _bounds(one, buckets)
    rows = np.flatnonzero(at[1:] > at[:-1]).tolist()
    cut = [slice(at[b], at[b + 1]) for b in rows]
    return pa.table(
        {
            "bucket": pa.array(rows, pa.int64()),
            "pid": pa.array([pid] * len(rows), pa.int64()),
            "one": pa.array([one[c].tobytes() for c in cut], pa.binary()),
            "two": pa.array([None if two is None else two[c].tobytes() for c in cut], pa.binary()),
            "local": pa.array([np.packbits(local[c]).tobytes() for c in cut], pa.binary()),
        }
    )


def _reply(stage: int):
    def run(part: pa.Table) -> pa.Table:
        """Which of a bucket's hashes occur in two groups, or twice in one of them."""
        ones = [np.frombuffer(x, np.uint64) for x in part.column("one").to_pylist()]
        sizes = [len(x) for x in ones]
        one = np.concatenate(ones)
        two = np.concatenate([np.frombuffer(x, np.uint64) for x in part.column("two").to_pylist()]) if stage else np.zeros(len(one), np.uint64)
        local = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=n) for x, n in zip(part.column("local").to_pylist(), sizes)]).astype(bool)
        _, _, again, inverse = distinct_pairs(one, two)
        again[inverse[local]] = True
        mine = np.split(again[inverse], np.cumsum(sizes)[:-1])
        k = len(sizes)
        return pa.table(
            {
                "pid": part.column("pid"),
                "stage": pa.array([stage] * k, pa.int64()),
                "bucket": part.column("bucket"),
                "n": pa.array(sizes, pa.int64()),
                "bits": pa.array([np.packbits(x).tobytes() for x in mine], pa.binary()),
            }
        )

    return run


def _bits(replies: pa.Table, stage: int) -> np.ndarray:
    rows = [r for r in replies.to_pylist() if r["stage"] == stage]
    rows.sort(key=lambda r: r["bucket"])
    return np.concatenate([np.zeros(0, bool), *(np.unpackbits(np.frombuffer(r["bits"], np.uint8), count=r["n"]).astype(bool) for r in rows)])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per input row: id, n_words, n_removed and kept (the words left, joined by one space).

    A word goes if a window of 35 words that covers it has a word sequence that also starts
    anywhere else, in the same or another row; windows are those of the input. Null texts have
    no words; rows with fewer than 35 words stay whole; repeated rows remove each other. Null
    ids are kept. Other columns are ignored. Empty input gives an empty result.
    """
    rows = docs.select(col(id_col).alias("id"), col(text_col).cast("string").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    least = shuffle_parts(docs.sparkSession)
    parts = max(least, size // GROUP_BYTES)
    buckets = [max(least, size // b) for b in BUCKET_BYTES]
    # with the input partition, so that repeated rows spread
    rows = rows.withColumn("pid", F.pmod(F.xxhash64("id", "text", F.spark_partition_id()), F.lit(parts)))

    def anchors(part: pa.Table) -> pa.Table:
        g = _Group(byte_texts(part.column("text").combine_chunks()))
        return _send(part.column("pid")[0].as_py(), g.distinct, None, g.local, buckets[0])

    def windows(part: pa.Table, replies: pa.Table) -> pa.Table:
        if not part.num_rows:
            return _send(0, np.zeros(0, np.uint64), None, np.zeros(0, bool), buckets[1])
        g = _Group(byte_texts(part.column("text").combine_chunks()))
        one, two, local, _ = g.windows(_bits(replies, 0))
        return _send(part.column("pid")[0].as_py(), one, two, local, buckets[1])

    def cut(part: pa.Table, replies: pa.Table) -> pa.Table:
        texts = byte_texts(part.column("text").combine_chunks()) if part.num_rows else []
        g = _Group(texts)
        n_words, n_removed, kept = [], [], []
        if texts:
            _, _, _, inverse = g.windows(_bits(replies, 0))
            again = _bits(replies, 1)[inverse]
            at = 0
            for text, w, p in zip(texts, g.words, g.cand):
                hit = p[again[at : at + len(p)]]
                at += len(p)
                words = text.split()
                if len(hit):
                    edge = np.zeros(len(w) + 1, np.int32)
                    edge[hit] += 1
                    edge[hit + WINDOW] -= 1
                    gone = np.cumsum(edge[:-1]) > 0
                    words = [x for x, out in zip(words, gone.tolist()) if not out]
                n_words.append(len(w))
                n_removed.append(len(w) - len(words))
                kept.append(b" ".join(words))
        return pa.table({"id": part.column("id"), "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept": pa.array(kept, pa.binary()).cast(pa.string())})

    kind = dict(rows.dtypes)["id"]
    grouped = lambda: rows.groupBy("pid")
    found = grouped().applyInArrow(anchors, _SENT).groupBy("bucket").applyInArrow(_reply(0), _REPLY)
    sure = grouped().cogroup(found.groupBy("pid")).applyInArrow(windows, _SENT).groupBy("bucket").applyInArrow(_reply(1), _REPLY)
    out = grouped().cogroup(found.unionByName(sure).groupBy("pid")).applyInArrow(cut, f"id {kind}, n_words long, n_removed long, kept string")
    return out.withColumnRenamed("id", id_col)
