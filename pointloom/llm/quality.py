"""Document quality: logistic regression over hashed word n-grams, trained with FTRL."""

from __future__ import annotations

from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_texts, col, discard, fold_mod, materialize, mix64

BITS = 18
#: Rows that a fit may use at most about (documented bound; more labelled texts are thinned by hash).
MAX_LABELS = 4000
#: Features of these rows at most about, 8 bytes each on the driver: a bound of the same sample,
#: which is thinned by hash, whatever a text's length.
MAX_FEATURES = 25_000_000
BLOCK_WORDS = 1 << 18

#: Letters to their case class, digits to 0, bytes above ASCII count as lower-case letters.
_SHAPES = bytes(
    0x61 if 0x61 <= b <= 0x7A or b >= 0x80 else 0x41 if 0x41 <= b <= 0x5A else 0x30 if 0x30 <= b <= 0x39 else b for b in range(256)
)
#: A text's mean weight is multiplied by this, so that usual learning rates fit.
SCALE = 8.0


def _hash(words: list[bytes], seed: int) -> np.ndarray:
    crc = np.fromiter(map(crc32, words), np.uint64, len(words))
    return mix64(crc + np.uint64(seed << 32))


def _shapes(text: bytes) -> list[bytes]:
    """The words' shapes: letter case, digits and punctuation, runs shortened to one character."""
    raw = np.frombuffer(text.translate(_SHAPES), np.uint8)
    new = np.ones(len(raw), bool)
    np.not_equal(raw[1:], raw[:-1], out=new[1:])
    return raw[new].tobytes().split()


def ngrams(text: bytes) -> list[np.ndarray]:
    """Hashed word uni- and bigrams, repeats included: of the lower-cased words and of their shapes."""
    words, shapes = text.lower().split(), _shapes(text)
    out = []
    for at in range(0, len(words), BLOCK_WORDS):
        cut = slice(at, at + BLOCK_WORDS + 1)
        for seed, part in ((1, words[cut]), (2, shapes[cut])):
            h = _hash(part, seed)
            with np.errstate(over="ignore"):
                pairs = mix64(h[:-1] * np.uint64(3) + h[1:])
            for g in (h[:BLOCK_WORDS], pairs):
                out.append((g >> np.uint64(64 - BITS)).astype(np.int64))
    return out


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    shift: float = 0.0

    def score(self, text: bytes) -> float:
        grams = ngrams(text)
        n = sum(map(len, grams))
        z = self.bias - self.shift
        if n:
            z += SCALE * sum(float(self.weights[g].sum()) for g in grams) / n
        return float(1 / (1 + np.exp(-np.clip(z, -35, 35))))


def features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A text's hashed n-grams and how often each occurs: 2 ** BITS of them at most."""
    grams = ngrams(text)
    idx, val = np.unique(np.concatenate(grams), return_counts=True) if grams else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    return idx.astype(np.int32), val.astype(np.int32)


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = 3, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.01, threshold: float = 0.7) -> Model:
    """Per-coordinate follow-the-regularised-leader over rows (n-grams, counts, label), in the given order.

    The smaller class is weighed up to even terms, then the intercept is moved so that the
    labels' best cut on the training scores falls on `threshold`. Without rows of both
    classes the score is constant: 1 (0) if only label 1 (0) was seen, 1 without rows.
    """
    size = 1 << BITS
    z, n, w = np.zeros(size + 1), np.zeros(size + 1), np.zeros(size + 1)
    y = np.array([b for _, _, b in rows], np.float64)
    if len(rows) == 0 or y.min() == y.max():
        return Model(np.zeros(size), -30.0 if len(rows) and y[0] == 0 else 30.0)
    weigh = {0: len(y) / (2 * (y == 0).sum()), 1: len(y) / (2 * (y == 1).sum())}
    sparse = lambda row: (np.r_[row[0], size], np.r_[SCALE * row[1] / max(1, row[1].sum()), 1.0])
    for _ in range(epochs):
        for row, label in zip(rows, y):
            idx, val = sparse(row)
            zi, ni = z[idx], n[idx]
            wi = np.where(np.abs(zi) <= l1, 0.0, (np.sign(zi) * l1 - zi) / ((beta + np.sqrt(ni)) / alpha + l2))
            p = 1 / (1 + np.exp(-np.clip(wi @ val, -35, 35)))
            g = (p - label) * val * weigh[int(label)]
            step = (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha
            z[idx] = zi + g - step * wi
            n[idx] = ni + g * g
    w = np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((beta + np.sqrt(n)) / alpha + l2))
    logits = np.array([w[i] @ v for i, v in map(sparse, rows)])
    order = np.argsort(logits, kind="stable")
    # errors if everything up to a place in the order is rejected, label-0 errors weighed as label-1 ones
    s, lab = logits[order], y[order]
    errs = np.r_[0, np.cumsum(lab == 1)] * weigh[1] + np.r_[np.cumsum((lab == 0)[::-1])[::-1], 0] * weigh[0]
    edges = np.r_[s[0] - 1, (s[:-1] + s[1:]) / 2, s[-1] + 1]
    best = np.flatnonzero(np.isclose(errs, errs.min()))
    cut = float(edges[best[len(best) // 2]])
    return Model(w[:size], float(w[size]), cut - float(np.log(threshold / (1 - threshold))))


def _features(texts: pa.Array) -> pa.Array:
    got = [features(t) for t in byte_texts(texts)]
    ends = pa.array(np.cumsum([0, *(len(i) for i, _ in got)]).astype(np.int32))
    flat = lambda k: pa.array(np.concatenate([np.zeros(0, np.int32), *(g[k] for g in got)]))
    return pa.StructArray.from_arrays([pa.ListArray.from_arrays(ends, flat(k)) for k in (0, 1)], names=["grams", "counts"])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_labels: int = MAX_LABELS) -> Model:
    """Fit on the labelled texts; at most about max_labels of them, thinned by a hash of id and text.

    Null labels and labels without a document don't count; a text that a label's id has on
    several rows counts once. Texts are hashed on the executors, and the bounded sample's
    n-grams are collected in hash order, so that a fit repeats. Ids may be of any type.
    """
    lab = labels.select(col(id_col).cast("string").alias("id"), col(label_col).cast("int").alias("label")).where("label IN (0, 1) AND id IS NOT NULL").distinct()
    n = lab.count()
    thin = lambda df, h, share: df.where(F.pmod(h, F.lit(1 << 20)) < int((1 << 20) * share)) if share < 1 else df
    lab = thin(lab, F.xxhash64("id"), max_labels / max(1, n))
    text = docs.select(col(id_col).cast("string").alias("id"), F.coalesce(col(text_col).cast("string"), F.lit("")).alias("text"))
    # the labels kept are bounded by max_labels, so they may go to every executor
    picked = text.join(F.broadcast(lab), "id").select("id", "label", F.xxhash64("id", "text", F.lit(7)).alias("h"), "text")
    picked = picked.groupBy("h", "label").agg(F.min("id").alias("id"), F.any_value("text").alias("text"))
    rows = materialize(picked.select("h", "id", "label", F.arrow_udf(_features, "grams array<int>, counts array<int>")("text").alias("f")).select("h", "id", "label", "f.*"), "quality-features")
    held = rows.agg(F.count("*"), F.sum(F.size("grams"))).first()
    rows = thin(rows, F.shiftrightunsigned("h", 40), min(2 * max_labels / max(1, held[0]), MAX_FEATURES / max(1, held[1] or 0)))
    got = rows.toArrow()
    keyed = sorted(zip(got.column("h").to_pylist(), got.column("label").to_pylist(), range(got.num_rows)))
    parts = [[x.values.to_numpy() for x in got.column(c)] for c in ("grams", "counts")]
    model = train([(parts[0][k], parts[1][k], y) for _, y, k in keyed])
    discard(rows)
    return model


def score_column(docs: DataFrame, model: Model, text_col: str = "text"):
    """Column expression: score of each whole text, as a double from 0 to 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2 ** BITS weights, whatever the input

    def run(texts: pa.Array) -> pa.Array:
        score = shared.value.score
        return pa.array(map(score, byte_texts(texts)), pa.float64())

    return F.arrow_udf(run, "double")(col(text_col).cast("string"))


def classify(docs: DataFrame, labels: DataFrame, held_out: tuple[int, int] | None = None, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """All columns of docs plus score (double, 0 to 1) and predicted (1 if score >= threshold).

    held_out (m, r) keeps documents whose crc32(id) modulo m is r out of the fit. Null and
    empty texts have no features and get the intercept's score. Columns of those names are
    replaced. Empty input gives an empty result.
    """
    known = labels if held_out is None else labels.where(fold_mod(col(id_col), held_out[0]) != held_out[1])
    model = fit(docs, known, id_col, text_col)
    scored = docs.withColumn("score", score_column(docs, model, text_col))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def accepted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """The rows of docs, all columns unchanged, with a score of at least threshold; see classify()."""
    model = fit(docs, labels, id_col, text_col)
    return docs.where(score_column(docs, model, text_col) >= threshold)
