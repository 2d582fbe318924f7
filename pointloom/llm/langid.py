"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, fold_mod, free_name

BITS = 16
ORDERS = (1, 2, 3)
#: Documented bound of the fit: about so many documents a language.
DOCS_PER_LANG = 2000
#: Languages are fitted and scored in blocks of so many, so that a broadcast matrix has at most
#: 2 ** BITS * BLOCK_LANGS entries; all languages take part.
BLOCK_LANGS = 64
BLOCK = 1 << 19
UNKNOWN = "und"


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def _codes(text: str) -> np.ndarray:
    """Lower-case code points, everything but letters as a blank, three blanks at the end."""
    c = np.frombuffer((text.lower() + "   ").encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint32)
    c[~_letters()[c]] = 32
    return c


def _buckets(codes: np.ndarray, order: int) -> np.ndarray:
    """Bucket of the n-gram that starts at each place; the last places see blanks beyond the end."""
    with np.errstate(over="ignore"):
        h = codes * np.uint32(0x9E3779B1) + np.uint32(order)
        for k in range(1, order):
            nxt = np.full(len(codes), 32, np.uint32)
            nxt[:-k] = codes[k:]
            h = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B) + nxt * np.uint32(0xC2B2AE35)
        h = (h ^ (h >> np.uint32(13))) * np.uint32(0x27D4EB2F)
    return h >> np.uint32(32 - BITS)


def pieces(text: str):
    """A text's code arrays of at most BLOCK places, and how many n-grams start in each."""
    c = _codes(text)
    step = max(ORDERS) - 1
    for at in range(0, len(c), BLOCK):
        part = c[at : at + BLOCK + step]
        yield part, min(BLOCK, len(c) - at)


@dataclass
class Model:
    langs: list[str]
    log_prob: np.ndarray  # (2 ** BITS, languages)
    log_prior: np.ndarray

    def joint(self, texts: list[str]) -> np.ndarray:
        """Log joint probabilities; a text's row doesn't depend on its neighbours."""
        out = np.empty((len(texts), len(self.langs)))
        batch: list[np.ndarray] = []
        rows: list[int] = []
        ahead = max(ORDERS) - 1
        blanks = np.full(ahead, 32, np.uint32)

        def flush() -> None:
            if batch:
                codes = np.concatenate(batch)
                end = np.cumsum([len(b) for b in batch])
                # the blanks that the last n-grams look at start none themselves
                bounds = np.stack([np.r_[0, end[:-1]], end - ahead], axis=1).ravel()
                total = sum(np.add.reduceat(self.log_prob[_buckets(codes, n)], bounds, axis=0)[::2] for n in ORDERS)
                out[rows] = self.log_prior + total
                batch.clear()
                rows.clear()

        size = 0
        for i, text in enumerate(texts):
            if len(text) > BLOCK // 2:
                total = self.log_prior.copy()
                for part, n in pieces(text):
                    for order in ORDERS:
                        total = total + self.log_prob[_buckets(part, order)[:n]].sum(axis=0)
                out[i] = total
                continue
            batch.append(np.concatenate([_codes(text), blanks]))
            rows.append(i)
            size += len(batch[-1])
            if size > BLOCK:
                flush()
                size = 0
        flush()
        return out

def _count(batches):
    """Per batch: (lang, bucket, n) of the n-grams."""
    for batch in batches:
        langs = batch.column("lang").to_pylist()
        sums: dict[str, np.ndarray] = {}
        for lang, text in zip(langs, batch.column("text").to_pylist()):
            total = sums.setdefault(lang, np.zeros(1 << BITS, np.int64))
            for part, n in pieces(text):
                for order in ORDERS:
                    total += np.bincount(_buckets(part, order)[:n], minlength=1 << BITS)
        for lang, total in sums.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(at), pa.string()), "bucket": pa.array(at, pa.int64()), "n": pa.array(total[at], pa.int64())})


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", docs_per_lang: int = DOCS_PER_LANG):
    """Models of blocks of languages in code-point order, from rows with a language and a non-null text.

    Add-half smoothing; a language with more rows is thinned by a hash of id and text to about
    docs_per_lang. Each block of BLOCK_LANGS languages takes a scan of docs.
    """
    known = docs.select(col(id_col).alias("id"), col(text_col).cast("string").alias("text"), col(lang_col).cast("string").alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    sizes = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    every, rows_in_all = sorted(sizes), sum(sizes.values())
    for lo in range(0, len(every), BLOCK_LANGS):
        langs = every[lo : lo + BLOCK_LANGS]
        share = F.lit(0)
        for x in langs:
            share = F.when(F.col("lang") == x, min(1 << 20, int((1 << 20) * docs_per_lang / sizes[x]) + 1)).otherwise(share)
        sample = known.where(F.pmod(F.xxhash64("id", "text"), F.lit(1 << 20)) < share).select("lang", "text")
        counts = sample.mapInArrow(_count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
        table = np.full((1 << BITS, len(langs)), 0.5)
        place = np.searchsorted(langs, counts.column("lang").to_pylist()) if counts.num_rows else np.zeros(0, int)
        table[counts.column("bucket").to_numpy(), place] += counts.column("n").to_numpy()
        rows = np.array([sizes[x] for x in langs], float)
        yield Model(langs, np.log(table / table.sum(axis=0)), np.log(rows / rows_in_all))


def predict(models, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """Best language over all models and its posterior; one model is needed at a time."""
    lang, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
    known = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))]
    if not known:
        return lang, score
    top, odds = np.full(len(known), -np.inf), np.zeros(len(known))
    for model in models:
        joint = model.joint([texts[i] for i in known])
        best, high = joint.argmax(axis=1), joint.max(axis=1)
        for k in np.flatnonzero(high > top):
            lang[known[k]] = model.langs[best[k]]
        new = np.maximum(top, high)
        odds = odds * np.exp(top - new) + np.exp(joint - new[:, None]).sum(axis=1)
        top = new
    if np.isfinite(top).all():
        score[known] = 1 / odds
    return lang, score


def identify(docs: DataFrame, held_out: tuple[int, int] | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """All columns of docs plus lang_pred and score (posterior of the predicted language).

    held_out (m, r) leaves rows whose crc32(id) modulo m is r out of the fit. Null texts and
    texts without a letter get `und` and score 0, as do all texts if no language is known.
    Ties go to the first language by code point. Columns of those names are replaced.
    """
    train = docs if held_out is None else docs.where(fold_mod(col(id_col), held_out[0]) != held_out[1])
    shared = [docs.sparkSession.sparkContext.broadcast(m) for m in fit(train, id_col, text_col, lang_col)]

    def models():
        for block in shared:
            yield block.value
            if len(shared) > 1:  # a worker holds one block's matrix
                block.__dict__.pop("_value", None)

    def run(texts: pa.Array) -> pa.Array:
        lang, score = predict(models(), texts.to_pylist())
        return pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["lang_pred", "score"])

    got = F.arrow_udf(run, "lang_pred string, score double")(col(text_col).cast("string"))
    both = free_name(docs, "language")
    return docs.withColumn(both, got).withColumns({"lang_pred": F.col(f"{both}.lang_pred"), "score": F.col(f"{both}.score")}).drop(both)
