"""Benchmark decontamination by spaced seeds.

Fixed masks hash 5 of up to 9 neighbouring tokens and ignore the others, so that a hit
survives substitutions at the ignored places. Any stretch of 11 tokens with two
substitutions still has a hit under one of the two masks (tests try all cases). Shorter
items have masks of their own, each without some of their pieces.

A Bloom filter of the benchmark's seed hashes goes to the tasks that read the documents; the
few seeds that pass it are joined to the benchmark's by their hash, which removes false
positives, and the hits of a text and an item are verified along their diagonals.
"""

from __future__ import annotations

import hashlib
import re
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_texts, col, free_name, materialize, mix64, small, starts_of

# Token offsets that each mask hashes.
MASKS = ((0, 1, 2, 4, 5), (0, 1, 3, 7, 8))
#: Overlap asked for: of so many aligned tokens this share must agree.
WINDOW, SHARE = 13, 0.8
#: Items of fewer tokens than this have masks of their own.
LONG = 11
#: The filter's bits per seed, its bounds in bits, and most probes of a seed. Beyond the upper
#: bound (32 MiB) it lets more pass, and the join decides.
SEED_BITS, LEAST_BITS, MOST_BITS, PROBES = 64, 1 << 22, 1 << 28, 8
#: Texts with an overlap up to this number go to every executor; with more the texts are shuffled.
BROADCAST_TEXTS = 500_000
#: Tokens that are searched at once, and at least one text.
BLOCK_TOKENS = 1 << 17
# Scripts written without blanks: Thai, Lao, Myanmar, Khmer, kana, ideographs.
_UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3005-\u3007\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff"
_TOKEN = re.compile(rf"(?=\w)[{_UNSPACED}]|[^\W{_UNSPACED}]+")


def tokens(text: str) -> np.ndarray:
    """Hashes of the lower-cased runs of letters, digits and underscores; in scripts without
    blanks every character is a token."""
    found = _TOKEN.findall(text.lower())
    return np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))


def agreeing(width: int) -> int:
    """How many of so many aligned tokens must agree."""
    return int(np.ceil(SHARE * width))


def short_masks(n: int) -> list[tuple[int, ...]]:
    """Masks of an item of n < LONG tokens: whatever may differ, one of them doesn't hash it."""
    gone = n - agreeing(n)
    pieces = np.array_split(np.arange(n), 2 * gone + 1)
    return [tuple(int(o) for k, p in enumerate(pieces) if k not in out for o in p) for out in combinations(range(len(pieces)), gone)]


def masks_of(n: int) -> list[tuple[int, ...]]:
    return list(MASKS) if n >= LONG else short_masks(n) if n else []


def seeds(t: np.ndarray, mask: tuple[int, ...]) -> np.ndarray:
    """Hash under the mask at each place where the whole mask fits."""
    n = len(t) - mask[-1]
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, xxhash.xxh3_64_intdigest(repr(mask)), np.uint64)
    with np.errstate(over="ignore"):
        for k, off in enumerate(mask):
            out += t[off : off + n] * (mix64(np.uint64(k + 1)) | np.uint64(1))
        return mix64(out)


class Filter:
    """Bloom filter of 64-bit hashes over 2 ** bits bits."""

    def __init__(self, words: np.ndarray, probes: int):
        self.words, self.probes = words, probes

    @staticmethod
    def places(h: np.ndarray, size: int, probe: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (h if probe == 0 else mix64(h + np.uint64(probe))) & np.uint64(size - 1)

    def passing(self, h: np.ndarray) -> np.ndarray:
        """Places of the hashes that may be in the filter."""
        at = np.arange(len(h))
        for probe in range(self.probes):
            place = self.places(h[at], 64 * len(self.words), probe)
            at = at[(self.words[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) == 1]
            if not len(at):
                break
        return at


def build_filter(hashes: DataFrame, n: int) -> Filter:
    """Filter of the n or fewer hashes h (long) of a table, of a bounded size."""
    size = LEAST_BITS
    while size < min(MOST_BITS, n * SEED_BITS):
        size *= 2
    probes = int(max(1, min(PROBES, round(0.69 * size / max(1, n)))))

    def places(batches):
        for batch in batches:
            h = batch.column("h").to_numpy().view(np.uint64)
            place = np.unique(np.concatenate([Filter.places(h, size, k) for k in range(probes)]))
            word = (place >> np.uint64(6)).astype(np.int64)
            starts = np.flatnonzero(np.r_[True, np.diff(word) != 0])[: len(word)]
            bits = np.bitwise_or.reduceat(np.uint64(1) << (place & np.uint64(63)), starts) if len(word) else place
            yield pa.RecordBatch.from_pydict({"word": pa.array(word[starts]), "bits": pa.array(bits.view(np.int64))})

    rows = hashes.select("h").mapInArrow(places, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()  # a row per word at most
    words = np.zeros(size // 64, np.uint64)
    words[rows.column("word").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
    return Filter(words, probes)


def verify(t: np.ndarray, a: np.ndarray, hits: list[tuple[np.ndarray, np.ndarray]]) -> list[dict]:
    """Overlaps of text t and item a, given places of equal seeds in both: start, n_tokens, matches."""
    width = min(WINDOW, len(a))
    need = agreeing(width)
    shifts = [np.zeros(0, np.int64)]
    for at, place in hits:
        step = max(1, (1 << 22) // max(1, len(place)))
        shifts += [np.unique(at[k : k + step, None] - place) for k in range(0, len(at), step)]
    cover = np.zeros(len(t) + 1, np.int64)
    link = np.zeros(len(t) + 1, np.int64)
    same = np.zeros(len(t), bool)
    for d in np.unique(np.concatenate(shifts)).tolist():
        lo, hi = max(0, -d), min(len(a), len(t) - d)
        if hi - lo < width:
            continue
        agree = a[lo:hi] == t[d + lo : d + hi]
        run = np.r_[0, np.cumsum(agree)]
        good = np.flatnonzero(run[width:] - run[:-width] >= need) + d + lo
        if not len(good):
            continue
        cover[good] += 1
        cover[good + width] -= 1
        link[good] += 1
        link[good + width - 1] -= 1
        inside = np.zeros(hi - lo + 1, np.int64)
        inside[good - d - lo] += 1
        inside[good - d - lo + width] -= 1
        same[d + lo : d + hi] |= agree & (np.cumsum(inside[:-1]) > 0)
    covered, linked = np.cumsum(cover[:-1]) > 0, np.cumsum(link[:-1]) > 0
    first = np.flatnonzero(covered & ~np.r_[False, linked[:-1]])
    last = np.flatnonzero(covered & ~linked)
    return [{"start": int(b), "n_tokens": int(e - b + 1), "matches": int(same[b : e + 1].sum())} for b, e in zip(first, last)]


def _lists(parts: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *(x.astype(np.int64, copy=False) for x in parts)])))


def _tokens(texts: pa.Array) -> pa.Array:
    return _lists([tokens(t).view(np.int64) for t in (b.decode() for b in byte_texts(texts))])


def _item_seeds(batches):
    for batch in batches:
        for item, t in zip(batch.column("item").to_pylist(), batch.column("tok").to_pylist()):
            t = np.array(t, np.int64).view(np.uint64)
            h = [seeds(t, m) for m in masks_of(len(t))]
            place = np.concatenate([np.zeros(0, np.int64), *map(lambda x: np.arange(len(x)), h)])
            h = np.concatenate([np.zeros(0, np.uint64), *h])
            yield pa.RecordBatch.from_pydict({"item": pa.array([item] * len(h), pa.string()), "h": pa.array(h.view(np.int64)), "place": pa.array(place)})


_VERIFIED = pa.list_(pa.struct([("start", pa.int64()), ("n_tokens", pa.int64()), ("matches", pa.int64())]))


def _verify(tok: pa.Array, item_tok: pa.Array, hits: pa.Array) -> pa.Array:
    longs = lambda x: np.array(x, np.int64)
    rows = zip(tok.to_pylist(), item_tok.to_pylist(), hits.to_pylist())
    return pa.array((verify(longs(t), longs(a), [(longs(p["at"]), longs(p["place"])) for p in found]) for t, a, found in rows), _VERIFIED)


def _items(benchmark: DataFrame, text_col: str) -> DataFrame:
    """(item, tok) of each distinct text: its digest and its tokens."""
    text = col(text_col).cast("string")
    one = benchmark.select(text.alias("text")).where("text IS NOT NULL").distinct()
    out = one.select(F.md5(F.col("text").cast("binary")).alias("item"), F.arrow_udf(_tokens, "array<long>")("text").alias("tok"))
    return materialize(out.where(F.size("tok") > 0), "decontam-items")


def _blocks(texts: list[bytes]):
    """Tokens of runs of texts of some size, each with the place of its first text."""
    lo, held, size = 0, [], 0
    for k, text in enumerate(texts):
        held.append(tokens(text.decode()))
        size += len(held[-1])
        if size > BLOCK_TOKENS or k == len(texts) - 1:
            yield lo, held
            lo, held, size = k + 1, [], 0


def _search(tok: np.ndarray, starts: np.ndarray, masks: list[tuple[int, ...]], found: Filter) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, hash and place of the seeds that pass the filter, by text; tok holds texts end to end."""
    parts = []
    for mask in masks:
        h = seeds(tok, mask)
        p = found.passing(h)
        k = np.searchsorted(starts, p, "right") - 1
        whole = p + mask[-1] < starts[k + 1]  # a seed over the end of a text is none
        parts.append((k[whole], h[p[whole]], (p - starts[k])[whole]))
    whose, h, at = (np.concatenate([np.zeros(0, t), *x]) for x, t in zip(zip(*parts) if parts else ((), (), ()), (np.int64, np.uint64, np.int64)))
    order = np.argsort(whose, kind="stable")
    return whose[order], h[order], at[order]


def overlaps(docs: DataFrame, benchmark: DataFrame, id_cols: list[str], text_col: str = "text", item_text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rows, found): rows has id_cols and the text's digest key, of each row whose seeds pass the
    filter; found has key, item (digest of the item's text), start, n_tokens and matches."""
    items = _items(benchmark, item_text)
    known = materialize(items.mapInArrow(_item_seeds, "item string, h long, place long").groupBy("h", "item").agg(F.collect_list("place").alias("place")), "decontam-seeds")
    lengths = [r[0] for r in items.select(F.least(F.size("tok"), F.lit(LONG)).alias("n")).distinct().collect()]  # LONG values at most
    masks = list(dict.fromkeys(m for n in sorted(lengths) for m in masks_of(n)))
    shared = docs.sparkSession.sparkContext.broadcast(build_filter(known, known.count()))
    names = [f"id{k}" for k in range(len(id_cols))]

    def passing(batches):
        for batch in batches:
            texts = byte_texts(batch.column("text"))
            for lo, tok in _blocks(texts):
                starts = starts_of(np.array(list(map(len, tok)), np.int64))
                whose, h, at = _search(np.concatenate(tok), starts, masks, shared.value)
                keep, first = np.unique(whose, return_index=True)
                rows = batch.take(pa.array(keep + lo)).drop_columns(["text"])
                cut = lambda x: _lists(np.split(x, first[1:]) if len(keep) else [])
                key = pa.array([hashlib.md5(texts[lo + k]).hexdigest() for k in keep.tolist()], pa.string())
                yield pa.RecordBatch.from_arrays([*rows.columns, key, _lists([tok[k].view(np.int64) for k in keep.tolist()]), cut(h.view(np.int64)), cut(at)], [*names, "key", "tok", "h", "at"])

    rows = docs.select(*(col(c).alias(n) for c, n in zip(id_cols, names)), col(text_col).cast("string").alias("text"))
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema[:-1]) + "key string, tok array<long>, h array<long>, at array<long>"
    rows = materialize(rows.mapInArrow(passing, schema), "decontam-rows")
    texts = rows.groupBy("key").agg(F.any_value(F.struct("tok", "h", "at")).alias("t")).select("key", "t.*")
    own = texts.select("key", F.explode(F.arrays_zip("h", "at")).alias("s")).groupBy("key", "s.h").agg(F.collect_list("s.at").alias("at"))
    hits = own.join(known, "h").groupBy("key", "item").agg(F.collect_list(F.struct("at", "place")).alias("hits"))
    pairs = hits.join(texts.select("key", "tok"), "key").join(items.select("item", F.col("tok").alias("item_tok")), "item")
    found = pairs.select("key", "item", F.explode(F.arrow_udf(_verify, "array<struct<start:long,n_tokens:long,matches:long>>")("tok", "item_tok", "hits")).alias("o"))
    found = materialize(found.select("key", "item", "o.*"), "decontam-found")
    return rows.select(*(F.col(n).alias(c) for c, n in zip(id_cols, names)), "key"), found


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per input row, benchmark item and overlap: id, item_id, start, n_tokens, matches.

    An item is found where some 13 aligned tokens (all tokens of a shorter item) agree in 80 %;
    items under 5 tokens must so occur verbatim. Stretches of such windows that share a token
    are one overlap: start and n_tokens give its document tokens, matches how many of them agree
    with the item in such a window. Items with a null id or without tokens are left out, equal
    items count once per id. Ids keep their types. Null and empty texts overlap nothing; repeated
    rows are repeated; other columns are left out. An empty table gives an empty result.
    """
    rows, found = overlaps(docs, benchmark, [id_col], text_col, item_text)
    ids = benchmark.select(col(item_id).alias("item_id"), F.md5(col(item_text).cast("string").cast("binary")).alias("item")).where("item_id IS NOT NULL AND item IS NOT NULL").distinct()
    named = found.join(ids, "item").select(F.col("key").alias("key_"), "item_id", "start", "n_tokens", "matches")
    return rows.select(col(id_col), "key").join(named, F.col("key") == F.col("key_")).select(col(id_col), "item_id", "start", "n_tokens", "matches")


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_text: str = "text") -> DataFrame:
    """The rows of docs, all columns unchanged, whose text overlaps no benchmark item.

    Items of any length count, with a null id too; overlaps are those of contamination(). Null
    texts stay; repeated rows stay or go together. Columns may have any names; an empty
    benchmark keeps all rows, an empty table gives an empty result.
    """
    _, found = overlaps(docs, benchmark, [], text_col, item_text)
    key = free_name(docs, "found_key")
    bad = materialize(found.select(F.col("key").alias(key)).distinct(), "decontam-keys")
    return docs.join(small(bad, BROADCAST_TEXTS), F.md5(col(text_col).cast("string").cast("binary")) == F.col(key), "left_anti")
