"""Near copies by five-word shingles at a Jaccard similarity of 0.8: SimHash pruning, exact check.

At 0.8 a SimHash of five-word shingles differs in 9.7 of 64 bits on average, too many for
exact-match keys of its segments. So minima of the shingle set under BANDS x ROWS orders file
each set under BANDS keys; a pair at similarity s shares one with probability
1 - (1 - s ** ROWS) ** BANDS, 0.999997 at 0.8. Of the pairs that share a key, those whose
fingerprints have no chain of segments within the proportional budgets of BUDGET bits are
pruned (a pair at 0.8 stays within them with a probability over 0.9998), and whole shingle
sets decide about the rest: first against the most central set of each key, then against any
one. Sets of a key that are still apart are compared by signatures of SIGNS minima, and whole
where these agree.
"""

from __future__ import annotations

from functools import cache, reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import byte_texts, col, discard, materialize, mix64, shuffle_parts, small
from .graph import components

# The rule of stages on word shingles.
WIDTH, SHARE = 5, (4, 5)
BANDS, ROWS = 24, 4
#: Bits that fingerprints may differ in, over a ring of SEGMENTS segments.
BUDGET, SEGMENTS = 21, 8
#: Minima of a signature, and how many bytes must agree: a pair at 0.8 falls short with a
#: probability under 0.0001.
SIGNS, AGREE = 512, 376
SEED = 42
BLOCK = 1 << 14
#: Sets of a key that are compared in one block, and rows of one task at most about.
BLOCK_SETS, PART_SETS = 2048, 40_000
#: Keys, sets and pairs up to this number go to every executor; with more the join is shuffled.
BROADCAST_PAIRS = 500_000
#: Rounds that compare with one set of each key.
ROUNDS = 2


def shingle_set(text: bytes, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct hashes of the word shingles; the whole text if it has fewer words."""
    words = text.lower().split()
    if len(words) <= width:
        shingles = [b" ".join(words)] if words else []
    else:
        shingles = map(b" ".join, zip(*(words[k:] for k in range(width))))
    n = max(1, len(words) - width + 1) if words else 0
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64, n))


@cache
def _orders() -> tuple[np.ndarray, np.ndarray]:
    x = mix64(np.arange(1, 2 * BANDS * ROWS + 1, dtype=np.uint64))
    return x[::2, None], x[1::2, None] | np.uint64(1)


def band_keys(grams: np.ndarray) -> np.ndarray:
    """One key a band, none for a set without shingles."""
    if not len(grams):
        return np.zeros(0, np.int64)
    flip, factor = _orders()
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(grams), BLOCK):
            np.minimum(low, ((grams[None, at : at + BLOCK] ^ flip) * factor).min(axis=1), out=low)
        key = np.arange(BANDS, dtype=np.uint64)
        for r in range(ROWS):
            key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + low[r::ROWS])
    return key.view(np.int64)


def fingerprint(grams: np.ndarray) -> int:
    """SimHash of a shingle set: bits set in over half of the hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(grams), BLOCK):
        bits = np.unpackbits(grams[at : at + BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(grams), bitorder="little").view("<i8")[0])


def _node(grams: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(grams.tobytes(), SEED) - (1 << 63) if len(grams) else 0


def _lists(parts: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *parts])))


def _prints(texts: pa.Array) -> pa.Array:
    sets = [shingle_set(t) for t in byte_texts(texts)]
    longs = lambda values: pa.array(np.fromiter(values, np.int64, len(sets)))
    cols = [longs(map(_node, sets)), longs(map(len, sets)), longs(map(fingerprint, sets)), _lists([band_keys(s) for s in sets])]
    return pa.StructArray.from_arrays(cols, names=["node", "n", "fp", "keys"])


def _sets(texts: pa.Array) -> pa.Array:
    sets = [shingle_set(t) for t in byte_texts(texts)]
    node = pa.array(np.fromiter(map(_node, sets), np.int64, len(sets)))
    return pa.StructArray.from_arrays([node, _lists([s.view(np.int64) for s in sets])], names=["node", "grams"])


def node_column(text_col: str):
    """Column: hash of the text's shingle set, 0 without words."""

    def run(texts: pa.Array) -> pa.Array:
        return pa.array(np.fromiter((_node(shingle_set(t)) for t in byte_texts(texts)), np.int64, len(texts)))

    return F.arrow_udf(run, "long")(col(text_col).cast("string"))


def within_budgets(x: Column, bits: int = BUDGET, segments: int = SEGMENTS) -> Column:
    """Pigeonring: some chain around the ring of x (the xor of two prints) keeps to every budget."""
    width = 64 // segments

    def count(first: int, length: int) -> Column:
        mask = sum(((1 << width) - 1) << (width * ((first + k) % segments)) for k in range(length))
        return F.bit_count(x.bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask).cast("long")))

    chains = [reduce(lambda a, b: a & b, [count(i, m) <= bits * m // segments for m in range(1, segments)]) for i in range(segments)]
    return (F.bit_count(x) <= bits) & reduce(lambda a, b: a | b, chains)


def _wide(df: DataFrame) -> DataFrame:
    return small(df, BROADCAST_PAIRS)


def _alike(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (u, v) whose shingle sets are similar enough."""
    both = sets.select(F.col("node").alias("u"), F.col("grams").alias("a")).join(_wide(pairs), "u")
    both = both.join(sets.select(F.col("node").alias("v"), F.col("grams").alias("b")), "v")
    shared, all_ = F.size(F.array_intersect("a", "b")), F.size("a") + F.size("b")
    return materialize(both.where((SHARE[0] + SHARE[1]) * shared >= SHARE[0] * all_).select("u", "v"), "shingle-edges")


def _apart(named: DataFrame) -> DataFrame:
    """The rows of keys with sets of several components."""
    keys = named.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b").select("key")
    keys = materialize(keys, "shingle-apart")
    out = materialize(named.join(_wide(keys), "key", "left_semi"), "shingle-filed")
    discard(keys)
    return out


def _centres(named: DataFrame, k: int) -> DataFrame:
    """One set of each key: in the first round the one whose keys have most sets, then any."""
    if k:
        rank = F.xxhash64("node", "key", F.lit(k))
    else:
        named = named.join(named.groupBy("key").agg(F.count("*").alias("many")), "key")
        named = named.join(named.groupBy("node").agg(F.sum("many").alias("central")), "node")
        rank = -F.col("central")
    pick = F.min(F.struct(rank.alias("rank"), F.col("node").alias("w"), F.col("n").alias("m"), F.col("fp").alias("other_fp"), F.col("root").alias("top")))
    return named.groupBy("key").agg(pick.alias("p")).select("key", "p.w", "p.m", "p.other_fp", "p.top")


@cache
def _finer_orders() -> tuple[np.ndarray, np.ndarray]:
    x = mix64(np.arange(1, 2 * SIGNS + 1, dtype=np.uint64) + np.uint64(1 << 32))
    return x[::2, None], x[1::2, None] | np.uint64(1)


def signature(grams: np.ndarray) -> np.ndarray:
    """A byte of each of SIGNS minima; two sets at similarity s agree in s + (1 - s) / 256 of them."""
    flip, factor = _finer_orders()
    low = np.full(SIGNS, np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(grams), BLOCK // 4):
            np.minimum(low, ((grams[None, at : at + BLOCK // 4] ^ flip) * factor).min(axis=1), out=low)
    return (mix64(low) & np.uint64(255)).astype(np.uint8)


def _signatures(grams: pa.Array) -> pa.Array:
    """The signature and the keys of each set, as bytes."""
    flat, ends = grams.flatten().to_numpy().view(np.uint64), np.r_[0, np.cumsum(grams.value_lengths().to_numpy())]
    own = [flat[a:b] for a, b in zip(ends[:-1], ends[1:])]
    cols = [pa.array((f(g).tobytes() for g in own), pa.binary()) for f in (signature, band_keys)]
    return pa.StructArray.from_arrays(cols, names=["sign", "keys"])


def _likely(part: pa.Table) -> pa.Table:
    """Pairs (u, v) of one key and pair of blocks, of different components, whose signatures agree enough.

    Of all keys that a pair shares, the first one gives it.
    """
    cols = {c: part.column(c).to_numpy() for c in ("key", "low", "high", "node", "n", "root")}
    sign = np.frombuffer(b"".join(part.column("sign").to_pylist()), np.uint8).reshape(-1, SIGNS)
    keys = np.frombuffer(b"".join(part.column("keys").to_pylist()), np.int64).reshape(-1, BANDS)
    order = np.lexsort((cols["high"], cols["low"], cols["key"]))
    new = np.zeros(len(order), bool)
    for c in ("key", "low", "high"):
        new[1:] |= np.diff(cols[c][order]) != 0
    u, v = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for rows in np.split(order, np.flatnonzero(new)):
        own, node, n, root = sign[rows], cols["node"][rows], cols["n"][rows], cols["root"][rows]
        for k in range(len(rows) - 1):
            near = np.flatnonzero((root[k + 1 :] != root[k]) & (SHARE[1] * np.minimum(n[k + 1 :], n[k]) >= SHARE[0] * np.maximum(n[k + 1 :], n[k]))) + k + 1
            near = near[(own[near] == own[k]).sum(axis=1) >= AGREE]
            near = near[keys[rows[k], (keys[rows[near]] == keys[rows[k]]).argmax(axis=1)] == cols["key"][rows[k]]]
            if len(near):
                u.append(np.maximum(node[near], node[k]))
                v.append(np.minimum(node[near], node[k]))
    both = np.unique(np.stack([np.concatenate(u), np.concatenate(v)], axis=1), axis=0)
    return pa.table({"u": both[:, 0], "v": both[:, 1]})


def _close_pairs(left: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (u, v) of sets of different components that share a key and, by their signatures, may be similar.

    Keys with many sets are compared in pairs of blocks, by any number of tasks; only likely
    pairs leave them.
    """
    nodes = _wide(materialize(left.select(F.col("node").alias("node_")).distinct(), "shingle-left"))
    signs = sets.join(nodes, F.col("node") == F.col("node_"), "left_semi").select("node", F.arrow_udf(_signatures, "sign binary, keys binary")("grams").alias("s")).select("node", "s.*")
    signs = materialize(signs, "shingle-signs")
    blocks = left.groupBy("key").agg(F.ceil(F.count("*") / F.lit(BLOCK_SETS)).cast("int").alias("blocks"))
    dealt = left.join(blocks, "key").withColumn("b", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = dealt.select("key", "node", "n", "root", "b", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("o"))
    dealt = dealt.select("key", "node", "n", "root", F.least("b", "o").alias("low"), F.greatest("b", "o").alias("high"))
    dealt = materialize(dealt, "shingle-dealt")
    parts = max(shuffle_parts(left.sparkSession), dealt.count() // PART_SETS)
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("key", "low", "high"), F.lit(parts)))
    return dealt.join(signs, "node").groupBy("part").applyInArrow(_likely, "u long, v long")


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, node (hash of the shingle set), root (its component's node).

    Components join sets of a Jaccard similarity of at least 0.8. Null texts and texts without
    words have node 0 and are copies of each other. Other columns are ignored; ids keep their
    type and may be null or repeated. Empty input gives an empty result.
    """
    text = col(text_col).cast("string")
    found = F.arrow_udf(_prints, "node long, n long, fp long, keys array<long>")(text)
    prints = materialize(docs.select(col(id_col).alias("id"), F.xxhash64(text).alias("th"), found.alias("p")).select("id", "th", "p.*"), "shingle-prints")
    each = prints.groupBy("node").agg(F.any_value("n").alias("n"), F.any_value("fp").alias("fp"), F.any_value("keys").alias("keys"))
    filed = _apart(each.select("node", "n", "fp", F.explode("keys").alias("key"), F.col("node").alias("root")))
    # whole sets of the candidates only, each from one of its texts
    ends = prints.select("node", "th").join(_wide(materialize(filed.select("node").distinct(), "shingle-ends")), "node", "left_semi")
    ends = materialize(ends.groupBy("node").agg(F.min("th").alias("th")).select(F.col("th").alias("th_")).distinct(), "shingle-texts")
    held = docs.select(text.alias("t")).join(_wide(ends), F.xxhash64("t") == F.col("th_"), "left_semi")
    held = held.select(F.arrow_udf(_sets, "node long, grams array<long>")("t").alias("s")).select("s.*")
    sets = materialize(held.groupBy("node").agg(F.any_value("grams").alias("grams")), "shingle-sets")
    edges, roots = None, None
    fits = (F.least("n", "m") * SHARE[1] >= F.greatest("n", "m") * SHARE[0]) & within_budgets(F.col("fp").bitwiseXOR(F.col("other_fp")))
    for k in range(ROUNDS + 1):
        if k:
            if roots is not None:
                filed = filed.drop("root").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
            filed = _apart(filed.select("node", "n", "fp", "key", "root"))
        if filed.isEmpty():
            break
        if k < ROUNDS:
            near = filed.join(_centres(filed, k), "key").where((F.col("root") != F.col("top")) & fits)
            many = near.groupBy("node", "w").agg(F.count("*").alias("many"))
            pairs = many.groupBy("node").agg(F.max(F.struct("many", "w")).alias("p")).select(F.greatest("node", "p.w").alias("u"), F.least("node", "p.w").alias("v"))
        else:
            pairs = _close_pairs(filed, sets)
        pairs = materialize(pairs.distinct(), "shingle-pairs")
        new = _alike(pairs, sets)
        discard(pairs)
        if not new.isEmpty():
            edges = new if edges is None else edges.unionByName(new)
            roots = components(edges)
    out = prints.select("id", "node").withColumn("root", F.col("node"))
    if roots is not None:
        out = prints.select("id", "node").join(_wide(roots.where("node <> root")), "node", "left").select("id", "node", F.coalesce("root", "node").alias("root"))
    out = materialize(out, "near-copies")
    for done in (prints, sets, filed):
        discard(done)
    return out
