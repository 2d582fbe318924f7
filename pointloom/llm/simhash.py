"""SimHash near-duplicate groups, found by pigeonring filtering.

A 64-bit fingerprint is a ring of four 16-bit segments. If two fingerprints differ
in at most 3 bits, some segment starts a chain whose cumulative differences stay
within the proportional budgets 3/4, 6/4, 9/4 and 12/4, that is 0, 1, 2 and 3 bits
for chains of one to four segments. The first two budgets give the exact-match keys:
the chain's first segment agrees, and of the next one (at most one differing bit) one
half agrees, so each fingerprint is filed under 4 x 2 keys of 24 bits. Pairs sharing a
key are pruned by the chain budgets and only then by the whole Hamming distance.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shingles
from .common import byte_texts, col, free_name, materialize, shuffle_parts, small
from .graph import components, star_edges

SEED = 42
MAX_BITS = 3
SHINGLE_BLOCK = 1 << 16


def fingerprint(text: bytes, width: int = 3) -> int:
    """Unsigned 64-bit SimHash over word shingles, repeats included; 0 without words."""
    words = text.lower().split()  # bytes: only A-Z change, only ASCII white space splits
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, SHINGLE_BLOCK):
        part = words[at : at + SHINGLE_BLOCK + width - 1]
        if len(part) <= width:
            shingles = [b" ".join(part)]
        else:
            shingles = list(map(b" ".join, zip(*(part[k:] for k in range(width)))))
        h = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), "<u8", len(shingles))
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def _fingerprints(texts: pa.Array) -> pa.Array:
    got = np.fromiter(map(fingerprint, byte_texts(texts)), np.uint64, len(texts))
    return pa.array(got.view(np.int64))


def _turned(fps: np.ndarray, chain: np.ndarray) -> np.ndarray:
    """Fingerprints as rings that begin with their chain's first segment."""
    turn = chain.astype(np.uint64) * np.uint64(16)
    return np.where(turn > 0, (fps >> turn) | (fps << ((np.uint64(64) - turn) & np.uint64(63))), fps)


def _within_budgets(ring: np.ndarray) -> np.ndarray:
    """Places of rings of differences whose chains of three and of four segments keep to their budgets."""
    at = np.flatnonzero(np.bitwise_count(ring & np.uint64(0xFFFFFFFFFFFF)) <= 2)
    return at[np.bitwise_count(ring[at]) <= MAX_BITS]


def close_pairs(fps: np.ndarray, group: np.ndarray, chain: np.ndarray, emit) -> None:
    """Call emit(a, b) with the pairs of equal group at most 3 bits apart.

    fps are sorted by group; chain holds the segment at which each row's chain starts.
    Memory stays linear in the rows for any group size.
    """
    rings = _turned(fps, chain)
    at = np.arange(len(fps))
    d = 0
    while len(at):
        d += 1
        at = at[at < len(fps) - d]
        at = at[group[at] == group[at + d]]
        ring = rings[at] ^ rings[at + d]
        near = np.flatnonzero(np.bitwise_count(ring & np.uint64(0xFFFFFFFF)) <= 1)
        near = near[_within_budgets(ring[near])]
        if len(near):
            emit(fps[at[near]], fps[at[near] + d])


def cross_pairs(a: np.ndarray, b: np.ndarray, chain: int, emit) -> None:
    """Call emit(x, y) with the pairs of an x of a and a y of b at most 3 bits apart, both filed under this chain."""
    ra, rb = (_turned(side, np.full(len(side), chain)) for side in (a, b))
    la, lb = ra.astype(np.uint32), rb.astype(np.uint32)  # the chain's first two segments
    for lo in range(0, len(a), CROSS_ROWS):
        i, j = np.nonzero(np.bitwise_count(la[lo : lo + CROSS_ROWS, None] ^ lb[None]) <= 1)
        near = _within_budgets(ra[lo + i] ^ rb[j])
        if len(near):
            emit(a[lo + i[near]], b[j[near]])


#: Fingerprints of a group that are compared as one; larger groups are split, and then dealt in blocks of this size.
BIG_GROUP = 4096
#: Rows of one side that cross_pairs() compares at once.
CROSS_ROWS = 64
#: Ids to drop up to this number go to every executor; with more the texts are shuffled by id.
BROADCAST_IDS = 1_000_000
#: Filed keys that one task holds at most about.
PART_ROWS = 2_000_000
#: What a row of a part is: of a group compared as one, or of the first or second block of two.
WHOLE, FIRST, SECOND = 0, 1, 2


def _links(part: pa.Table) -> pa.Table:
    """Edges of a part of rows (fp, chain, grp, side)."""
    fps = part.column("fp").to_numpy().view(np.uint64)
    chain, group, side = (part.column(c).to_numpy() for c in ("chain", "grp", "side"))
    edges, held = [], 0

    def emit(a, b):
        nonlocal edges, held
        edges.append((a, b))
        held += len(a)
        if held > 2_000_000:
            edges = [star_edges(edges)]
            held = len(edges[0][0])

    whole = np.flatnonzero(side == WHOLE)
    whole = whole[np.argsort(group[whole], kind="stable")]
    close_pairs(fps[whole], group[whole], chain[whole], emit)
    dealt = np.flatnonzero(side != WHOLE)
    dealt = dealt[np.lexsort((side[dealt], group[dealt]))]
    for rows in np.split(dealt, np.flatnonzero(np.diff(group[dealt])) + 1) if len(dealt) else ():
        first = int(np.searchsorted(side[rows], SECOND))
        cross_pairs(fps[rows[:first]], fps[rows[first:]], int(chain[rows[0]]), emit)
    a, b = star_edges(edges) if edges else (np.zeros(0, np.uint64),) * 2
    return pa.table({"u": a.view(np.int64), "v": b.view(np.int64)})


def _split(rows: DataFrame, tag: str) -> tuple[DataFrame, DataFrame]:
    """(rows of groups up to BIG_GROUP, the others with their group's count many). Counted, within tasks first."""
    large = materialize(rows.groupBy("grp").agg(F.count("*").alias("many")).where(F.col("many") > BIG_GROUP), tag)
    large = small(large, BROADCAST_IDS)
    return rows.join(large.select("grp"), "grp", "left_anti"), rows.join(large, "grp")


def _blocks(rows: DataFrame) -> DataFrame:
    """Rows of large groups, dealt to blocks by a hash: one row for each block that a row's own one meets, itself included.

    Every two blocks of a group are a group of their own, so any number of tasks compares them.
    """
    blocks = F.ceil(F.col("many") / BIG_GROUP)
    own = rows.withColumns({"blocks": blocks, "own": F.pmod(F.xxhash64("fp"), blocks)})
    met = own.withColumn("met", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
    lo, hi = F.least("own", "met"), F.greatest("own", "met")
    side = F.when(lo == hi, WHOLE).when(F.col("own") == lo, FIRST).otherwise(SECOND)
    return met.select("fp", "chain", F.xxhash64("grp", lo, hi).alias("grp"), side.alias("side"))


def filed_rows(fps: DataFrame) -> DataFrame:
    """(fp, chain, grp, side): fingerprints under the groups whose pairs are to be compared.

    Groups are the eight keys of a fingerprint. One of more than BIG_GROUP fingerprints is split: of four
    further 16-bit pieces one agrees within 3 bits' difference. What is still as large goes in blocks.
    """
    keys = []
    for i in range(4):
        j = (i + 1) % 4
        first = F.shiftrightunsigned("fp", 16 * i).bitwiseAND(F.lit(0xFFFF))
        for half in range(2):
            part = F.shiftrightunsigned("fp", 16 * j + 8 * half).bitwiseAND(F.lit(0xFF))
            tag = (i << 25) | (half << 24)
            keys.append(F.lit(tag) + F.shiftleft(first, 8) + part)
    filed = fps.select("fp", F.explode(F.array(*keys)).alias("key"))
    filed = filed.select("fp", F.shiftright("key", 25).cast("int").alias("chain"), F.col("key").cast("bigint").alias("grp"))
    few, many = _split(filed, "simhash-keys")
    # all 64 bits dealt round-robin to four pieces, so that no piece lies in the part already equal
    masks = [int("0001" * 16, 2) << piece for piece in range(4)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    pieces = F.array(*(F.xxhash64("grp", F.lit(k), F.col("fp").bitwiseAND(F.lit(m))) for k, m in enumerate(signed)))
    finer = many.select("fp", "chain", F.explode(pieces).alias("grp"))
    fine, dense = _split(finer, "simhash-pieces")
    whole = few.select("fp", "chain", "grp").unionByName(fine.select("fp", "chain", "grp"))
    return whole.withColumn("side", F.lit(WHOLE)).unionByName(_blocks(dense))


def link_fingerprints(fps: DataFrame) -> DataFrame:
    """Edges (u, v) that connect distinct fingerprints (column fp) exactly as all pairs within 3 bits do.

    Each part returns a star per local component, so edges stay linear in the rows.
    """
    rows = filed_rows(fps)
    # a task holds one part, so parts grow with the rows
    parts = max(shuffle_parts(fps.sparkSession), -(-rows.count() // PART_ROWS))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("grp"), F.lit(parts)))
    return rows.groupBy("part").applyInArrow(_links, "u long, v long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, fp (signed 64 bit) and component_id.

    component_id is the smallest id reachable over fingerprints at most 3 bits apart.
    Null and blank texts have fingerprint 0 and are linked like any other; null ids keep
    a null component unless a linked row has an id. Ids keep their type. Repeated rows stay
    repeated. Other columns are ignored, so their names can't clash. Empty input gives an empty
    result.
    """
    simhash = F.arrow_udf(_fingerprints, "long")
    prints = materialize(docs.select(col(id_col).alias("id"), simhash(col(text_col).cast("string")).alias("fp")), "simhash")
    reps = materialize(prints.groupBy("fp").agg(F.min("id").alias("rep")), "simhash-reps")
    edges = link_fingerprints(reps.select("fp"))
    comps = components(edges)  # node, root over fingerprints that have links
    linked = comps.withColumnsRenamed({"node": "fp"}).join(reps, "fp")
    low = linked.groupBy("root").agg(F.min("rep").alias("low"))
    named = linked.join(low, "root").select("fp", "low")
    # written, so that the last join has plain exchanges on both sides: a hot fingerprint can be split
    per_fp = materialize(reps.join(named, "fp", "left").select("fp", F.coalesce("low", "rep").alias("component_id")), "simhash-named")
    return prints.join(per_fp, "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Keep the row with the smallest id of each group of near copies, all columns unchanged.

    Near copies are texts whose sets of five-word shingles have a Jaccard similarity of at
    least 0.8 (shingles.near_copies), and what they reach. Of several rows with the kept id in a
    group one stays, the least by the JSON of its columns; an id that stands for texts of several
    groups is kept or dropped in each. Rows with a null id stay (they can't be named as a
    duplicate of another).
    """
    key = free_name(docs, "kept_id")
    groups = shingles.near_copies(docs.select(col(id_col), col(text_col)), id_col, text_col)
    low = materialize(groups.groupBy("root").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high").select("root", "low"), "near-low")
    gone = groups.join(low, "root").where("id <> low").select(F.col("id").alias(key)).distinct()
    gone = small(materialize(gone, "near-gone"), BROADCAST_IDS)
    kept = docs.join(gone, col(id_col) == F.col(key), "left_anti")
    again = groups.where("id IS NOT NULL").groupBy(F.col("id").alias(key)).count().where("count > 1").select(key)
    if again.isEmpty():
        return kept
    # such an id can stand for several texts, so that rows go by id and shingle set
    again = materialize(again, "near-again")
    node, root = free_name(docs, "kept_node"), free_name(docs, "kept_root")
    once = kept.join(again, col(id_col) == F.col(key), "left_anti")
    stay = groups.join(small(again, BROADCAST_IDS), F.col("id") == F.col(key), "left_semi").distinct()
    stay = stay.join(low, "root", "left").where("id = coalesce(low, id)").select(F.col("id").alias(key), F.col("node").alias(node), F.col("root").alias(root))
    stay = materialize(stay, "near-stay")
    row = F.struct(*(col(c) for c in docs.columns))
    more = docs.join(small(again, BROADCAST_IDS), col(id_col) == F.col(key), "left_semi").select(row.alias("row"), col(id_col).alias(key), shingles.node_column(text_col).alias(node))
    more = more.join(small(stay, BROADCAST_IDS), [key, node]).groupBy(root).agg(F.min_by("row", F.to_json("row")).alias("row")).select("row.*")
    return once.unionByName(more)
