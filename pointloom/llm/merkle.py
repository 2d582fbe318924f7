"""Merkle manifest of a table: a tree for each group, a tree over the groups' roots, proofs for all rows.

A level is one window: nodes go by group and parent index, and the ordered list of a whole run
is at once what the parent's digest is made of and where each child finds its siblings. The first
child of a run stands for the parent in the next level. Nodes are dealt out in blocks of
consecutive ones first, so that a block's levels need no further exchange: they are windows over
what is already together. A block's top goes on to the next pass; there are as many
passes as a tree has levels over those of a block.

Digests are SHA-256, stored as 32 bytes and hashed as 64 lowercase hex digits.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import col, discard, free_name, materialize, shuffle_parts

#: Leaves of a block, at most: one row holds the proofs of so many.
BLOCK_LEAVES = 1024
#: What is joined by broadcast has at most so many rows (of some hundred bytes); beyond it both sides are shuffled.
BROADCAST_ROWS = 50_000


def field(value: Column) -> Column:
    """One value in a preimage: `-` for null, else its number of UTF-8 bytes, `:` and itself."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(values: Sequence[Column]) -> Column:
    """Digest of the fields of values, in their order."""
    return F.unhex(F.sha2(F.concat(*map(field, values)).cast("binary"), 256))


def hex_of(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def joined(digests: Column) -> Column:
    """Digest of digests (array of binary), as hex text one after the other."""
    return F.unhex(F.sha2(F.array_join(F.transform(digests, hex_of), "").cast("binary"), 256))


def numbered(nodes: DataFrame, *order: str) -> DataFrame:
    """nodes (grp, ...) with at, the place from 0 in their group's order (nulls first), and many, the group's size.

    Rows are dealt by ranges of (grp, *order) and sorted there; each range counts its rows of a
    group, and the counts before it are added. No task sees more than its range, and a group may
    lie in any number of them. nodes must be a stored table. Null is a group of its own.
    """
    spark, keys = nodes.sparkSession, ["grp", *order]
    ranged = nodes.repartitionByRange(shuffle_parts(spark), *keys).sortWithinPartitions(*keys)
    ranged = materialize(ranged.withColumn("row", F.monotonically_increasing_id()), "merkle-ranged")
    part = F.shiftright("row", 33)
    counts = ranged.groupBy("grp", part.alias("part")).agg(F.min("row").alias("low"), F.count("*").alias("n"))
    # a row for each range of a group
    before = Window.partitionBy("grp").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    upto = F.coalesce(F.sum("n").over(before), F.lit(0))
    counts = counts.select(F.col("grp").alias("grp_"), F.col("part").alias("part_"), (upto - F.col("low")).alias("shift"), F.sum("n").over(Window.partitionBy("grp")).alias("many"))
    counts = materialize(counts, "merkle-counts")
    here = ranged["grp"].eqNullSafe(F.col("grp_")) & (part == F.col("part_"))
    out = materialize(ranged.join(_sent(counts), here).select(*nodes.columns, (F.col("row") + F.col("shift")).alias("at"), "many"), "merkle-numbered")
    discard(ranged)
    discard(counts)
    return out


def _sent(stored: DataFrame) -> DataFrame:
    return F.broadcast(stored) if stored.count() <= BROADCAST_ROWS else stored


def _others(run: Column, k: Column) -> Column:
    """Digests of a run but the one at place k."""
    return F.transform(F.filter(run, lambda x, i: i != k), lambda x: x["node"])


def _pass(nodes: DataFrame, arity: int, levels: int) -> DataFrame:
    """Nodes (grp, at, many, node, member) climbed by so many levels, in blocks of arity ** levels.

    A row per block: grp, at, many, node (its top) and members, an array of (member, path) with an
    element for each leaf, in order; path has the siblings at each level. A group of fewer levels is
    climbed to its root only.
    """
    place = lambda n: F.floor(F.col("at") / F.lit(n)).cast("long")
    leaf = F.struct("member", F.array().cast("array<array<binary>>").alias("path"))
    rows = nodes.select("grp", place(arity**levels).alias("block"), "at", "many", "node", F.array(leaf).alias("members"))
    rows = rows.repartition(shuffle_parts(nodes.sparkSession), "grp", "block")
    for _ in range(levels):
        whole = Window.partitionBy("grp", "block", place(arity)).orderBy("at").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        seen = rows.withColumn("run", F.collect_list(F.struct("node", "members")).over(whole)).where(F.col("at") % F.lit(arity) == 0)
        # each child hands down its own siblings to the leaves below it
        below = lambda x, k: F.transform(x["members"], lambda m: F.struct(m["member"].alias("member"), F.concat(m["path"], F.array(_others(F.col("run"), k))).alias("path")))
        climbs = F.col("many") > 1
        rows = seen.select(
            "grp",
            "block",
            place(arity).alias("at"),
            F.ceil(F.col("many") / F.lit(arity)).cast("long").alias("many"),
            F.when(climbs, joined(F.transform("run", lambda x: x["node"]))).otherwise(F.col("node")).alias("node"),
            F.when(climbs, F.flatten(F.transform("run", below))).otherwise(F.col("members")).alias("members"),
        )
    return rows.drop("block")


def trees(nodes: DataFrame, arity: int = 2) -> tuple[DataFrame, DataFrame]:
    """Trees of nodes (grp, at, many, node, member), one a group.

    Returns (proofs, roots). proofs has grp, at, member and path, an array with the siblings of each
    level from the leaf up, themselves arrays of digests in order and empty where a run has one node;
    roots has grp and root. roots is a stored table.
    """
    if arity < 2:
        raise ValueError("a parent needs two children at least")
    levels = max(1, int(math.log(BLOCK_LEAVES) / math.log(arity) + 1e-9))
    size = F.lit(arity**levels)
    tops, passes = nodes, []
    while True:
        done = materialize(_pass(tops, arity, levels), "merkle-pass")
        each = done.select("grp", F.col("at").alias("block"), F.posexplode("members").alias("k", "m"))
        passes.append(each.select("grp", "block", (F.col("block") * size + F.col("k")).alias("at"), "m.member", "m.path"))
        if done.where("many > 1").isEmpty():
            break
        tops = done.select("grp", "at", "many", "node", F.lit(None).cast(nodes.schema["member"].dataType).alias("member"))
    proofs = passes.pop()
    while passes:
        above = materialize(proofs.select(F.col("grp").alias("grp_"), F.col("at").alias("at_"), F.col("path").alias("up")), "merkle-above")
        below, here = passes.pop(), F.col("grp").eqNullSafe(F.col("grp_")) & (F.col("block") == F.col("at_"))
        proofs = below.join(_sent(above), here).select("grp", "block", "at", "member", F.concat("path", "up").alias("path"))
    return proofs.select("grp", "at", "member", "path"), done.select("grp", F.col("node").alias("root"))


def fold(leaf: Column, at: Column, path: Column, arity: int = 2) -> Column:
    """The root that a leaf at a place (from 0) and the siblings of all levels lead to."""

    def up(acc: Column, others: Column) -> Column:
        place = (acc["at"] % F.lit(arity)).cast("int")
        run = F.concat(F.slice(others, F.lit(1), place), F.array(acc["node"]), F.slice(others, place + 1, F.size(others)))
        return F.struct(joined(run).alias("node"), F.floor(acc["at"] / F.lit(arity)).cast("long").alias("at"))

    return F.aggregate(path, F.struct(leaf.alias("node"), at.cast("long").alias("at")), up)["node"]


def manifest(docs: DataFrame, group_col: str, order_col: str, columns: Sequence[str], carried: dict[str, Column] | None = None, arity: int = 2) -> DataFrame:
    """Per input row: order_col, leaf, subroot, root, at, path, top_at, top_path and the carried columns.

    Leaves hash columns in their order. Rows of a group ascend by order_col, nulls first, then by
    their leaf; equal rows are leaves of their own, in any order. Groups are texts and ascend by
    their bytes, null first. path has the siblings of each level up to the group's subroot, top_path
    those on from there to the root; at and top_at are places in these trees, and digests are binary.
    carried columns are computed from the input row and kept beside its leaf. Columns may be null and other columns
    of docs are ignored, whatever their names. An empty table gives an empty manifest.
    """
    extra = {name: c.alias(f"c{k}") for k, (name, c) in enumerate((carried or {}).items())}
    member = F.struct(col(order_col).alias("id"), leaf_of([col(c) for c in columns]).alias("leaf"), *extra.values())
    # stored: numbers need rows that repeat, and texts are read once; tie deals equal rows to several ranges
    leaves = docs.select(col(group_col).cast("string").alias("grp"), member.alias("member"), F.monotonically_increasing_id().alias("tie"))
    leaves = materialize(leaves.select("grp", "member", F.col("member.id").alias("id"), F.col("member.leaf").alias("node"), "tie"), "merkle-leaves")
    proofs, subroots = trees(numbered(leaves, "id", "node", "tie").drop("id", "tie"), arity)
    groups = materialize(subroots.select(F.lit("").alias("grp"), F.col("grp").alias("name"), F.col("root").alias("node"), F.struct(F.col("grp").alias("name"), F.col("root").alias("subroot")).alias("member")), "merkle-groups")
    tops, root = trees(numbered(groups, "name").drop("name"), arity)
    tops = tops.join(F.broadcast(root.select("root")))  # one row: the manifest's root
    tops = materialize(tops.select(F.col("member.name").alias("name"), "member.subroot", F.col("at").alias("top_at"), F.col("path").alias("top_path"), "root"), "merkle-tops")
    out = proofs.join(_sent(tops), F.col("grp").eqNullSafe(F.col("name")))
    kept = [F.col(f"member.c{k}").alias(name) for k, name in enumerate(extra)]
    return out.select(F.col("member.id").alias(order_col), F.col("member.leaf").alias("leaf"), "subroot", "root", "at", "path", "top_at", "top_path", *kept)


def root_of(row_leaf: Column, arity: int = 2) -> Column:
    """Root that a leaf leads to by the proof in a manifest's columns."""
    return fold(fold(row_leaf, F.col("at"), F.col("path"), arity), F.col("top_at"), F.col("top_path"), arity)


def audit(docs: DataFrame, changed: dict[str, Column], tampered: Column, group_col: str, order_col: str, columns: Sequence[str], arity: int = 2) -> DataFrame:
    """Per input row: order_col, leaf, subroot, root, proof_sha256, folded_root and verified, digests as hex text.

    Where tampered is true the leaf of the row with the changed columns is folded up the untampered
    proof, elsewhere its own. proof_sha256 is the digest of all siblings from the leaf to the root.
    As in manifest(): nulls, repeated rows, other columns and empty tables.
    """
    name = free_name(docs, "claimed")
    claim = F.when(tampered, leaf_of([changed.get(c, col(c)) for c in columns]))
    got = manifest(docs, group_col, order_col, columns, {name: claim}, arity)
    siblings = F.concat(F.flatten("path"), F.flatten("top_path"))
    got = got.withColumn("folded", root_of(F.coalesce(col(name), F.col("leaf")), arity))
    return got.select(col(order_col), *(hex_of(F.col(c)).alias(c) for c in ("leaf", "subroot", "root")), hex_of(joined(siblings)).alias("proof_sha256"), hex_of(F.col("folded")).alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"))
