"""Mixing sources to target weights by hash-threshold histograms, in DataFrame operations only.

Each row has a 60-bit hash of its id and text. Per source, sizes are summed by the hash's leading
12 bits; the running sums show in which bucket the budget ends, and only that bucket is
summed again by the next 12 bits, until it holds a single hash. What lies below the
threshold is taken: a filter, without sorting, and for a larger budget a superset. Rows of
one hash (equal id and text) at the edge are told apart by their other columns and numbered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_RE, col, discard, free_name, materialize, small

# Weights by rank of the source, repeating.
WEIGHTS = (5, 2, 1)
#: No row is taken more often than this.
MAX_REPEATS = 3
LEVELS, STEP = 5, 12
#: Sources up to this number go to every executor; beyond it the join is shuffled.
BROADCAST_SOURCES = 20_000


def n_words(text: Column) -> Column:
    """Number of words, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_RE)), F.lit(0)).cast("long")


def row_hash(ident: Column, text: Column) -> Column:
    """The leading 60 bits of the md5 of the id's text, a zero and the text; nulls count as empty."""
    part = lambda c: F.coalesce(c.cast("string"), F.lit("")).cast("binary")
    digest = F.md5(F.concat(part(ident), F.lit(b"\0"), part(text)))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = MAX_REPEATS) -> DataFrame:
    """source, source_size, target from source, source_size: one row per source.

    Weights go to the sources in code-point order, null last. All sizes are shared out by
    weight; a source stops at cap times its size and the excess goes to the others. Capped
    sources are those first in order of cap * size / weight, so running sums find them.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = sizes.withColumn("w", w.cast("long")).withColumn("most", F.col("source_size") * cap)
    fill = Window.orderBy(F.col("most") / F.col("w"), F.col("source").asc_nulls_last())
    upto = fill.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    total, weight = F.sum("source_size").over(whole), F.sum("w").over(whole)
    left = total - F.coalesce(F.sum("most").over(upto), F.lit(0))
    share = weight - F.coalesce(F.sum("w").over(upto), F.lit(0))
    ranked = ranked.withColumn("left", left).withColumn("share", share)
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    free = wide("most") * wide("share") > wide("left") * wide("w")
    first = F.min(F.when(free, F.struct(F.col("most") / F.col("w"), "source", "left", "share"))).over(whole)
    ranked = ranked.withColumn("first", first).withColumn("free", free)
    target = F.when(F.col("free"), F.col("first.left") * F.col("w") / F.col("first.share")).otherwise(F.col("most").cast("double"))
    return ranked.select("source", "source_size", target.alias("target"))


def _bucket(level: int) -> Column:
    return F.shiftright("h", STEP * (LEVELS - 1 - level))


def thresholds(rows: DataFrame, aims: DataFrame) -> DataFrame:
    """source, source_size, target, repeats, cut, more: a row is taken repeats times, and once more
    if h < cut or it is one of the first `more` rows of h = cut.

    rows have source (null-free key), size and h; aims come from targets(). The row at the
    edge is taken if that brings the source nearer to its target.
    """
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    state = aims.withColumn("repeats", F.least(whole, F.lit(MAX_REPEATS)).cast("long"))
    state = state.withColumn("budget", F.col("target") - F.col("repeats") * F.col("source_size"))
    state = state.withColumn("prefix", F.lit(0).cast("long")).withColumn("below", F.lit(0).cast("long"))
    state = materialize(state, "mix-state")
    rows = rows.where("size > 0")
    for level in range(LEVELS):
        edge = state.select("source", "prefix")
        if level:
            rows_in = rows.withColumn("prefix", _bucket(level - 1)).join(small(edge, BROADCAST_SOURCES), ["source", "prefix"], "left_semi")
        else:
            rows_in = rows
        sums = rows_in.groupBy("source", _bucket(level).alias("b")).agg(F.sum("size").alias("s"), F.min("h").alias("lo"), F.max("h").alias("hi"))
        run = F.sum("s").over(Window.partitionBy("source").orderBy("b"))
        found = sums.withColumn("run", run).join(state.select("source", "budget", "below"), "source")
        # the first bucket with which the budget is passed
        over = found.where(F.col("below") + F.col("run") > F.col("budget"))
        over = over.groupBy("source").agg(F.min(F.struct("b", F.col("run").alias("upto"), "s", "lo", "hi")).alias("hit"))
        new = state.join(over, "source", "left")
        taken = F.col("below") + F.col("hit.upto") - F.col("hit.s")
        last = F.when(F.col("hit").isNull(), F.col("prefix")).otherwise(F.col("hit.b"))
        new = new.select("source", "source_size", "target", "repeats", "budget", last.alias("prefix"), F.when(F.col("hit").isNull(), F.col("below")).otherwise(taken).alias("below"), F.col("hit.s").alias("edge_size"), F.col("hit.lo").alias("lo"), F.col("hit.hi").alias("hi"))
        old, state = state, materialize(new, "mix-state")
        discard(old)
        if state.where("lo < hi").isEmpty():  # every edge is a single hash
            break
    # the edge is one hash (or the budget is never passed): how many of its rows, all of one size, are taken
    miss = F.col("budget") - F.col("below")
    edge = state.join(edge_rows(rows, state), "source", "left")
    more = F.ceil(miss / F.col("row_size") - F.lit(0.5)).cast("long")
    more = F.when(F.col("edge_size").isNull(), F.lit(0)).otherwise(F.greatest(F.lit(0), F.least(more, F.col("edge_rows"))))
    cut = F.when(F.col("edge_size").isNull(), F.lit(1 << 60)).otherwise(F.col("lo"))
    # as many as the edge has: all below the next hash, without numbering
    full = more == F.col("edge_rows")
    cut, more = F.when(full, cut + 1).otherwise(cut), F.when(full, F.lit(0)).otherwise(more)
    return materialize(edge.select("source", "source_size", "target", "repeats", cut.cast("long").alias("cut"), F.coalesce(more, F.lit(0)).cast("long").alias("more")), "mix-cuts")


def edge_rows(rows: DataFrame, state: DataFrame) -> DataFrame:
    """source, edge_rows, row_size: the rows of each source that have its edge's hash."""
    at = state.select("source", F.col("lo").alias("h")).where("h IS NOT NULL")
    return rows.join(small(at, BROADCAST_SOURCES), ["source", "h"], "left_semi").groupBy("source").agg(F.count("*").alias("edge_rows"), F.max("size").alias("row_size"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """All columns of docs plus size, source_size, target, taken (long, long, double, long).

    taken is size times the repeats of the row: 0 to 3. Each source's taken words differ from
    its target by at most half of the size of its row at the edge. Rows of equal id and text
    at the edge go by their other columns, then, if equal in all, by number: rows that equal
    each other stay unequal in taken only there. A null source is one source, the last. Null
    and blank texts have size 0, and a source of size 0 gets target 0. Columns of those names
    are replaced. Empty input gives an empty result. Reruns take the same rows.
    """
    docs = docs.drop("size", "source_size", "target", "taken")
    text = col(text_col).cast("string")
    # a null-free key: null sources sort last and don't equal any text
    name = col(source_col).cast("string")
    source = F.struct(name.isNull().alias("none"), F.coalesce(name, F.lit("")).alias("name"))
    h = row_hash(col(id_col), text)
    flat = materialize(docs.select(source.alias("source"), n_words(text).alias("size"), h.alias("h")), "mix-rows")
    cuts = thresholds(flat, targets(flat.groupBy("source").agg(F.sum("size").alias("source_size"))))
    discard(flat)
    # the columns of docs travel as one struct, so no name of theirs can clash
    row = F.struct(*(col(c).alias(f"c{k}") for k, c in enumerate(docs.columns)))
    sized = docs.select(row.alias("row"), source.alias("source"), n_words(text).alias("size"), h.alias("h")).join(small(cuts, BROADCAST_SOURCES), "source")
    extra = (F.col("h") < F.col("cut")).cast("int")
    out = sized.withColumn("extra", extra)
    split = cuts.where("more > 0")
    if not split.isEmpty():
        tied = (F.col("h") == F.col("cut")) & (F.col("more") > 0) & (F.col("size") > 0)
        # equal rows are folded before they are numbered, and unfolded again
        same = sized.where(tied).groupBy(*sized.columns).agg(F.count("*").alias("copies"))
        upto = F.sum("copies").over(Window.partitionBy("source").orderBy(F.to_json("row"), F.xxhash64("row")))
        same = same.withColumn("first", F.greatest(F.lit(0), F.least(F.col("copies"), F.col("more") - (upto - F.col("copies")))))
        parts = F.array(F.struct(F.lit(1).alias("extra"), F.col("first").alias("n")), F.struct(F.lit(0).alias("extra"), (F.col("copies") - F.col("first")).alias("n")))
        same = same.withColumn("part", F.explode(parts)).where("part.n > 0")
        same = same.withColumn("k", F.explode(F.sequence(F.lit(1).cast("long"), F.col("part.n")))).select(*sized.columns, "part.extra")
        out = out.where(~tied).unionByName(same)
    taken = F.col("size") * F.least(F.col("repeats") + F.col("extra"), F.lit(MAX_REPEATS))
    return out.select(*(F.col(f"row.c{k}").alias(c) for k, c in enumerate(docs.columns)), "size", "source_size", "target", taken.alias("taken"))
