"""Edge-correction weights kept as a table: computed at rounded centres and radii, joined by later runs.

Keys are whole multiples (kx, ky, kr) of a step. A circle's share of a rectangle then is off by at most
2.83 * sqrt(step / r): each side's distance over the radius moves by step / r at most, the arc cosine
of that by pi / sqrt(2) times its root, and four half angles count twice at most. The weight is one over the share.
A centre nearer to a rectangle's border than a step is weighed as it is, lest its rounded one lies outside.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.weights import boundary_distance, polygon_weight, with_rectangle_weight
from ..sources.boundary import Rectangle, Region
from ..sources.points import fold
from .kfunction import Scale, _count, cumulate_space, l_space, space_bin
from .pairs import distance_join, parts_of

KEYS = ["kx", "ky", "kr"]
SCHEMA = "kx bigint, ky bigint, kr bigint, w double"


def error_bound(step: float, r: Column) -> Column:
    """Most that a circle's share of a rectangle can be off."""
    return F.least(F.lit(1.0), 2.83 * F.sqrt(F.lit(step) / r))


def _rounded(c: str, step: float) -> Column:
    return F.floor(F.col(c) / step + 0.5).cast("bigint")


def keyed(pairs: DataFrame, region: Region, step: float) -> DataFrame:
    """pairs (x_a, y_a, d) with KEYS, which are null where the exact weight is needed."""
    out = pairs
    for k, c in zip(KEYS, ("x_a", "y_a", "d")):
        key = _rounded(c, step)
        if isinstance(region, Rectangle):
            key = F.when(boundary_distance(region, F.col("x_a"), F.col("y_a")) >= step, key)
        out = out.withColumn(k, key)
    return out


def _exact(places: DataFrame, region: Region, x: str, y: str, r: str) -> DataFrame:
    """places with the weight w of the circles (x, y, r); none is computed where r is null."""
    if isinstance(region, Rectangle):
        return with_rectangle_weight(places, region, x, y, r)
    return places.withColumn("w", polygon_weight(places.sparkSession, region)(F.col(x), F.col(y), F.col(r)))


def new_weights(keys: DataFrame, region: Region, step: float, table: DataFrame | None = None) -> DataFrame:
    """Table rows (KEYS, w) of the keys that the table doesn't have; each is computed once, whatever the number of its pairs."""
    todo = keys.select(*KEYS).where("kr IS NOT NULL").distinct()
    if table is not None:
        todo = todo.join(table.select(*KEYS), KEYS, "left_anti")
    at = todo.withColumns({"x": F.col("kx") * step, "y": F.col("ky") * step, "r": F.col("kr") * step})
    return _exact(at, region, "x", "y", "r").select(*KEYS, "w")


def extended(table: DataFrame | None, added: DataFrame) -> DataFrame:
    """The table for the next run; store it as Parquet, it is a row per key."""
    return added if table is None else table.select(*KEYS, "w").unionByName(added)


def weighed(pairs: DataFrame, region: Region, table: DataFrame) -> DataFrame:
    """Keyed pairs with w from the table, which must have all their keys, and exact weights where keys are null."""
    kept = pairs.where("kr IS NOT NULL").join(table, KEYS)
    rest = _exact(pairs.where("kr IS NULL"), region, "x_a", "y_a", "d")
    return kept.select(*pairs.columns, "w").unionByName(rest.select(*pairs.columns, "w"))


def hit_rates(keys: DataFrame, table: DataFrame | None = None) -> DataFrame:
    """pairs, misses (weights that had to be computed), hits and hit_percent of keyed pairs against a table; a row."""
    each = keys.groupBy(*KEYS).agg(F.count("*").alias("n"))
    if table is None:
        each = each.withColumn("known", F.lit(0))
    else:
        known = table.select(*(F.col(k).alias(f"{k}_") for k in KEYS), F.lit(1).alias("known"))
        each = each.join(known, [F.col(k) == F.col(f"{k}_") for k in KEYS], "left")
    # without a key every pair is computed
    missed = F.when(F.col("kr").isNull(), F.col("n")).when(F.col("known") == 1, 0).otherwise(1)
    got = each.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("pairs"), F.coalesce(F.sum(missed), F.lit(0)).alias("misses"))
    hits = F.col("pairs") - F.col("misses")
    return got.select("pairs", "misses", hits.alias("hits"), F.when(F.col("pairs") > 0, 100.0 * hits / F.col("pairs")).alias("hit_percent"))


def pattern_pairs(points: DataFrame, region: Region, scale: Scale, step: float, part: bool = False) -> DataFrame:
    """Keyed pairs of a pattern with itself up to the scale's largest distance, with multiplicities; part as in distance_join()."""
    sites = fold(points, "x", "y")
    return keyed(distance_join(sites, sites, scale.R, part=part), region, step)


def space_k(points: DataFrame, region: Region, scale: Scale, step: float, table: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(curve, added): kfunction.space_k() by rounded weights, and what the table lacked.

    Pairs of one key and bin are summed, first where they are found, and dealt once, by key; the table is looked up there and what
    it lacks is computed in place. extended(table, added) serves the next run. An empty
    pattern gives a curve of zeros.
    """
    n = _count(points)
    pairs = pattern_pairs(points, region, scale, step, part=True)
    added = new_weights(pairs, region, step, table)
    both = F.col("cnt_a") * F.col("cnt_b")
    loose = F.when(F.col("kr").isNull(), F.struct("x_a", "y_a", "d"))
    # rounded places deal the pairs that have no key, too
    at = [f"{k}_at" for k in KEYS]
    place = [_rounded(c, step).alias(k) for k, c in zip(at, ("x_a", "y_a", "d"))]
    bins = pairs.groupBy("part", *place, space_bin(scale, F.col("d")).alias("i"), loose.alias("own")).agg(F.sum(both).alias("many"))
    summed = bins.repartition(parts_of(points.sparkSession, n * scale.S), *at).groupBy(*at, "i", "own").agg(F.sum("many").alias("many"))
    held = F.lit(None).cast("double")
    if table is not None:
        known = table.select(*KEYS, F.col("w").alias("held"))
        same = F.col("own").isNull()
        for k, key in zip(at, KEYS):
            same &= summed[k] == known[key]
        summed, held = summed.join(known, same, "left").drop(*KEYS), F.col("held")
    own = lambda c, k: F.coalesce(F.col(f"own.{c}"), F.col(k) * step)
    todo = summed.withColumns({"x": own("x_a", at[0]), "y": own("y_a", at[1]), "r": F.when(held.isNull(), own("d", at[2]))})
    value = _exact(todo, region, "x", "y", "r").withColumn("w", F.coalesce(held, F.col("w")))
    sums = cumulate_space(value.groupBy("i").agg(F.sum("many").alias("pairs"), F.sum(F.col("w") * F.col("many")).alias("sigma")), scale)
    lam = n / region.area if region.area else n
    k = (F.col("sigma") - n) / (n * lam) if n else F.lit(0.0)
    return sums.withColumn("k", k).withColumn("l", l_space(F.col("k"), F.col("d"))), added
