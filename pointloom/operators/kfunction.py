"""K and L functions: space, space-time, cross and local.

Points -> pairs within the largest distance -> weights -> one bin per pair (the first
threshold that admits it) -> sums per bin -> running sums over thresholds -> K -> L.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.shared import with_translation_weight
from ..functions.timeunits import Unit, clock, clock_distance, free_units, shift
from ..functions.weights import boundary_distance, free_weight, one_edge_weight, polygon_distance, polygon_distances, polygon_weight, translation_weight, with_rectangle_weight
from ..sources.boundary import Rectangle, Region
from ..sources.points import fold
from .pairs import distance_join, parts_of, st_join


@dataclass(frozen=True)
class Scale:
    """Largest distances R (and T units) with S (and U) thresholds up to them."""

    R: float
    S: int
    T: int = 0
    U: int = 1
    unit: str = "DAYS"

    def __post_init__(self):
        if self.R <= 0 or self.S < 1 or self.T < 0 or self.U < 1:
            raise ValueError("distances and step counts must be positive")
        if self.T % self.U:
            raise ValueError("T must be a multiple of U")
        Unit.of(self.unit)

    @property
    def step(self) -> float:
        return self.R / self.S

    @property
    def lag(self) -> int:
        return self.T // self.U


def space_bin(scale: Scale, d: Column) -> Column:
    """The least i from 1 with d <= step * i, by that very comparison."""
    i = F.greatest(F.ceil(d / scale.step), F.lit(1)).cast("int")
    i = F.when(d > scale.step * i, i + 1).when((i > 1) & (d <= scale.step * (i - 1)), i - 1).otherwise(i)
    return i


def time_bin(scale: Scale, tau: Column) -> Column:
    """The least j from 1 with tau <= lag * j (whole numbers)."""
    return F.greatest(F.ceil(tau / F.lit(scale.lag)), F.lit(1)).cast("int") if scale.lag else F.lit(1)


def timed(points: DataFrame, scale: Scale) -> DataFrame:
    """points with the clock of their time: worked out once a point, not once a pair."""
    return points.withColumn("clock", clock(scale.unit, F.col("t")))


def with_free(points: DataFrame, region: Region, scale: Scale) -> DataFrame:
    """points with free, the units up to T that they are inside the region's interval."""
    t0, t1 = (F.lit(t).cast("timestamp_ntz") for t in (region.t0, region.t1))
    return points.withColumn("free", free_units(scale.unit, F.col("t"), t0, t1, scale.T))


def tau_of(scale: Scale) -> Column:
    """Distance in time of the pairs of timed() points."""
    return clock_distance(scale.unit, F.col("clock_a"), F.col("clock_b"))


def weigh(pairs: DataFrame, region: Region, correction: str = "isotropic", reach: float | None = None) -> DataFrame:
    """Add the spatial weight w of pairs (a, b).

    Pairs whose circle lies in the region by the centre's distance to the boundary, or meets no edge but the nearest, have
    a closed form (polygons: columns edge_a and second_a). reach is the largest distance of a pair. Corrections:
    isotropic, translation, none; border is a choice of centres, see border_space() and border_st().
    """
    x, y, d = F.col("x_a"), F.col("y_a"), F.col("d")
    if correction == "none":
        return pairs.withColumn("w", F.lit(1.0))
    if correction == "translation":
        if isinstance(region, Rectangle):
            return pairs.withColumn("w", translation_weight(region, F.col("x_b") - x, F.col("y_b") - y))
        return with_translation_weight(pairs, region, reach)
    if correction != "isotropic":
        raise ValueError(f"no such correction: {correction}")
    if isinstance(region, Rectangle):
        return with_rectangle_weight(pairs, region, "x_a", "y_a", "d")
    plain = (F.col("edge_a") > 0) & (d <= F.col("second_a"))
    cut = polygon_weight(pairs.sparkSession, region, reach)(x, y, F.when(~plain, d))
    return pairs.withColumn("w", F.when(plain, one_edge_weight(F.col("edge_a"), d)).otherwise(cut))


def weighed_pairs(left: DataFrame, right: DataFrame, region: Region, join: Callable[[DataFrame, DataFrame], DataFrame], reach: float, correction: str = "isotropic") -> DataFrame:
    """Pairs that join finds, at most reach apart, with their spatial weight w.

    In a polygon the centres with one edge at most within reach are joined apart: their weights have a closed form, and their
    pairs never leave the JVM. Only pairs of centres near corners, between edges or outside go through Arrow.
    """
    if isinstance(region, Rectangle) or correction != "isotropic":
        return weigh(join(left, right), region, correction, reach)
    near = polygon_distances(left.sparkSession, region, reach)(F.col("x"), F.col("y"))
    sites = left.withColumn("near", near).select(*left.columns, "near.edge", "near.second")
    alone = (F.col("edge") > 0) & (F.col("second") >= reach)
    plain = join(sites.where(alone), right)
    plain = plain.withColumn("w", one_edge_weight(F.col("edge_a"), F.col("d")))
    return plain.unionByName(weigh(join(sites.where(~alone), right), region, correction, reach))


def _run(df: DataFrame, value: str, along: str, *within: str) -> Column:
    return F.sum(value).over(Window.partitionBy(*within).orderBy(along).rowsBetween(Window.unboundedPreceding, 0))


def space_sums(left: DataFrame, right: DataFrame, region: Region, scale: Scale, correction: str = "isotropic") -> DataFrame:
    """Pairs and weighted sums per threshold: i, d, pairs, sigma, for every i from 1 to S.

    Sides are folded to distinct places first, with multiplicities.
    """
    near = lambda a, b: distance_join(a, b, scale.R)
    pairs = weighed_pairs(fold(left, "x", "y"), fold(right, "x", "y"), region, near, scale.R, correction)
    both = F.col("cnt_a") * F.col("cnt_b")
    binned = pairs.groupBy(space_bin(scale, F.col("d")).alias("i")).agg(F.sum(both).alias("pairs"), F.sum(F.col("w") * both).alias("sigma"))
    return cumulate_space(binned, scale)


def space_grid(spark: SparkSession, scale: Scale) -> DataFrame:
    return spark.range(1).select(F.explode(F.sequence(F.lit(1), F.lit(scale.S))).alias("i"))


def _upto(n: int) -> Column:
    return F.sequence(F.lit(1), F.lit(n))


def _with_zeros(cells: DataFrame, within: tuple[str, ...], zeros: Column) -> DataFrame:
    """cells and, for each of their groups, those of the array zeros that it lacks.

    A join with the groups' list would find all pairs of points once more to get that list.
    """
    names = [c for c in cells.columns if c not in within]
    per = cells.groupBy(*within).agg(F.collect_list(F.struct(*names)).alias("held"))
    every = per.select(*within, F.explode(F.concat("held", zeros.cast(per.schema["held"].dataType))).alias("c")).select(*within, "c.*")
    keys, sums = [c for c in names if c in ("i", "j")], [c for c in names if c not in ("i", "j")]
    return every.groupBy(*within, *keys).agg(*(F.sum(c).alias(c) for c in sums))


def cumulate_space(binned: DataFrame, scale: Scale, *within: str) -> DataFrame:
    """Running sums of binned (i, pairs, sigma) over all thresholds, empty ones included."""
    kept = binned.where(F.col("i") <= scale.S)
    if within:
        full = _with_zeros(kept, within, F.transform(_upto(scale.S), lambda i: F.struct(i.alias("i"), F.lit(0).cast("bigint").alias("pairs"), F.lit(0.0).alias("sigma"))))
    else:
        full = space_grid(binned.sparkSession, scale).join(kept, "i", "left").fillna({"pairs": 0, "sigma": 0.0})
    return full.select(*within, "i", (scale.step * F.col("i")).alias("d"), _run(full, "pairs", "i", *within).alias("pairs"), _run(full, "sigma", "i", *within).alias("sigma"))


def l_space(k: Column, d: Column) -> Column:
    """L - d; null where K is negative."""
    return F.when(k >= 0, F.sqrt(k / math.pi) - d)


def space_k(points: DataFrame, region: Region, scale: Scale, n: int | None = None, correction: str = "isotropic") -> DataFrame:
    """i, d, pairs, sigma, k, l of a pattern; n is its raw count (duplicates included)."""
    n = _count(points) if n is None else n
    lam = n / region.area if region.area else n
    sums = space_sums(points, points, region, scale, correction)
    k = (F.col("sigma") - n) / (n * lam) if n else F.lit(0.0)
    return sums.withColumn("k", k).withColumn("l", l_space(F.col("k"), F.col("d")))


def _count(points: DataFrame) -> int:
    if "cnt" in points.columns:
        return points.agg(F.sum("cnt")).first()[0] or 0
    return points.count()


def _border_sites(points: DataFrame, region: Region, scale: Scale, *places: str) -> DataFrame:
    """Distinct places with hi, the last threshold that is no farther than the boundary; outside: below 0."""
    sites = fold(points, *places)
    x, y = F.col("x"), F.col("y")
    edge = boundary_distance(region, x, y) if isinstance(region, Rectangle) else polygon_distance(points.sparkSession, region, scale.R)(x, y)
    return sites.withColumn("edge", edge).withColumn("hi", F.least(F.floor(F.col("edge") / scale.step), F.lit(scale.S)).cast("int"))


def border_space(points: DataFrame, region: Region, scale: Scale) -> DataFrame:
    """K and L with the border correction: per threshold only centres at least d inside count.

    i, d, pairs, centres, k, l for every i from 1 to S; k and l are null where no centre counts.
    """
    n = _count(points)
    sites = _border_sites(points, region, scale, "x", "y")
    pairs = distance_join(sites.where("hi >= 1"), fold(points, "x", "y"), scale.R)
    grid = space_grid(points.sparkSession, scale).withColumn("d", scale.step * F.col("i"))
    # a pair counts for thresholds from its distance up to the centre's distance to the border
    kept = pairs.select((F.col("cnt_a") * F.col("cnt_b")).alias("c"), space_bin(scale, F.col("d")).alias("lo"), F.col("hi_a").alias("hi")).where("lo <= hi")
    # two changes a pair, whatever the number of thresholds; running sums give the counts
    steps = F.explode(F.array(F.struct(F.col("lo").alias("i"), F.col("c").alias("c")), F.struct((F.col("hi") + 1).alias("i"), (-F.col("c")).alias("c"))))
    many = kept.select(steps.alias("s")).groupBy("s.i").agg(F.sum("s.c").alias("pairs"))
    centres = sites.where("hi >= 1").select("cnt", F.explode(F.sequence(F.lit(1), "hi")).alias("i")).groupBy("i").agg(F.sum("cnt").alias("centres"))
    lam = n / region.area
    full = grid.join(many, "i", "left").join(centres, "i", "left").fillna(0, ["pairs", "centres"])
    full = full.withColumn("pairs", _run(full, "pairs", "i"))
    k = F.when(F.col("centres") > 0, (F.col("pairs") - F.col("centres")) / (F.col("centres") * lam))
    return full.withColumn("k", k).withColumn("l", l_space(F.col("k"), F.col("d")))


def border_st(points: DataFrame, region: Region, scale: Scale) -> DataFrame:
    """K and L over distance and time with the border correction.

    A centre counts for thresholds (d, tau) if it lies at least d inside the region and its time at
    least tau from both ends of the interval. i, j, d, tau, pairs, centres, k, l for all i
    from 1 to S and j from 1 to U; k and l are null where no centre counts.
    """
    n = _count(points)
    volume = region.volume(scale.unit)
    t0, t1 = (F.lit(t).cast("timestamp_ntz") for t in (region.t0, region.t1))
    lag = lambda j: j.cast("bigint") * F.lit(scale.lag)
    fits = lambda j: (shift(scale.unit, F.col("t"), -lag(j)) >= t0) & (shift(scale.unit, F.col("t"), lag(j)) <= t1)
    sites = _border_sites(points, region, scale, "x", "y", "t").where("hi >= 1")
    sites = sites.withColumn("late", F.size(F.filter(F.sequence(F.lit(1), F.lit(scale.U)), fits))).where("late >= 1")
    pairs = st_join(timed(sites, scale), timed(fold(points, "x", "y", "t"), scale), scale.R, scale.T, scale.unit)
    kept = pairs.select((F.col("cnt_a") * F.col("cnt_b")).alias("c"), space_bin(scale, F.col("d")).alias("i0"), F.col("hi_a").alias("i1"), time_bin(scale, tau_of(scale)).alias("j0"), F.col("late_a").alias("j1"))
    kept = kept.where("i0 <= i1 AND j0 <= j1")
    # four changes a pair, at the corners of its block of thresholds; running sums along both axes give the counts
    corner = lambda i, j, sign: F.struct(i.alias("i"), j.alias("j"), (F.col("c") * sign).alias("c"))
    low, high = (F.col("i0"), F.col("j0")), (F.col("i1") + 1, F.col("j1") + 1)
    changes = F.array(corner(low[0], low[1], 1), corner(high[0], low[1], -1), corner(low[0], high[1], -1), corner(high[0], high[1], 1))
    many = kept.select(F.explode(changes).alias("s")).groupBy("s.i", "s.j").agg(F.sum("s.c").cast("double").alias("sigma"))
    full = cumulate_st(many, scale).withColumn("pairs", F.col("sigma").cast("bigint")).drop("sigma")
    block = sites.groupBy("hi", "late").agg(F.sum("cnt").alias("cnt"))
    block = block.select("cnt", "late", F.explode(F.sequence(F.lit(1), "hi")).alias("i")).select("cnt", "i", F.explode(F.sequence(F.lit(1), "late")).alias("j"))
    centres = block.groupBy("i", "j").agg(F.sum("cnt").alias("centres"))
    full = full.join(centres, ["i", "j"], "left").fillna(0, ["centres"])
    lam = n / volume if volume else n
    k = F.when(F.col("centres") > 0, (F.col("pairs") - F.col("centres")) / (F.col("centres") * lam))
    return full.withColumn("k", k).withColumn("l", l_st(F.col("k"), F.col("d"), F.col("tau")))


def st_sums(points: DataFrame, region: Region, scale: Scale, correction: str = "isotropic") -> DataFrame:
    """Weighted sums per cell: i, j, d, tau, sigma, for all i from 1 to S and j from 1 to U."""
    sites = timed(fold(points, "x", "y", "t"), scale)
    pairs = weighed_pairs(with_free(sites, region, scale), sites, region, lambda a, b: st_join(a, b, scale.R, scale.T, scale.unit), scale.R, correction)
    value = F.col("w") * free_weight(F.col("tau"), F.col("free_a")) * F.col("cnt_a") * F.col("cnt_b")
    cells = pairs.withColumn("tau", tau_of(scale)).groupBy(space_bin(scale, F.col("d")).alias("i"), time_bin(scale, F.col("tau")).alias("j")).agg(F.sum(value).alias("sigma"))
    return cumulate_st(cells, scale)


def cumulate_st(cells: DataFrame, scale: Scale, *within: str) -> DataFrame:
    """Running sums of cells (i, j, sigma) along both axes, over the full grid."""
    kept = cells.where((F.col("i") <= scale.S) & (F.col("j") <= scale.U))
    if within:
        row = lambda i: F.transform(_upto(scale.U), lambda j: F.struct(i.alias("i"), j.alias("j"), F.lit(0.0).alias("sigma")))
        full = _with_zeros(kept, within, F.flatten(F.transform(_upto(scale.S), row)))
    else:
        grid = space_grid(cells.sparkSession, scale).withColumn("j", F.explode(_upto(scale.U)))
        full = grid.join(kept, ["i", "j"], "left").fillna({"sigma": 0.0})
    full = full.withColumn("sigma", _run(full, "sigma", "i", *within, "j"))
    full = full.withColumn("sigma", _run(full, "sigma", "j", *within, "i"))
    return full.select(*within, "i", "j", (scale.step * F.col("i")).alias("d"), (F.lit(scale.lag).cast("bigint") * F.col("j")).alias("tau"), "sigma")


def l_st(k: Column, d: Column, tau: Column) -> Column:
    return F.when((k >= 0) & (tau > 0), F.sqrt(k / (2 * math.pi * tau)) - d)


def st_k(points: DataFrame, region: Region, scale: Scale, n: int | None = None, correction: str = "isotropic") -> DataFrame:
    """i, j, d, tau, sigma, k, l of a pattern over distance and time thresholds."""
    n = _count(points) if n is None else n
    volume = region.volume(scale.unit)
    lam = n / volume if volume else n
    k = (F.col("sigma") - n) / (n * lam) if n else F.lit(0.0)
    return st_sums(points, region, scale, correction).withColumn("k", k).withColumn("l", l_st(F.col("k"), F.col("d"), F.col("tau")))


def cross_k(first: DataFrame, second: DataFrame, region: Region, scale: Scale, correction: str = "isotropic") -> DataFrame:
    """i, d, pairs, sigma, k, l between two patterns: area * sigma / (n1 * n2), without self pairs."""
    n1, n2 = _count(first), _count(second)
    sums = space_sums(first, second, region, scale, correction)
    k = F.col("sigma") * (region.area / (n1 * n2)) if n1 and n2 else F.lit(0.0)
    return sums.withColumn("k", k).withColumn("l", l_space(F.col("k"), F.col("d")))


def local_k(points: DataFrame, region: Region, scale: Scale, include_self: bool = True, correction: str = "isotropic") -> DataFrame:
    """pid, x, y, i, d, sigma, l per point: sqrt(area / n * sum of its weights / pi) - d.

    An empty pattern gives an empty result.
    """
    n = _count(points)
    kept = points.select("pid", "x", "y", *(["cnt"] if "cnt" in points.columns else []))
    right = kept if "cnt" in kept.columns else kept.withColumn("cnt", F.lit(1))
    pairs = weighed_pairs(kept.select("pid", "x", "y"), right, region, lambda a, b: distance_join(a, b, scale.R, part=True), scale.R, correction)
    if not include_self:
        pairs = pairs.withColumn("cnt_b", F.col("cnt_b") - (F.col("pid_a") == F.col("pid_b")).cast("int"))
    bins = pairs.groupBy("part", F.col("pid_a").alias("pid"), F.col("x_a").alias("x"), F.col("y_a").alias("y"), space_bin(scale, F.col("d")).alias("i"))
    bins = bins.agg(F.sum(F.col("w") * F.col("cnt_b")).alias("sigma"))
    # summed where the pairs are, then dealt once, to as many tasks as the rows need
    bins = bins.repartition(parts_of(points.sparkSession, n * scale.S), "pid", "x", "y").groupBy("pid", "x", "y", "i").agg(F.sum("sigma").alias("sigma"))
    # the thresholds of one point are one array: no join back and no window over all points
    per = bins.groupBy("pid", "x", "y").agg(F.collect_list(F.struct("i", "sigma")).alias("bins"))
    upto = F.aggregate(F.filter("bins", lambda b: b["i"] <= F.col("i")), F.lit(0.0), lambda s, b: s + b["sigma"])
    out = per.withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(scale.S)))).withColumn("sigma", upto).withColumn("d", scale.step * F.col("i"))
    return out.select("pid", "x", "y", "i", "d", "sigma", (F.sqrt((region.area / n if n else 0.0) * F.col("sigma") / math.pi) - F.col("d")).alias("l"))


def count_global(pairs: DataFrame) -> DataFrame:
    """Number of pairs of the whole pattern, summed from the counts per point."""
    return pairs.groupBy("pid_a").agg(F.count("*").alias("n")).agg(F.sum("n").alias("total"), F.count("*").alias("points"))
