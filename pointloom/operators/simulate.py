"""Simulated patterns and envelopes: all simulations are one plan with a sim column.

Draws are hashes of the simulation and the row, so they repeat on every run and engine.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.timeunits import Unit, clock_distance, day_of, distance, micros, shift, unit_micros
from ..functions.weights import free_weight, polygon_distance, temporal_weight
from ..sources.boundary import Rectangle, Region
from .kfunction import Scale, cumulate_space, cumulate_st, l_space, l_st, space_bin, tau_of, time_bin, timed, weighed_pairs, with_free
from .pairs import distance_join, slots, st_join


#: Simulations whose draws travel with the points at once. More go in blocks, each with a join of its own,
#: so a row of a shuffle has this many values at most.
BLOCK_SIMS = 100


def _md5(*parts):
    return F.md5(F.concat_ws("|", *(p.cast("string") for p in parts)))


def _numbers(sims: int, first: int = 1):
    """Array of sims numbers from first on, empty for none."""
    return F.sequence(F.lit(first), F.lit(first + sims - 1)) if sims else F.array().cast("array<int>")


def _sims(df: DataFrame, sims: int, first: int = 1) -> DataFrame:
    return df.withColumn("sim", F.explode(_numbers(sims, first)))


def _in_blocks(sims: int, sums: Callable[[int, int], DataFrame]) -> DataFrame:
    """Union of sums(first, number of simulations) over blocks of simulations."""
    return reduce(DataFrame.unionByName, [sums(k, min(BLOCK_SIMS, sims + 1 - k)) for k in range(1, max(1, sims) + 1, BLOCK_SIMS)])


def _draw(digest, first: int, digits: int = 8):
    """Unsigned number of so many hexadecimal digits of a digest, 15 at most, as a bigint."""
    return F.conv(F.substring(digest, first, digits), 16, 10).cast("bigint")


def permuted_times(points: DataFrame, sims: int, first: int = 1) -> DataFrame:
    """(sim, pid, t): per simulation, numbered from first on, the same times, dealt anew to the points."""
    place = slots(points.select("pid"), _md5(F.lit("place"), F.col("pid")))
    times = slots(_sims(points.select(F.col("pid").alias("from"), "t"), sims, first), _md5(F.col("sim"), F.col("from")), "sim")
    return times.select("sim", "slot", "t").join(place, "slot").select("sim", "pid", "t")


def bootstrap(points: DataFrame, sims: int, n: int | None = None, size: int | None = None, first: int = 1) -> DataFrame:
    """(sim, pid, cnt): n draws with replacement from the points, per simulation, numbered from first on.

    size is the number of the points, counted if it isn't given; n is as many if it isn't.
    """
    place = slots(points.select("pid"), _md5(F.lit("place"), F.col("pid")))
    size = points.count() if size is None else size
    n = size if n is None else n
    if not size:
        return place.select(F.lit(1).alias("sim"), "pid", F.lit(0).cast("bigint").alias("cnt")).where("false")
    spark = points.sparkSession
    draws = _sims(spark.range(n).withColumnRenamed("id", "k"), sims, first)
    drawn = draws.groupBy("sim", (_draw(_md5(F.lit("draw"), F.col("sim"), F.col("k")), 1, 15) % size + 1).alias("slot")).agg(F.count("*").alias("cnt"))
    return drawn.join(place, "slot").select("sim", "pid", "cnt")


def monte_carlo(spark: SparkSession, region: Region, n: int, sims: int, spare: float = 3.0, name: str = "csr") -> DataFrame:
    """(sim, pid, x, y, t): n uniform points of the region per simulation (complete randomness).

    t, in whole seconds from the region's begin, is there if the region has a time interval. Patterns of
    different names are drawn apart. For polygons more candidates are drawn in its rectangle, by the ratio of the areas with
    some to spare, and the first n inside stay; if a simulation has fewer, twice as many are drawn.
    """
    box = region if isinstance(region, Rectangle) else region.rectangle()
    many = n if region is box else int(n * box.area / region.area * spare) + 64
    while True:
        drawn = _sims(spark.range(many).withColumnRenamed("id", "pid"), sims)
        key = _md5(F.lit(name), F.col("sim"), F.col("pid"))
        unit = lambda first: (_draw(key, first) + F.lit(0.5)) / F.lit(float(1 << 32))
        drawn = drawn.withColumns({"x": box.x0 + (box.x1 - box.x0) * unit(1), "y": box.y0 + (box.y1 - box.y0) * unit(9)})
        if region.t0 is not None:
            later = F.floor(int((region.t1 - region.t0).total_seconds()) * unit(17)).cast("decimal(18,6)")
            drawn = drawn.withColumn("t", F.lit(region.t0).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), later))
        if region is box:
            break
        drawn = drawn.where(polygon_distance(spark, region)(F.col("x"), F.col("y")) > 0)
        if drawn.groupBy("sim").count().where(F.col("count") >= n).count() == sims or not n:
            drawn = slots(drawn, key, "sim").where(F.col("slot") <= n).drop("slot")
            break
        many *= 2
    return drawn.select("sim", "pid", "x", "y", *(["t"] if region.t0 is not None else []))


def _per_point(points: DataFrame, drawn: DataFrame, value: str, sims: int, first: int, other=None) -> DataFrame:
    """points (pid, x, y) with one array, value per simulation; other, or null, stands where a point wasn't drawn."""
    held = F.map_from_entries(F.collect_list(F.struct("sim", value)))
    per = drawn.groupBy("pid").agg(held.alias("held"))
    both = points.select("pid", "x", "y").join(per, "pid", "left")  # to count the points, no draws are needed
    pick = lambda k: F.coalesce(F.try_element_at("held", k), other) if other is not None else F.try_element_at("held", k)
    return both.select("pid", "x", "y", F.transform(_numbers(sims, first), pick).alias("drawn"))


def simulated_pairs(left: DataFrame, right: DataFrame, region: Region, scale: Scale, first: int) -> DataFrame:
    """(pid_a, x_a, y_a, sim, i, w, a, b): each pair within R by simulation, with both points' draws.

    Places and weights are found once for all simulations of a block, which begins with first: the draws travel with the points, and
    the simulations of a pair are rows only within the task that sums them up.
    """
    pairs = weighed_pairs(left, right, region, lambda a, b: distance_join(a, b, scale.R), scale.R)
    kept = pairs.select("pid_a", "x_a", "y_a", space_bin(scale, F.col("d")).alias("i"), "w", "drawn_b", F.posexplode("drawn_a").alias("k", "a"))
    return kept.select("pid_a", "x_a", "y_a", (F.col("k") + first).alias("sim"), "i", "w", "a", F.get("drawn_b", F.col("k")).alias("b"))


def _envelope(curves: DataFrame, *cell: str) -> DataFrame:
    return curves.groupBy(*cell).agg(F.min("l").alias("l_min"), F.max("l").alias("l_max"))


def _bootstrapped(points: DataFrame, size: int, first: int, sims: int) -> DataFrame:
    """points with the times that each is drawn per simulation, as 32-bit numbers."""
    per = _per_point(points, bootstrap(points, sims, size, size, first), "cnt", sims, first, F.lit(0).cast("bigint"))
    return per.withColumn("drawn", F.col("drawn").cast("array<int>"))


def _space_curves(left: DataFrame, right: DataFrame, sizes: tuple[int, int], region: Region, scale: Scale, sims: int) -> DataFrame:
    """Sums per simulation; a pattern drawn with itself is drawn once."""

    def sums(first: int, many: int) -> DataFrame:
        a = _bootstrapped(left, sizes[0], first, many)
        b = a if right is left else _bootstrapped(right, sizes[1], first, many)
        both = simulated_pairs(a, b, region, scale, first).where("a > 0 AND b > 0")
        c = F.col("a").cast("bigint") * F.col("b")
        return both.groupBy("sim", "i").agg(F.sum(c).alias("pairs"), F.sum(F.col("w") * c).alias("sigma"))

    return cumulate_space(_in_blocks(sims, sums), scale, "sim")


def space_envelope(points: DataFrame, region: Region, scale: Scale, sims: int) -> DataFrame:
    """i, d, l_min, l_max of bootstrap patterns; no rows without simulations."""
    n = points.count()
    k = (F.col("sigma") - n) / (n * (n / region.area)) if n else F.lit(0.0)
    return _envelope(_space_curves(points, points, (n, n), region, scale, sims).withColumn("l", l_space(k, F.col("d"))), "i", "d")


def cross_envelope(first: DataFrame, second: DataFrame, region: Region, scale: Scale, sims: int) -> DataFrame:
    """i, d, l_min, l_max of cross K, both patterns bootstrapped; no rows without simulations."""
    n1, n2 = first.count(), second.count()
    sums = _space_curves(first, second, (n1, n2), region, scale, sims)
    k = F.col("sigma") * (region.area / (n1 * n2)) if n1 and n2 else F.lit(0.0)
    return _envelope(sums.withColumn("l", l_space(k, F.col("d"))), "i", "d")


def local_envelope(points: DataFrame, region: Region, scale: Scale, sims: int) -> DataFrame:
    """pid, x, y, i, d, l_min, l_max: local K of every point among bootstrapped neighbours."""
    n = points.count()

    def sums(first: int, many: int) -> DataFrame:
        drawn = _bootstrapped(points, n, first, many)
        both = simulated_pairs(drawn, drawn, region, scale, first)
        return both.groupBy("pid_a", "x_a", "y_a", "sim", "i").agg(F.sum(F.col("w") * F.col("b")).alias("sigma"))

    per = _in_blocks(sims, sums).groupBy("pid_a", "x_a", "y_a", "sim").agg(F.collect_list(F.struct("i", "sigma")).alias("bins"))
    upto = F.aggregate(F.filter("bins", lambda b: b["i"] <= F.col("i")), F.lit(0.0), lambda s, b: s + b["sigma"])
    curves = per.withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(scale.S)))).withColumns({"sigma": upto, "d": scale.step * F.col("i")})
    level = F.sqrt((region.area / n if n else 0.0) * F.col("sigma") / math.pi) - F.col("d")
    return _envelope(curves.select(F.col("pid_a").alias("pid"), F.col("x_a").alias("x"), F.col("y_a").alias("y"), "i", "d", level.alias("l")), "pid", "x", "y", "i", "d")


def st_envelope(points: DataFrame, region: Region, scale: Scale, sims: int) -> DataFrame:
    """i, j, d, tau, l_min, l_max of patterns with permuted times; no rows without simulations."""
    n = points.count()
    u, a, b = unit_micros(scale.unit), F.col("a"), F.col("b")
    if u:  # draws are microseconds: no calendar arithmetic per pair and simulation
        begin, end = micros(region.t0), micros(region.t1)
        near, reach = F.abs(b - a) <= F.lit(scale.T * u).cast("bigint"), F.col("tau") * F.lit(u).cast("bigint")
        tau = clock_distance(scale.unit, *((day_of(a), day_of(b)) if Unit.of(scale.unit) is Unit.DAYS else (a, b)))
        w_t = F.when((a < begin) | (a > end), 0.0).when((a - reach >= begin) & (a + reach <= end), 1.0).otherwise(2.0)
    else:
        t0, t1 = (F.lit(t).cast("timestamp_ntz") for t in (region.t0, region.t1))
        near, tau = (b >= shift(scale.unit, a, -scale.T)) & (b <= shift(scale.unit, a, scale.T)), distance(scale.unit, a, b)
        w_t = temporal_weight(scale.unit, a, F.col("tau"), t0, t1)

    def sums(first: int, many: int) -> DataFrame:
        dealt = permuted_times(points, many, first)
        drawn = _per_point(points, dealt.withColumn("t", micros(F.col("t"))) if u else dealt, "t", many, first)
        both = simulated_pairs(drawn, drawn, region, scale, first).where(near).withColumn("tau", tau)
        return both.groupBy("sim", "i", time_bin(scale, F.col("tau")).alias("j")).agg(F.sum(F.col("w") * w_t).alias("sigma"))

    cells = _in_blocks(sims, sums)
    volume = region.volume(scale.unit)
    k = (F.col("sigma") - n) / (n * (n / volume)) if n else F.lit(0.0)
    curves = cumulate_st(cells, scale, "sim").withColumn("l", l_st(k, F.col("d"), F.col("tau")))
    return _envelope(curves, "i", "j", "d", "tau")


def _random_curves(left: DataFrame, right: DataFrame, region: Region, scale: Scale) -> DataFrame:
    """Sums per simulation of patterns whose places differ by simulation, which is part of the grid's key."""
    pairs = weighed_pairs(left, right, region, lambda a, b: distance_join(a, b, scale.R, by=("sim",)), scale.R)
    bins = pairs.groupBy(F.col("sim_a").alias("sim"), space_bin(scale, F.col("d")).alias("i"))
    return cumulate_space(bins.agg(F.count("*").alias("pairs"), F.sum("w").alias("sigma")), scale, "sim")


def csr_envelope(spark: SparkSession, region: Region, n: int, scale: Scale, sims: int) -> DataFrame:
    """i, d, l_min, l_max of n random points of the region; no rows without simulations or points."""
    drawn = monte_carlo(spark, region, n, sims).select("sim", "x", "y")
    k = (F.col("sigma") - n) / (n * (n / region.area)) if n else F.lit(0.0)
    return _envelope(_random_curves(drawn, drawn, region, scale).withColumn("l", l_space(k, F.col("d"))), "i", "d")


def csr_cross_envelope(spark: SparkSession, region: Region, n1: int, n2: int, scale: Scale, sims: int) -> DataFrame:
    """i, d, l_min, l_max of cross K between n1 and n2 random points; no rows without simulations or pairs."""
    first, second = (monte_carlo(spark, region, n, sims, name=name).select("sim", "x", "y") for n, name in ((n1, "csr"), (n2, "csr2")))
    k = F.col("sigma") * (region.area / (n1 * n2)) if n1 and n2 else F.lit(0.0)
    return _envelope(_random_curves(first, second, region, scale).withColumn("l", l_space(k, F.col("d"))), "i", "d")


def csr_st_envelope(spark: SparkSession, region: Region, n: int, scale: Scale, sims: int) -> DataFrame:
    """i, j, d, tau, l_min, l_max of n points random in the region and its time; no rows without simulations or points."""
    if region.t0 is None:
        raise ValueError("the region needs a time interval")
    drawn = timed(monte_carlo(spark, region, n, sims).select("sim", "x", "y", "t"), scale)
    near = lambda a, b: st_join(a, b, scale.R, scale.T, scale.unit, by=("sim",))
    pairs = weighed_pairs(with_free(drawn, region, scale), drawn, region, near, scale.R).withColumn("tau", tau_of(scale))
    w_t = free_weight(F.col("tau"), F.col("free_a"))
    cells = pairs.groupBy(F.col("sim_a").alias("sim"), space_bin(scale, F.col("d")).alias("i"), time_bin(scale, F.col("tau")).alias("j"))
    sums = cumulate_st(cells.agg(F.sum(F.col("w") * w_t).alias("sigma")), scale, "sim")
    k = (F.col("sigma") - n) / (n * (n / region.volume(scale.unit))) if n else F.lit(0.0)
    return _envelope(sums.withColumn("l", l_st(k, F.col("d"), F.col("tau"))), "i", "j", "d", "tau")
