"""Cube-style counts: categorical, temporal and spatial filters, drill-downs and cross-filters."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.crs import tile_of

# Units of bucket widths in names of time bins.
SECONDS = {"d": 86400, "h": 3600, "m": 60, "s": 1}


@dataclass(frozen=True)
class Constraints:
    """Filters of a cube query; an unset one filters nothing."""

    categories: tuple[str, ...] = ()
    start: datetime | None = None
    end: datetime | None = None  # exclusive
    box: tuple[float, float, float, float] | None = None  # x0, x1, y0, y1, closed
    mask: Callable[[Column, Column], Column] | None = None  # of x and y

    def apply(self, points: DataFrame) -> DataFrame:
        if self.categories:
            points = points.where(F.col("mark").isin(*self.categories))
        if self.start is not None:
            points = points.where(F.col("t") >= F.lit(self.start).cast("timestamp_ntz"))
        if self.end is not None:
            points = points.where(F.col("t") < F.lit(self.end).cast("timestamp_ntz"))
        if self.box:
            x0, x1, y0, y1 = self.box
            points = points.where(F.col("x").between(x0, x1) & F.col("y").between(y0, y1))
        if self.mask:
            points = points.where(self.mask(F.col("x"), F.col("y")))
        return points

    def tests(self) -> dict[str, Column]:
        """What each dimension asks of a row: categories, time and space."""
        all_of = lambda parts: reduce(lambda a, b: a & b, parts, F.lit(True))
        x, y = F.col("x"), F.col("y")
        cats = [F.col("mark").isin(*self.categories)] if self.categories else []
        when = [F.col("t") >= F.lit(self.start).cast("timestamp_ntz")] if self.start is not None else []
        when += [F.col("t") < F.lit(self.end).cast("timestamp_ntz")] if self.end is not None else []
        where = [x.between(*self.box[:2]) & y.between(*self.box[2:])] if self.box else []
        where += [self.mask(x, y)] if self.mask else []
        return {"categories": all_of(cats), "time": all_of(when), "space": all_of(where)}

    def without(self, *names: str) -> Constraints:
        blank = Constraints()
        return replace(self, **{k: getattr(blank, k) for k in names})


def category_counts(points: DataFrame) -> DataFrame:
    return points.groupBy("mark").agg(F.count("*").alias("n"))


def top_categories(points: DataFrame, k: int = 25) -> DataFrame:
    """The k most frequent categories; equal counts go by name."""
    return category_counts(points).orderBy(F.desc("n"), "mark").limit(k)


def time_series(points: DataFrame, base: datetime, bucket_s: int, count: int) -> DataFrame:
    """Counts in count buckets of bucket_s seconds from base; empty buckets are left out."""
    start = int((base - datetime(1970, 1, 1)).total_seconds())
    bucket = F.floor((F.unix_seconds(F.col("t").cast("timestamp")) - start) / bucket_s).cast("bigint")
    rows = points.select(bucket.alias("bucket")).where(F.col("bucket").between(0, count - 1))
    return rows.groupBy("bucket").agg(F.count("*").alias("n"))


def time_bins(text: str) -> tuple[datetime, int]:
    """Base and bucket seconds of a name such as 2009-01-01_00:00:00_1h; widths may be joined (1d12h)."""
    fits = re.match(r"([0-9-]+)_([0-9:]+)_((?:[0-9]+[dhms])+)\Z", text)
    if not fits:
        raise ValueError(f"no such time bins: {text}")
    date, clock, width = fits.groups()
    bucket_s = sum(int(n) * SECONDS[unit] for n, unit in re.findall(r"([0-9]+)([dhms])", width))
    if not bucket_s:
        raise ValueError(f"time bins without a width: {text}")
    return datetime.fromisoformat(f"{date}T{clock}"), bucket_s


def widen(bucket_s: int, span_s: int, pixels: int) -> int:
    """The bucket width, doubled until the span fits into so many pixels."""
    while span_s > bucket_s * pixels:
        bucket_s *= 2
    return bucket_s


def total(points: DataFrame, constraints: Constraints) -> DataFrame:
    return constraints.apply(points).agg(F.count("*").alias("n"))


def time_bounds(points: DataFrame) -> DataFrame:
    return points.agg(F.min("t").alias("first"), F.max("t").alias("last"))


def bbox(vertices: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    return vertices.agg(F.min(x).alias("min_x"), F.max(x).alias("max_x"), F.min(y).alias("min_y"), F.max(y).alias("max_y"))


def tile_counts(points: DataFrame, zoom: int, depth: int = 0) -> DataFrame:
    """Counts per tile, 2 ** depth finer in each direction than the zoom level."""
    tx, ty = tile_of(F.col("lat"), F.col("lon"), zoom + depth)
    return points.groupBy(tx.alias("tile_x"), ty.alias("tile_y")).agg(F.count("*").alias("n"))


def pyramid(cube: DataFrame, finest: int, coarsest: int = 0) -> DataFrame:
    """zoom and all columns of a stored cube (tile_cube()) for every zoom from coarsest to finest.

    Counted from the cube alone: a coarser tile's key is a finer one's without its last bits, and what is
    added up is a row per tile and category, never a point.
    """
    zoom = F.explode(F.sequence(F.lit(coarsest), F.lit(finest)))
    less = lambda c: F.floor(F.col(c) / F.pow(F.lit(2.0), F.lit(finest) - F.col("zoom"))).cast("bigint")
    rows = cube.withColumn("zoom", zoom).withColumns({"tile_x": less("tile_x"), "tile_y": less("tile_y")})
    keys = ["zoom", *(c for c in cube.columns if c != "n")]
    return rows.groupBy(*keys).agg(F.sum("n").alias("n"))


def tile_cube(points: DataFrame, finest: int, *by: str) -> DataFrame:
    """tile_x, tile_y, further columns by, n: what is stored of points (lat, lon, ...) for drill-downs to the finest zoom."""
    tx, ty = tile_of(F.col("lat"), F.col("lon"), finest)
    return points.groupBy(tx.cast("bigint").alias("tile_x"), ty.cast("bigint").alias("tile_y"), *by).agg(F.count("*").alias("n"))


def merge_cubes(cube: DataFrame, more: DataFrame) -> DataFrame:
    """The cube of both cubes' points: counts of new ones are added, old points aren't read again."""
    keys = [c for c in cube.columns if c != "n"]
    return cube.unionByName(more).groupBy(*keys).agg(F.sum("n").alias("n"))


def drill_down(levels: DataFrame, zoom: int, tile_x: int, tile_y: int, depth: int) -> DataFrame:
    """Rows of a pyramid for the tiles, depth levels finer, within one tile of a zoom level."""
    inside = [(F.col(c) >= (t << depth)) & (F.col(c) < ((t + 1) << depth)) for c, t in (("tile_x", tile_x), ("tile_y", tile_y))]
    return levels.where((F.col("zoom") == zoom + depth) & inside[0] & inside[1])


def tile_stats(tiles: DataFrame) -> DataFrame:
    return tiles.agg(F.min("n").alias("min_n"), F.max("n").alias("max_n"), F.count("*").alias("tiles"))


def pivot_grid(points: DataFrame, zoom: int, marks: Sequence[str]) -> DataFrame:
    """A row per tile with a count column per category, their total and the bar height."""
    tx, ty = tile_of(F.col("lat"), F.col("lon"), zoom)
    grid = points.where(F.col("mark").isin(*marks)).groupBy(tx.alias("tile_x"), ty.alias("tile_y")).pivot("mark", list(marks)).agg(F.count("mark"))
    grid = grid.fillna(0, list(marks))
    whole = sum((F.col(m) for m in marks), F.lit(0)).cast("bigint")
    return grid.withColumn("total", whole).withColumn("height", F.sqrt("total"))


def cross_filter_table(points: DataFrame, constraints: Constraints, base: datetime, bucket_s: int, count: int) -> DataFrame:
    """chart, key, n of cross_filter()'s charts in one scan and one aggregation.

    Each row is tested once against every dimension; it goes to the charts that all other dimensions
    admit it to. What must hold in all charts, space, is left to the scan. Null categories are the key null.
    """
    start = int((base - datetime(1970, 1, 1)).total_seconds())
    bucket = F.floor((F.unix_seconds(F.col("t").cast("timestamp")) - start) / bucket_s).cast("bigint")
    ok = constraints.tests()
    chart = lambda name, key, passes: F.when(passes, F.struct(F.lit(name).alias("chart"), key.cast("string").alias("key"), F.lit(1).cast("bigint").alias("n")))
    charts = F.array(
        chart("category", F.col("mark"), ok["time"]),
        chart("series", bucket, ok["categories"] & bucket.between(0, count - 1)),
        chart("total", F.lit(""), ok["categories"] & ok["time"]),
    )
    rows = constraints.without("categories", "start", "end").apply(points).select(F.explode(F.array_compact(charts)).alias("c")).select("c.*")
    none = points.sparkSession.range(1).select(F.lit("total").alias("chart"), F.lit("").alias("key"), F.lit(0).cast("bigint").alias("n"))
    return rows.unionByName(none).groupBy("chart", "key").agg(F.sum("n").alias("n"))


def cross_filter(points: DataFrame, constraints: Constraints, base: datetime, bucket_s: int, count: int) -> dict[str, DataFrame]:
    """Each chart under all constraints but its own: categories, time series, and the total."""
    return {
        "categories": category_counts(constraints.without("categories").apply(points)),
        "series": time_series(constraints.without("start", "end").apply(points), base, bucket_s, count),
        "total": total(points, constraints),
    }
