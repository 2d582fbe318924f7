"""Points stored along a Hilbert curve, so that a box reads few row groups."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.boundary import Rectangle
from .pairs import range_query

#: Cells along a side of the frame, as a power of two; a key has twice as many bits.
BITS = 16
#: Key intervals that stand for a box, at most.
INTERVALS = 64


def _cell(v, low: float, high: float, floor, least, greatest):
    """Cell of a coordinate; places beyond the frame go to its outermost cells."""
    return least(greatest(floor((v - low) / ((high - low) or 1.0) * float(1 << BITS)), 0), (1 << BITS) - 1)


def hilbert_key(frame: Rectangle, x: Column, y: Column) -> Column:
    """Place on the curve through the frame's cells of a point, as a bigint; null without coordinates.

    From the highest bit on, each step gives the quadrant's place and turns the rest of the way to it.
    """
    most = F.lit((1 << BITS) - 1).cast("bigint")
    cells = (_cell(v, lo, hi, F.floor, lambda a, b: F.least(a, F.lit(b)), lambda a, b: F.greatest(a, F.lit(b))) for v, lo, hi in ((x, frame.x0, frame.x1), (y, frame.y0, frame.y1)))
    cx, cy = (c.cast("bigint") for c in cells)
    bit = lambda v, k: F.call_function("shiftright", v, k).bitwiseAND(F.lit(1).cast("bigint"))

    def step(at, k):
        right, up = bit(at["x"], k), bit(at["y"], k)
        turned = lambda a: F.when(right == 1, most - a).otherwise(a)
        here = at["key"] * 4 + (right * 3).bitwiseXOR(up)
        return F.struct(F.when(up == 0, turned(at["y"])).otherwise(at["x"]).alias("x"), F.when(up == 0, turned(at["x"])).otherwise(at["y"]).alias("y"), here.alias("key"))

    start = F.struct(cx.alias("x"), cy.alias("y"), F.lit(0).cast("bigint").alias("key"))
    key = F.aggregate(F.sequence(F.lit(BITS - 1), F.lit(0)), start, step, lambda at: at["key"])
    return F.when(x.isNotNull() & y.isNotNull(), key)


def _key(x: int, y: int) -> int:
    """hilbert_key() of a cell, for the corners of a box's squares."""
    key, most = 0, (1 << BITS) - 1
    for k in range(BITS - 1, -1, -1):
        right, up = x >> k & 1, y >> k & 1
        key = key * 4 + (3 * right ^ up)
        if not up:
            x, y = (most - y, most - x) if right else (y, x)
    return key


def key_intervals(frame: Rectangle, x0: float, x1: float, y0: float, y1: float) -> list[tuple[int, int]]:
    """Closed intervals of keys, INTERVALS at most, that hold all points of a closed box.

    Squares that the box covers in part are split, the largest first, while there is room.
    """
    ax, bx = (_cell(v, frame.x0, frame.x1, math.floor, min, max) for v in (x0, x1))
    ay, by = (_cell(v, frame.y0, frame.y1, math.floor, min, max) for v in (y0, y1))
    if ax > bx or ay > by:
        return []
    whole, part = [], [(BITS, 0, 0)]
    while part and len(whole) + len(part) + 3 <= INTERVALS:
        level, x, y = part.pop(0)
        half = 1 << (level - 1)
        for u, v in ((x, y), (x, y + half), (x + half, y), (x + half, y + half)):
            if u > bx or v > by or u + half <= ax or v + half <= ay:
                continue
            inside = ax <= u and u + half - 1 <= bx and ay <= v and v + half - 1 <= by
            (whole if inside else part).append((level - 1, u, v))
    found = []
    for level, x, y in whole + part:
        low = _key(x, y) >> 2 * level << 2 * level
        found.append((low, low + (1 << 2 * level) - 1))
    out: list[tuple[int, int]] = []
    for low, high in sorted(found):
        if out and low == out[-1][1] + 1:
            out[-1] = (out[-1][0], high)
        else:
            out.append((low, high))
    return out


def along_curve(points: DataFrame, frame: Rectangle) -> DataFrame:
    """points with their key as column hkey.

    The key comes out of a list of one, so that a filter with many intervals reads the column and doesn't repeat the
    key's expression for each of them.
    """
    return points.withColumn("hkey", F.explode(F.array(hilbert_key(frame, F.col("x"), F.col("y")))))


def write_layout(points: DataFrame, path: str, frame: Rectangle) -> None:
    """Write points and hkey as Parquet, in the curve's order within and across files.

    Points of one place are dealt by all their columns, so that a hot place is no single file.
    """
    keyed = along_curve(points, frame)
    keyed.repartitionByRange("hkey", F.xxhash64(*points.columns)).sortWithinPartitions("hkey").write.parquet(path)


def layout_query(keyed: DataFrame, frame: Rectangle, x0: float, x1: float, y0: float, y1: float, t0=None, t1=None) -> DataFrame:
    """range_query() over points with hkey: the box's key intervals are plain comparisons that prune row groups."""
    near = F.lit(False)
    for low, high in key_intervals(frame, x0, x1, y0, y1):
        near = near | F.col("hkey").between(low, high)
    return range_query(keyed.where(near), x0, x1, y0, y1, t0, t1).drop("hkey")


def read_layout(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
