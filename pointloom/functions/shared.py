"""Translation correction of polygons: the area that a region shares with its moved copy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.boundary import MultiPolygon, Polygon, Region
from .weights import MOST, _chunks, _ragged

#: Steps of the table of shared areas along one axis, up to the largest distance.
STEPS = 64
#: Edges are cut into pieces no higher than this many mean heights: at most a quarter more pieces than edges.
MOST_HEIGHTS = 4


def _oriented(region: Region) -> list[tuple[np.ndarray, int]]:
    """Rings with 1 if the region lies to their left as they run, else -1."""
    parts = region.parts if isinstance(region, MultiPolygon) else (region if isinstance(region, Polygon) else Polygon(region.rings()[0]),)
    out = []
    for part in parts:
        for k, ring in enumerate(part.rings()):
            p = np.array(ring, float)
            p -= p[0]  # small numbers: the sign survives rounding
            twice = float(np.sum(p[:-1, 0] * p[1:, 1] - p[1:, 0] * p[:-1, 1]))
            out.append((np.array(ring, float), (1 if twice > 0 else -1) * (-1 if k else 1)))
    return out


class SharedArea:
    """Area of a region within itself moved by (hx, hy), exact for concave rings, holes and several parts.

    A region is the sum over its edges of the half strips to their right, counted plus where the edge
    bounds it on the left and minus on the right. Two half strips share an infinite area, but its
    infinite part cancels around closed rings; what stays of edges e and f is the area where
    e lies to the right of the moved f. Edges that coincide after the move need no care: they share none.
    A shift costs as many steps as there are pairs of edges of overlapping heights.
    """

    def __init__(self, region: Region):
        a, b, side = [], [], []
        for ring, turn in _oriented(region):
            a.append(ring[:-1])
            b.append(ring[1:])
            side.append(-turn * np.sign(ring[1:, 1] - ring[:-1, 1]))
        p, q, s = np.concatenate(a), np.concatenate(b), np.concatenate(side)
        self.total, self.around = region.area, float(np.hypot(*(q - p).T).sum())
        p, q, s = p[s != 0], q[s != 0], s[s != 0]
        down = p[:, 1] > q[:, 1]
        p[down], q[down] = q[down], p[down].copy()
        high = q[:, 1] - p[:, 1]
        many = np.ceil(high / (MOST_HEIGHTS * high.mean())).astype(np.int64).clip(1)
        edge, k = _ragged(np.zeros(len(p), np.int64), many)
        at = lambda j: p[edge, 1] + high[edge] * (j / many[edge])
        y0, y1 = at(k), np.where(k + 1 == many[edge], q[edge, 1], at(k + 1))
        order = np.argsort(y0, kind="stable")
        self.y0, self.y1, self.side = y0[order], y1[order], s[edge][order]
        self.slope = ((q[:, 0] - p[:, 0]) / high)[edge][order]
        self.x0 = p[edge, 0][order] + (self.y0 - p[edge, 1][order]) * self.slope
        self.top = np.maximum.accumulate(self.y1)

    def __call__(self, hx: float, hy: float) -> float:
        lo, hi = self.y0 + hy, self.y1 + hy
        first = np.searchsorted(self.top, lo, "right")
        count = np.maximum(np.searchsorted(self.y0, hi, "left") - first, 0)
        total = 0.0
        for s in _chunks(count):
            f, e = _ragged(first[s], count[s])
            f += s.start
            low, high = np.maximum(self.y0[e], lo[f]), np.minimum(self.y1[e], hi[f])
            d = [self.x0[e] + (y - self.y0[e]) * self.slope[e] - self.x0[f] - hx - (y - lo[f]) * self.slope[f] for y in (low, high)]
            right = np.maximum(d[0], 0) + np.maximum(d[1], 0)
            apart = np.abs(d[1] - d[0])
            # edges that cross: a triangle, otherwise a trapezium
            share = np.where(d[0] * d[1] < 0, right / np.where(apart > 0, apart, 1), 1.0)
            total -= float(np.sum(self.side[e] * self.side[f] * np.maximum(high - low, 0) * right * share)) / 2
        return max(0.0, total)


def shared_cells(df: DataFrame, region: Region, reach: float, steps: int = STEPS) -> DataFrame:
    """Cells (ci, cj) of the shifts up to reach, upwards only, with the areas s00, s10, s01, s11 at their corners.

    2 * steps * steps rows, whatever the input. A shift and its opposite share the same area.
    """
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(SharedArea(region))  # the boundary's edges: one object of the query
    step = reach / steps

    def run(hx: pa.Array, hy: pa.Array) -> pa.Array:
        return pa.array([shared.value(x, y) for x, y in zip(hx.to_pylist(), hy.to_pylist())], pa.float64())

    wide = 2 * steps + 1
    nodes = spark.range(wide * (steps + 1)).select((F.col("id") % wide - steps).alias("i"), F.expr(f"id div {wide}").alias("j"))
    nodes = nodes.withColumn("s", F.arrow_udf(run, "double")(F.col("i") * F.lit(step), F.col("j") * F.lit(step)))
    corner = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1))))
    spread = nodes.select("*", corner.alias("c")).select((F.col("i") - F.col("c.a")).alias("ci"), (F.col("j") - F.col("c.b")).alias("cj"), "c.*", "s")
    spread = spread.where((F.col("ci") >= -steps) & (F.col("ci") < steps) & (F.col("cj") >= 0) & (F.col("cj") < steps))
    pick = lambda a, b: F.max(F.when((F.col("a") == a) & (F.col("b") == b), F.col("s"))).alias(f"s{a}{b}")
    return spread.groupBy("ci", "cj").agg(*(pick(a, b) for a in (0, 1) for b in (0, 1)))


def with_translation_weight(pairs: DataFrame, region: Region, reach: float, steps: int = STEPS) -> DataFrame:
    """Add w, the region's area over the area shared with itself moved from a to b; 100 at most.

    reach bounds the pairs' distances. Shared areas are exact at steps shifts along an axis and
    interpolated between, bilinearly: off by at most perimeter * reach / steps * sqrt(2) / 4, and
    exact for rectangles with no side below reach. The table is small whatever the input, so it is broadcast; pairs stay in the JVM.
    """
    step = F.lit(reach / steps)
    up = F.when(F.col("y_b") < F.col("y_a"), -1.0).otherwise(1.0)
    out = pairs.withColumns({"__u": up * (F.col("x_b") - F.col("x_a")) / step, "__v": up * (F.col("y_b") - F.col("y_a")) / step})
    cell = lambda c, least: F.least(F.greatest(F.floor(c), F.lit(least)), F.lit(steps - 1))
    out = out.withColumns({"ci": cell("__u", -steps), "cj": cell("__v", 0)})
    # one whole number as the key: a table of these is looked up by place, not by hash
    number = F.col("ci") * F.lit(steps) + F.col("cj")
    areas = shared_cells(pairs, region, reach, steps).select(number.alias("__cell"), "s00", "s10", "s01", "s11")
    out = out.withColumn("__cell", number).join(F.broadcast(areas), "__cell")
    u, v = F.col("__u") - F.col("ci"), F.col("__v") - F.col("cj")
    area = (1 - u) * (1 - v) * F.col("s00") + u * (1 - v) * F.col("s10") + (1 - u) * v * F.col("s01") + u * v * F.col("s11")
    out = out.withColumn("__s", area)
    w = F.when(F.col("__s") > 0, F.least(F.lit(MOST), F.lit(region.area) / F.col("__s"))).otherwise(MOST)
    return out.withColumn("w", w).drop("__cell", "ci", "cj", "__u", "__v", "__s", "s00", "s01", "s10", "s11")
