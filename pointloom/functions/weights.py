"""Edge-correction weights: how much of a circle around a point lies in the study region.

The weight is 2 pi over the angle of the circle inside, from 0 to 100. Rectangles have a
closed form in column functions; polygons are computed in Arrow batches with numpy.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.boundary import Rectangle, Region
from .timeunits import shift

MOST = 100.0
#: Inside angles up to this count as none: rounding decides there.
NO_ANGLE = 1e-12
#: Direction of the point that stands for a circle without crossings: along no usual edge's normal.
OFF_AXIS = 0.7310585
#: Elements of the largest intermediate array of the polygon weight, about.
CHUNK = 1 << 20
#: Strips of an edge index, and cells along its longer side.
MOST_STRIPS, MOST_CELLS = 1024, 1000


def boundary_distance(box: Rectangle, x: Column, y: Column) -> Column:
    return F.least(x - box.x0, box.x1 - x, y - box.y0, box.y1 - y)


def _alphas(box: Rectangle, x: Column, y: Column, r: Column) -> list[Column]:
    """Half angles that the circle cuts off beyond each side, in order around the rectangle."""
    sides = (x - box.x0, box.y1 - y, box.x1 - x, y - box.y0)
    return [F.when(d < r, F.acos(F.least(d / r, F.lit(1.0)))).otherwise(0.0) for d in sides]


def _weight_of(near: Column, alpha: list[Column], r: Column) -> Column:
    outside = 2 * (alpha[0] + alpha[1] + alpha[2] + alpha[3])
    for k in range(4):
        outside = outside - F.greatest(F.lit(0.0), alpha[k] + alpha[(k + 1) % 4] - math.pi / 2)
    inside = F.greatest(2 * math.pi - outside, F.lit(NO_ANGLE))  # next to nothing inside: far over 100
    return F.when(near <= 0, MOST).when(r <= near, 1.0).otherwise(F.least(F.lit(MOST), 2 * math.pi / inside))


def rectangle_weight(box: Rectangle, x: Column, y: Column, r: Column) -> Column:
    """Isotropic weight in a rectangle; 100 for centres outside or on its border, 1 for circles inside."""
    return _weight_of(boundary_distance(box, x, y), _alphas(box, x, y, r), r)


def with_rectangle_weight(df: DataFrame, box: Rectangle, x: str, y: str, r: str, name: str = "w") -> DataFrame:
    """df with rectangle_weight() as a column, in steps: each arc cosine is computed once.

    As one expression it would hold dozens of them, and the generated method would be too large
    for the JVM to compile.
    """
    alpha = {f"__alpha{k}": a for k, a in enumerate(_alphas(box, F.col(x), F.col(y), F.col(r)))}
    staged = df.withColumns(alpha | {"__near": boundary_distance(box, F.col(x), F.col(y))})
    return staged.withColumn(name, _weight_of(F.col("__near"), [F.col(c) for c in alpha], F.col(r))).drop(*alpha, "__near")


def temporal_weight(unit: str, t: Column, tau: Column, t0: Column, t1: Column) -> Column:
    """0 outside the interval; 1 if both t - tau and t + tau lie in it or tau is 0; otherwise 2."""
    inside = (shift(unit, t, -tau) >= t0) & (shift(unit, t, tau) <= t1)
    return F.when((t < t0) | (t > t1), 0.0).when((tau == 0) | inside, 1.0).otherwise(2.0)


def free_weight(tau: Column, free: Column) -> Column:
    """temporal_weight() of a time with free_units()."""
    return F.when(free < 0, 0.0).when(tau <= free, 1.0).otherwise(2.0)


def _ragged(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, item) of runs of items: count[i] items from first[i] on belong to i."""
    owner = np.repeat(np.arange(len(count)), count)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)


def _filed(key: np.ndarray, edge: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(edges, starts): the edges of key k are edges[starts[k]:starts[k + 1]]."""
    both = np.unique(key * np.int64(edge.max(initial=0) + 1) + edge)
    key, edge = np.divmod(both, np.int64(edge.max(initial=0) + 1))
    return edge, np.searchsorted(key, np.arange(size + 1))


class EdgeIndex:
    """Edges of closed rings (k, 2) of a region, filed by the strip of y that they pass and by grid cell.

    Inside is decided by even-odd rule with the edges of a point's strip, near edges are looked up in its
    cell: these are all within reach of any place in it. Without a reach all edges count as near.
    """

    def __init__(self, rings: list[np.ndarray], reach: float | None = None):
        self.a = np.concatenate([ring[:-1] for ring in rings])
        self.d = np.concatenate([ring[1:] for ring in rings]) - self.a
        proper = (self.d != 0).any(axis=1)
        self.a, self.d, self.reach = self.a[proper], self.d[proper], reach
        self.low, high = self.a.min(axis=0), self.a.max(axis=0)
        n = len(self.a)
        self.strips = min(n, MOST_STRIPS)
        self.strip = max((high[1] - self.low[1]) / self.strips, 1e-300)
        ends = np.sort(np.stack([self.a[:, 1], self.a[:, 1] + self.d[:, 1]]), axis=0)
        lo, hi = (self._strip_of(v) for v in ends)
        edge, key = _ragged(lo, hi - lo + 1)
        self.by_strip, self.strip_at = _filed(key, edge, self.strips)
        if reach is not None:
            self._grid(high, n)

    def _strip_of(self, y: np.ndarray) -> np.ndarray:
        return np.clip((y - self.low[1]) / self.strip, 0, self.strips - 1).astype(np.int64)

    def _grid(self, high: np.ndarray, n: int) -> None:
        """Edges go in pieces no longer than a cell; a piece is near to at most four by four cells."""
        self.cell = max(self.reach, float((high - self.low).max()) / MOST_CELLS, 1e-300)
        self.wide = ((high - self.low) / self.cell).astype(np.int64) + 3
        many = np.ceil(np.hypot(self.d[:, 0], self.d[:, 1]) / self.cell).astype(np.int64).clip(1)
        edge, k = _ragged(np.zeros(n, np.int64), many)
        corners = [self.a[edge] + self.d[edge] * ((k + s) / many[edge])[:, None] for s in (0, 1)]
        lo = self._cell_of(np.minimum(*corners) - self.reach)
        hi = self._cell_of(np.maximum(*corners) + self.reach)
        span = hi - lo + 1
        owner, place = _ragged(np.zeros(len(edge), np.int64), span[:, 0] * span[:, 1])
        cells = (lo[owner, 0] + place // span[owner, 1]) * self.wide[1] + lo[owner, 1] + place % span[owner, 1]
        self.by_cell, self.cell_at = _filed(cells, edge[owner], int(self.wide[0] * self.wide[1]))

    def _cell_of(self, p: np.ndarray) -> np.ndarray:
        """Cells of places, those beyond the region's box in a border of one cell around it."""
        return np.clip(np.floor((p - self.low) / self.cell).astype(np.int64) + 1, 0, self.wide - 1)

    def _near(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First item and number of the near edges of each place, in self.by_cell."""
        if self.reach is None:
            return np.zeros(len(x), np.int64), np.full(len(x), len(self.a))
        c = self._cell_of(np.stack([x, y], axis=1))
        key = c[:, 0] * self.wide[1] + c[:, 1]
        return self.cell_at[key], self.cell_at[key + 1] - self.cell_at[key]

    def _edges(self, item: np.ndarray) -> np.ndarray:
        return item if self.reach is None else self.by_cell[item]

    def inside(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), bool)
        strip = self._strip_of(y)
        first, count = self.strip_at[strip], self.strip_at[strip + 1] - self.strip_at[strip]
        for s in _chunks(count):
            owner, item = _ragged(first[s], count[s])
            e = self.by_strip[item]
            py, ay = y[s][owner], self.a[e, 1]
            by = ay + self.d[e, 1]
            with np.errstate(divide="ignore", invalid="ignore"):
                at = self.a[e, 0] + (py - ay) / self.d[e, 1] * self.d[e, 0]
            crossed = ((ay > py) != (by > py)) & (x[s][owner] < at)
            out[s] = np.bincount(owner[crossed], minlength=len(count[s])) % 2 == 1
        return out

    def distance(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Distance to the nearest edge, negative outside, no more than reach."""
        return self.distances(x, y)[0]

    def distances(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(distance(), distance to the second nearest edge), both no more than reach."""
        out = np.full((2, len(x)), np.inf if self.reach is None else self.reach)
        first, count = self._near(x, y)
        for s in _chunks(count):
            owner, item = _ragged(first[s], count[s])
            e = self._edges(item)
            fx, fy, dx, dy = x[s][owner] - self.a[e, 0], y[s][owner] - self.a[e, 1], self.d[e, 0], self.d[e, 1]
            along = np.clip((fx * dx + fy * dy) / (dx * dx + dy * dy), 0, 1)
            far = np.hypot(fx - along * dx, fy - along * dy)
            far = far[np.lexsort((far, owner))]
            begin = np.cumsum(count[s]) - count[s]
            for k in (0, 1):
                has = count[s] > k
                part = out[k, s]
                part[has] = np.minimum(part[has], far[begin[has] + k])
        return np.where(self.inside(x, y), out[0], -out[0]), out[1]

    def weights(self, x: np.ndarray, y: np.ndarray, r: np.ndarray) -> np.ndarray:
        """Weights of circles (x, y, r), r within reach: each is cut where it crosses an edge, and an arc counts if its midpoint lies inside."""
        angle = np.zeros(len(x))
        first, count = self._near(x, y)
        for s in _chunks(count):
            angle[s] = self._angles(x[s], y[s], r[s], *_ragged(first[s], count[s]))
        with np.errstate(divide="ignore"):
            return np.where(angle > NO_ANGLE, np.minimum(MOST, 2 * np.pi / angle), MOST)

    def _angles(self, x: np.ndarray, y: np.ndarray, r: np.ndarray, owner: np.ndarray, item: np.ndarray) -> np.ndarray:
        e = self._edges(item)
        dx, dy = self.d[e, 0], self.d[e, 1]
        fx, fy = self.a[e, 0] - x[owner], self.a[e, 1] - y[owner]
        qa, qb = dx * dx + dy * dy, fx * dx + fy * dy
        root = qb * qb - qa * (fx * fx + fy * fy - r[owner] ** 2)
        who, cut = [], []
        with np.errstate(invalid="ignore"):
            sq = np.sqrt(root)
            for sign in (-1, 1):
                t = (-qb + sign * sq) / qa
                hit = (root > 0) & (t >= 0) & (t <= 1)
                who.append(owner[hit])
                cut.append(np.arctan2(fy[hit] + t[hit] * dy[hit], fx[hit] + t[hit] * dx[hit]))
        who, cut = np.concatenate(who), np.concatenate(cut)
        order = np.lexsort((cut, who))
        who, cut = who[order], cut[order]
        many = np.bincount(who, minlength=len(x))
        # an arc goes from one cut to the next, the last one on to the first
        end, last = np.roll(cut, -1), np.cumsum(many)[many > 0] - 1
        end[last] = cut[last - many[many > 0] + 1] + 2 * np.pi
        none = np.flatnonzero(many == 0)  # no crossing: all or nothing, as any point that isn't one of contact
        who = np.concatenate([who, none])
        begin = np.concatenate([cut, np.full(len(none), OFF_AXIS - np.pi)])
        end = np.concatenate([end, np.full(len(none), OFF_AXIS + np.pi)])
        mid = (begin + end) / 2
        kept = self.inside(x[who] + r[who] * np.cos(mid), y[who] + r[who] * np.sin(mid))
        return np.bincount(who[kept], (end - begin)[kept], minlength=len(x))


def _chunks(count: np.ndarray):
    """Slices of rows whose counts add up to about CHUNK."""
    upto = np.cumsum(count)
    lo = 0
    while lo < len(count):
        hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + CHUNK, "right")))
        yield slice(lo, hi)
        lo = hi


def polygon_weights(rings: list[np.ndarray], x: np.ndarray, y: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Weights of circles (x, y, r) in a polygon; rings (k, 2) are closed, holes by even-odd rule."""
    return EdgeIndex(rings).weights(x, y, r)


def edge_index(region: Region, reach: float | None = None) -> EdgeIndex:
    return EdgeIndex([np.array(ring, float) for ring in region.rings()], reach)


def polygon_weight(spark: SparkSession, region: Region, reach: float | None = None):
    """Function of columns (x, y, r): the weight in a polygon, in Arrow batches; 1 where r is null. reach bounds all r."""
    shared = spark.sparkContext.broadcast(edge_index(region, reach))  # the boundary's edges: one object of the query

    def run(x: pa.Array, y: pa.Array, r: pa.Array) -> pa.Array:
        px, py, pr = (c.to_numpy(zero_copy_only=False).astype(float) for c in (x, y, r))
        out, work = np.ones(len(pr)), ~np.isnan(pr)
        out[work] = shared.value.weights(px[work], py[work], pr[work])
        return pa.array(out)

    return F.arrow_udf(run, "double")


def polygon_distance(spark: SparkSession, region: Region, reach: float | None = None):
    """Function of columns (x, y): distance to the boundary, negative outside, no more than reach."""
    shared = spark.sparkContext.broadcast(edge_index(region, reach))

    def run(x: pa.Array, y: pa.Array) -> pa.Array:
        return pa.array(shared.value.distance(*(c.to_numpy(zero_copy_only=False).astype(float) for c in (x, y))))

    return F.arrow_udf(run, "double")


def polygon_distances(spark: SparkSession, region: Region, reach: float):
    """Function of columns (x, y): struct of edge, as polygon_distance(), and second, the distance to the second nearest edge."""
    shared = spark.sparkContext.broadcast(edge_index(region, reach))

    def run(x: pa.Array, y: pa.Array) -> pa.Array:
        both = shared.value.distances(*(c.to_numpy(zero_copy_only=False).astype(float) for c in (x, y)))
        return pa.StructArray.from_arrays([pa.array(d) for d in both], ["edge", "second"])

    return F.arrow_udf(run, "edge double, second double")


def one_edge_weight(edge: Column, r: Column) -> Column:
    """Weight of a circle that no edge but the nearest one, edge away, can cross: a chord cuts off the rest."""
    return F.when(r <= edge, 1.0).otherwise(math.pi / (math.pi - F.acos(F.least(edge / r, F.lit(1.0)))))


def translation_weight(box: Rectangle, dx: Column, dy: Column) -> Column:
    """Area over the area shared with the rectangle moved by (dx, dy); 100 at most."""
    w, h = box.x1 - box.x0, box.y1 - box.y0
    shared = F.greatest(F.lit(0.0), w - F.abs(dx)) * F.greatest(F.lit(0.0), h - F.abs(dy))
    return F.when(shared > 0, F.least(F.lit(MOST), F.lit(box.area) / shared)).otherwise(MOST)


def register(spark: SparkSession, region: Region) -> None:
    """Offer `polygon_weight(x, y, r)` to SQL for a region (a rectangle as its ring)."""
    spark.udf.register("polygon_weight", polygon_weight(spark, region))
