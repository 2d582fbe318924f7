"""Translation and border corrections of polygons and of space-time."""

import time
from datetime import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pointloom.functions.shared import SharedArea, shared_cells, with_translation_weight
from pointloom.functions.weights import edge_index, translation_weight
from pointloom.operators import kfunction
from pointloom.operators.kfunction import Scale
from pointloom.sources.boundary import MultiPolygon, Polygon, Rectangle, units_between

BOX = Rectangle(-3.0, 9.0, 2.0, 7.0)
#: A U with a hole in its left leg; the second outline runs the other way round.
LEGS = ((0, 0), (10, 0), (10, 8), (6, 8), (6, 2), (4, 2), (4, 8), (0, 8), (0, 0))
HOLE = ((1, 1), (3, 1.5), (2, 4), (1, 1))


def ring(*points):
    return tuple((float(x), float(y)) for x, y in points)


def both(region, hx, hy, n=400_000):
    """Shared area by random places, with its standard error."""
    box = region.rectangle()
    rng = np.random.default_rng(5)
    x, y = rng.uniform(box.x0, box.x1, n), rng.uniform(box.y0, box.y1, n)
    index = edge_index(region)
    share = (index.inside(x, y) & index.inside(x - hx, y - hy)).mean()
    return share * box.area, box.area * (share * (1 - share) / n) ** 0.5


@pytest.mark.parametrize("turn", [1, -1])
def test_rectangle_has_its_closed_form(turn):
    area = SharedArea(Polygon(BOX.rings()[0][::turn]))
    for hx, hy in ((0, 0), (1.5, 0), (0, -2.25), (-3, 4), (11.75, 4.5), (12, 0), (13, 1), (2, -5)):
        assert area(hx, hy) == pytest.approx(max(0, 12 - abs(hx)) * max(0, 5 - abs(hy)), abs=1e-9)


@pytest.mark.parametrize("turn", [1, -1])
def test_concave_ring_and_hole_against_random_places(turn):
    region = Polygon(ring(*LEGS)[::turn], (ring(*HOLE),))
    area = SharedArea(region)
    assert area(0, 0) == pytest.approx(region.area)
    for hx, hy in ((0.3, 0.2), (6, 0), (-5.5, 1), (0, 3), (2, -2.5)):
        want, error = both(region, hx, hy)
        assert abs(area(hx, hy) - want) < 5 * error
        assert area(hx, hy) == pytest.approx(area(-hx, -hy))


def test_several_parts():
    parts = (Polygon(ring((0, 0), (2, 0), (2, 2), (0, 2), (0, 0))), Polygon(ring((3, 0), (3, 2), (5, 2), (5, 0), (3, 0))))
    area = SharedArea(MultiPolygon(parts))
    assert area(0, 0) == pytest.approx(8) and area(3, 0) == pytest.approx(4) and area(2.5, 1) == pytest.approx(1.5)


def test_ring_of_many_vertices():
    th = np.linspace(0, 2 * np.pi, 100_001)[:-1]
    p = np.stack([100 * np.cos(th), 100 * np.sin(th)], axis=1)
    area = SharedArea(Polygon(ring(*p, p[0])))
    began = time.time()
    h = 7.0
    want = 2 * 100**2 * np.arccos(h / 200) - h / 2 * np.sqrt(4 * 100**2 - h * h)
    assert area(h * 0.6, h * 0.8) == pytest.approx(want, rel=1e-6)
    assert time.time() - began < 5


def pairs_of(spark, n, reach):
    rng = np.random.default_rng(3)
    th, d = rng.uniform(0, 2 * np.pi, n), rng.uniform(0, reach, n)
    d[:5] = (0, reach, reach, reach, reach)
    th[:5] = (0, 0, np.pi / 2, np.pi, -np.pi / 2)
    rows = [(1.0, 2.0, 1.0 + a, 2.0 + b) for a, b in zip((d * np.cos(th)).tolist(), (d * np.sin(th)).tolist())]
    return spark.createDataFrame(rows, "x_a double, y_a double, x_b double, y_b double")


def test_table_of_a_rectangle_is_exact(spark):
    region = Polygon(BOX.rings()[0])
    got = with_translation_weight(pairs_of(spark, 500, 4.5), region, 4.5, 8)  # no side is shorter
    got = got.withColumn("want", translation_weight(BOX, F.col("x_b") - F.col("x_a"), F.col("y_b") - F.col("y_a")))
    assert got.count() == 500
    assert got.agg(F.max(F.abs(F.col("w") - F.col("want")) / F.col("want"))).first()[0] < 1e-6


def test_table_keeps_its_bound(spark):
    region = Polygon(ring(*LEGS), (ring(*HOLE),))
    area, reach, steps = SharedArea(region), 3.0, 16
    assert shared_cells(spark.range(1), region, reach, steps).count() == 2 * steps * steps
    for r in with_translation_weight(pairs_of(spark, 300, reach), region, reach, steps).collect():
        exact = area(r["x_b"] - r["x_a"], r["y_b"] - r["y_a"])
        assert abs(region.area / r["w"] - exact) <= area.around * reach / steps * 2**0.5 / 4


def test_pairs_of_a_polygon_stay_in_the_jvm(spark):
    pts = spark.createDataFrame([(1, 1.0, 7.0), (2, 1.5, 7.5), (3, 8.0, 5.0)], "pid long, x double, y double")
    region = Polygon(ring(*LEGS))
    got = kfunction.space_k(pts, region, Scale(2.0, 2), correction="translation")
    area = SharedArea(region)
    assert {r["i"]: r["sigma"] for r in got.collect()}[2] == pytest.approx(3 + 2 * region.area / area(0.5, 0.5), rel=1e-3)
    empty = kfunction.space_k(pts.limit(0), region, Scale(2.0, 2), correction="translation")
    assert [r["sigma"] for r in empty.collect()] == [0.0, 0.0]


def test_border_of_a_polygon_against_all_pairs(spark):
    rng = np.random.default_rng(8)
    region = Polygon(ring(*LEGS), (ring(*HOLE),))
    at = [(float(x), float(y)) for x, y in zip(rng.uniform(-1, 11, 300), rng.uniform(-1, 9, 300))]
    at += at[:20]  # repeated places count each time
    pts = spark.createDataFrame([(i, *p) for i, p in enumerate(at)], "pid long, x double, y double")
    edge = edge_index(region).distance(*np.array(at).T)
    for r in kfunction.border_space(pts, region, Scale(1.0, 4)).collect():
        pairs = sum(edge[a] >= r["d"] and np.hypot(p[0] - q[0], p[1] - q[1]) <= r["d"] for a, p in enumerate(at) for q in at)
        assert (r["pairs"], r["centres"]) == (pairs, int((edge >= r["d"]).sum()))


@pytest.mark.parametrize("unit, span", [("DAYS", 6), ("MONTHS", 2)])
def test_border_of_space_and_time_against_all_pairs(spark, unit, span):
    rng = np.random.default_rng(2)
    days = rng.integers(0, 20 if unit == "DAYS" else 300, 200)
    rows = [(i, float(x), float(y), datetime.fromordinal(738_000 + int(k))) for i, (x, y, k) in enumerate(zip(rng.uniform(-3, 9, 200), rng.uniform(2, 7, 200), days))]
    rows += [(200 + i, *r[1:]) for i, r in enumerate(rows[:10])]
    pts = spark.createDataFrame(rows, "pid long, x double, y double, t timestamp_ntz")
    times = sorted(r[3] for r in rows)
    box = Rectangle(-3.0, 9.0, 2.0, 7.0, times[0], times[-1])
    scale = Scale(2.0, 2, span, 2, unit)
    table = pts.select("pid", "x", "y", "t").toPandas()
    a = table.merge(table, how="cross", suffixes=("_a", "_b"))
    moved = lambda t, n: t + (pd.DateOffset(days=n) if unit == "DAYS" else pd.DateOffset(months=n))
    edge = lambda x, y: min(x - box.x0, box.x1 - x, y - box.y0, box.y1 - y)
    for r in kfunction.border_st(pts, box, scale).collect():
        ok = {p.pid for p in table.itertuples() if edge(p.x, p.y) >= r["d"] and moved(p.t, -r["tau"]) >= box.t0 and moved(p.t, r["tau"]) <= box.t1}
        near = a[a.pid_a.isin(ok) & (np.hypot(a.x_a - a.x_b, a.y_a - a.y_b) <= r["d"])]
        # the join's own reach in time is a span of calendar units on both sides
        within = [moved(p.t_a, -scale.T) <= p.t_b <= moved(p.t_a, scale.T) and units_between(unit, p.t_a, p.t_b) <= r["tau"] for p in near.itertuples()]
        assert (r["pairs"], r["centres"]) == (sum(within), len(ok))
