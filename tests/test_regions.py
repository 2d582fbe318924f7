"""Edge index of the polygon weight against all edges of long rings."""

import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointloom.functions import weights
from pointloom.operators import kfunction
from pointloom.operators.kfunction import Scale
from pointloom.sources import points as pts
from pointloom.sources.boundary import Polygon


def star(n, wobble=0.4, at=(0.0, 0.0), size=100.0):
    """A closed ring of n vertices, far from convex."""
    th = np.linspace(0, 2 * math.pi, n, endpoint=False)
    r = size * (1 - wobble + wobble * np.cos(9 * th) + 0.01 * np.sin(171 * th))
    ring = np.stack([at[0] + r * np.cos(th), at[1] + r * np.sin(th)], axis=1)
    return np.concatenate([ring, ring[:1]])


@pytest.mark.parametrize("n", [3, 7, 200, 3000])
def test_index_equals_all_edges(n):
    rings = [star(n), star(max(3, n // 4), 0.2, (55.0, 0.0), 12.0)]
    rng = np.random.default_rng(n)
    x, y, r = rng.uniform(-120, 120, 400), rng.uniform(-120, 120, 400), rng.uniform(0.0, 15.0, 400)
    every, near = weights.EdgeIndex(rings), weights.EdgeIndex(rings, 15.0)
    assert np.allclose(near.weights(x, y, r), every.weights(x, y, r), rtol=1e-12)
    full = every.distance(x, y)
    assert np.allclose(near.distance(x, y), np.clip(full, -15.0, 15.0))
    a, b = rings[0][:-1], rings[0][1:]
    for k in range(0, 400, 17):
        seen = sum(((p[1] > y[k]) != (q[1] > y[k])) and x[k] < p[0] + (y[k] - p[1]) / (q[1] - p[1]) * (q[0] - p[0]) for ring in rings for p, q in zip(ring, ring[1:]))
        assert (full[k] > 0) == (seen % 2 == 1)
    assert len(a) == len(b)


def test_a_ring_of_many_vertices(spark):
    ring = star(100_000)
    region = Polygon(tuple(map(tuple, ring)))
    rng = np.random.default_rng(1)
    rows = [(int(k), float(x), float(y)) for k, (x, y) in enumerate(rng.uniform(-60, 60, (3000, 2)))]
    p = spark.createDataFrame(rows, "pid long, x double, y double")
    began = time.time()
    got = kfunction.space_k(p, region, Scale(5.0, 5)).collect()
    assert time.time() - began < 60
    coarse = kfunction.space_k(p, Polygon(tuple(map(tuple, star(5_000)))), Scale(5.0, 5)).collect()
    assert [r["pairs"] for r in got] == [r["pairs"] for r in coarse]
    assert all(abs(r["sigma"] - c["sigma"]) < 2e-3 * c["sigma"] for r, c in zip(got, coarse))


def test_clear_pairs_stay_out_of_python(spark, sf):
    p = pts.events(spark, sf).select("pid", "x", "y")
    square = Polygon(((-900.0, -900.0), (-900.0, 2000.0), (2000.0, 2000.0), (2000.0, -900.0), (-900.0, -900.0)))
    sent = []
    pairs = kfunction.weighed_pairs(p, p, square, lambda a, b: sent.append(a.count()) or kfunction.distance_join(a, b, 5.0), 5.0)
    assert sent == [p.count(), 0] and pairs.where(F.col("w") != 1.0).count() == 0


def crossings(rings, x, y):
    return sum(((p[1] > y) != (q[1] > y)) and x < p[0] + (y - p[1]) / (q[1] - p[1]) * (q[0] - p[0]) for ring in rings for p, q in zip(ring, ring[1:]))


@pytest.mark.parametrize("size", [None, 0.7, 13.0, 1000.0])
def test_points_in_many_polygons(spark, size):
    """Concave, touching, overlapping and holed regions, long edges and cells of all sizes."""
    from pointloom.operators import regions

    box = lambda x0, y0, x1, y1: [(x0, y0), (x0, y1), (x1, y1), (x1, y0), (x0, y0)]
    shapes = {
        "star": [star(40).tolist(), star(12, 0.2, (52.0, 0.0), 9.0).tolist()],
        "left": [box(-90.03, -70.01, 0.0, 70.02)],
        "right": [box(0.0, -70.01, 80.07, 70.02), box(10.0, 10.0, 20.0, 20.0)],
        "sliver": [[(-100.3, -99.1), (99.7, 99.3), (99.7, 99.9), (-100.3, -99.1)]],
        "parts": [box(-95, -95, -91, -91), box(91, 91, 95, 95)],
    }
    rows = [(name, r, v, float(x), float(y)) for name, rings in shapes.items() for r, ring in enumerate(rings) for v, (x, y) in enumerate(ring)]
    vertices = spark.createDataFrame(rows + [("none", 0, 0, None, 1.0)], "region string, ring int, vertex int, x double, y double")
    rng = np.random.default_rng(8)
    places = [(k, float(x), float(y), "kept") for k, (x, y) in enumerate(rng.uniform(-110, 110, (600, 2)))] + [(-1, None, 1.0, "kept"), (-2, -93.0, -93.0, "kept")]
    p = spark.createDataFrame(places, "pid long, x double, y double, point string")
    want = sorted((k, name) for k, x, y, _ in places if x is not None for name, rings in shapes.items() if crossings(rings, x, y) % 2)
    got = regions.points_in(p, vertices, size)
    assert got.columns == ["pid", "x", "y", "point", "region"]
    assert sorted((r["pid"], r["region"]) for r in got.collect()) == want
    counts = {r["region"]: r["n"] for r in regions.count_in(p, vertices, size).collect()}
    assert counts == {name: sum(w[1] == name for w in want) for name in {w[1] for w in want}}
    assert regions.points_in(p, vertices.where("false"), size).count() == 0


def test_geojson_of_several_parts(spark, tmp_path):
    from pointloom.operators import regions
    from pointloom.sources.boundary import MultiPolygon, geojson_regions, read_geojson

    a, hole, b = "[[0,0],[0,4],[4,4],[4,0],[0,0]]", "[[1,1],[1,2],[2,2],[2,1],[1,1]]", "[[10,0],[10,2],[12,2],[12,0],[10,0]]"
    multi = '{"type":"Feature","geometry":{"type":"MultiPolygon","coordinates":[[%s,%s],[%s]]},"properties":{"name":"two"}}' % (a, hole, b)
    single = '{"type":"Feature","geometry":{"type":"Polygon","coordinates":[[[20,0],[20,1],[21,1],[20,0]]]},"properties":{"name":"one"}}'
    point = '{"type":"Feature","geometry":{"type":"Point","coordinates":[1,2]},"properties":{"name":"dot"}}'
    (tmp_path / "m.json").write_text('{"type":"FeatureCollection","features":[%s]}' % multi)
    (tmp_path / "all.json").write_text('{"type":"FeatureCollection","features":[%s]}' % ",".join([multi, single, point]))
    got = read_geojson(spark, str(tmp_path / "m.json"))
    assert isinstance(got, MultiPolygon) and got.area == 16 - 1 + 4 and len(got.rings()) == 3
    box = got.rectangle()
    assert (box.x0, box.x1, box.y0, box.y1) == (0, 4, 0, 12)
    with pytest.raises(ValueError):
        read_geojson(spark, str(tmp_path / "all.json"))
    assert read_geojson(spark, str(tmp_path / "all.json"), several=True).area == 19.5
    table = geojson_regions(spark, str(tmp_path / "all.json"), "name")
    places = [(1, 0.5, 0.5), (2, 1.5, 1.5), (3, 1.0, 11.0), (4, 0.6, 20.2), (5, 3.0, 11.0)]
    p = spark.createDataFrame(places, "pid long, x double, y double")
    assert sorted((r["pid"], r["region"]) for r in regions.points_in(p, table, 0.7).collect()) == [(1, "two"), (3, "two"), (4, "one")]
    curve = kfunction.space_k(p, got, Scale(1.0, 2)).collect()  # a region of two parts takes part in everything else
    assert len(curve) == 2
