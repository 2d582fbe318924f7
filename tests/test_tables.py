"""Weights kept as a table, cubes kept for drill-downs, and cross-filters in one scan."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from pointloom.functions.weights import rectangle_weight
from pointloom.operators import cube, kfunction, pairs, weighttable
from pointloom.operators.kfunction import Scale
from pointloom.plans import queries as q
from pointloom.sources import points as pts
from pointloom.sources.boundary import Polygon, envelope_region


@pytest.fixture(scope="module")
def src(spark, sf):
    return pts.events(spark, sf).cache()


@pytest.mark.parametrize("step", [0.05, 0.5])
def test_shares_are_within_the_stated_bound(src, step):
    box = envelope_region(src, 0.01)  # some places are nearer to the border than a step
    p = src.select("pid", "x", "y")
    keyed = weighttable.keyed(pairs.distance_join(p, p, 12.0).where("d > 0"), box, step)
    got = weighttable.weighed(keyed, box, weighttable.new_weights(keyed, box, step))
    exact = rectangle_weight(box, F.col("x_a"), F.col("y_a"), F.col("d"))
    off = F.abs(1 / F.col("w") - 1 / exact)
    n, most, over = got.agg(F.count("*"), F.max(off), F.max(off - weighttable.error_bound(step, F.col("d")))).first()
    assert n == keyed.count() and most > 0 and over <= 1e-9
    border = got.where("kr IS NULL")
    assert border.count() > 0 and border.agg(F.max(F.abs(F.col("w") - exact))).first()[0] < 1e-12


def test_a_later_run_joins_and_extends(spark, src, tmp_path):
    box, scale = envelope_region(src), Scale(6.0, 3)
    clicks = src.where("mark = 'click'")
    first, added = weighttable.space_k(clicks, box, scale, 0.25)
    added.write.parquet(f"{tmp_path}/one")
    table = spark.read.parquet(f"{tmp_path}/one")
    again = weighttable.pattern_pairs(clicks, box, scale, 0.25)
    assert weighttable.new_weights(again, box, 0.25, table).count() == 0
    rates = weighttable.hit_rates(again, table).first()
    assert rates["misses"] == again.where("kr IS NULL").count() and rates["hits"] + rates["misses"] == rates["pairs"]
    fresh = weighttable.hit_rates(again).first()
    assert fresh["misses"] == again.where("kr IS NULL").count() + table.count()
    curve, more = weighttable.space_k(src, box, scale, 0.25, table)
    whole = weighttable.extended(table, more)
    assert whole.count() == whole.select(*weighttable.KEYS).distinct().count() > table.count()
    alone, _ = weighttable.space_k(src, box, scale, 0.25)
    for a, b in zip(sorted(curve.collect()), sorted(alone.collect())):
        assert a["pairs"] == b["pairs"] and a["sigma"] == pytest.approx(b["sigma"])
    fine = {r["i"]: r for r in weighttable.space_k(src, box, scale, 1e-6)[0].collect()}
    for r in kfunction.space_k(src, box, scale).collect():
        assert fine[r["i"]]["pairs"] == r["pairs"] and fine[r["i"]]["sigma"] == pytest.approx(r["sigma"], rel=1e-5)
    empty = weighttable.space_k(src.where("false"), box, scale, 0.25)[0].collect()
    assert [r["sigma"] for r in empty] == [0.0] * 3


def test_rounded_weights_of_a_polygon(src):
    box, scale = envelope_region(src), Scale(6.0, 3)
    ring = Polygon(box.rings()[0], (), box.t0, box.t1)
    got = {r["i"]: r["sigma"] for r in weighttable.space_k(src, ring, scale, 0.01)[0].collect()}
    for r in kfunction.space_k(src, ring, scale).collect():
        assert got[r["i"]] == pytest.approx(r["sigma"], rel=0.02)


def test_a_pyramid_equals_direct_counts(spark, sf):
    src = pts.latlon(spark, sf)
    levels = cube.pyramid(cube.tile_cube(src, 9), 9)
    key = lambda r: (r["tile_x"], r["tile_y"], r["n"])
    for zoom in range(10):
        assert sorted(map(key, levels.where(F.col("zoom") == zoom).collect())) == sorted(map(key, cube.tile_counts(src, zoom).collect()))
    within = cube.drill_down(levels, 2, 1, 1, 4)
    direct = cube.tile_counts(src, 6).where("tile_x >= 16 AND tile_x < 32 AND tile_y >= 16 AND tile_y < 32")
    assert sorted(map(key, within.collect())) == sorted(map(key, direct.collect()))


def test_a_merged_cube_equals_a_rebuilt_one(spark, sf, tmp_path):
    src = pts.latlon(spark, sf)
    for k, part in enumerate((src.where("pid % 3 = 0"), src.where("pid % 3 = 1"))):
        cube.tile_cube(part, 8, "mark").write.parquet(f"{tmp_path}/{k}")
    stored = [spark.read.parquet(f"{tmp_path}/{k}") for k in range(2)]
    merged = cube.merge_cubes(*stored)
    assert merged.exceptAll(cube.tile_cube(src.where("pid % 3 < 2"), 8, "mark")).count() == 0
    assert "events.parquet" not in merged._jdf.queryExecution().executedPlan().toString()
    none = cube.tile_cube(src.where("false"), 8, "mark")
    assert cube.pyramid(none, 8).count() == 0 and cube.merge_cubes(merged, none).exceptAll(merged).count() == 0


def test_a_cross_filter_is_one_scan(spark, sf):
    got = q.cube_crossfilter(spark, sf)
    assert got._jdf.queryExecution().executedPlan().toString().count("FileScan parquet") == 1
    src = pts.events(spark, sf)
    mask = lambda x, y: x * y < 700
    for c in (cube.Constraints(), cube.Constraints(("click", "view"), datetime(2024, 1, 5), None, q.BOX, mask), cube.Constraints(("none",))):
        table = {(r["chart"], r["key"]): r["n"] for r in cube.cross_filter_table(src, c, q.BASE, 86400, 40).collect()}
        charts = cube.cross_filter(src, c, q.BASE, 86400, 40)
        want = {("category", r["mark"]): r["n"] for r in charts["categories"].collect()} | {("series", str(r["bucket"])): r["n"] for r in charts["series"].collect()}
        assert table == want | {("total", ""): charts["total"].first()["n"]}
