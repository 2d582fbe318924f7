"""Joins of dense cells, of boxes of all sizes and of circles with radii of their own."""

import random

import pytest
from pyspark.sql import functions as F

from pointloom.operators import pairs
from pointloom.plans.queries import QUERIES


def some(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def crowd(spark, n, seed=1):
    """A third of the points in one cell, all distinct."""
    rnd = random.Random(seed)
    rows = [(k, rnd.uniform(0, 1) if k % 3 == 0 else rnd.uniform(0, 40), rnd.uniform(0, 1) if k % 3 == 0 else rnd.uniform(0, 40)) for k in range(n)]
    return spark.createDataFrame(rows, "pid long, x double, y double")


@pytest.mark.parametrize("most", [50, 5_000])
@pytest.mark.parametrize("cells", [0, 10_000])
def test_dense_cells_equal_the_nested_loop(spark, monkeypatch, most, cells):
    monkeypatch.setattr(pairs, "SHARE_PAIRS", most)
    monkeypatch.setattr(pairs, "DENSE_CELLS", cells)
    p = crowd(spark, 300)
    assert some(pairs.distance_join(p, p, 1.5), "pid_a", "pid_b") == some(pairs.nested_loop_join(p, p, 1.5), "pid_a", "pid_b")
    q = crowd(spark, 200, 2).withColumn("t", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))
    q = q.unionByName(q.limit(5))  # repeated rows
    joined = pairs.st_join(q, q, 1.5, 2, "DAYS")
    assert some(joined, "pid_a", "pid_b") == some(pairs.nested_loop_join(q, q, 1.5), "pid_a", "pid_b")


def test_a_dense_cell_is_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(pairs, "SHARE_PAIRS", 20_000)
    rows = [(k, k / 9000, (k * 37 % 1000) / 1000) for k in range(1000)]
    p = spark.createDataFrame(rows, "pid long, x double, y double")
    shuffled = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "16")
        got = pairs.distance_join(p, p, 4.0).groupBy(F.spark_partition_id().alias("part")).count().collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", shuffled)
    assert sum(r["count"] for r in got) == 1_000_000
    assert len(got) >= 8 and max(r["count"] for r in got) <= 300_000


def test_cells_without_many_pairs_are_left_alone(spark):
    p = crowd(spark, 100)
    assert pairs.dense_cells(*pairs._sides(p, p, 1.0)) is None


def boxes(spark, n, seed):
    rnd = random.Random(seed)
    rows = []
    for k in range(n):
        x, y, size = rnd.randint(-40, 40) / 2, rnd.randint(-40, 40) / 2, rnd.choice([0, 0, 0.5, 0.125, 1, 2, 3.7, 64, 500])
        rows.append((k, x, x + size, y, y + rnd.choice([0, size, size / 3])))
    rows += [(n, None, 1.0, 0.0, 1.0), (n + 1, 2.0, 1.0, 0.0, 1.0)] + rows[:3]
    return rows, spark.createDataFrame(rows, "pid long, x0 double, x1 double, y0 double, y1 double")


@pytest.mark.parametrize("boundary", [True, False])
@pytest.mark.parametrize("most", [10, 4_000_000])
def test_boxes_equal_all_pairs(spark, monkeypatch, boundary, most):
    monkeypatch.setattr(pairs, "SHARE_PAIRS", most)
    (ra, a), (rb, b) = boxes(spark, 70, 3), boxes(spark, 60, 4)
    less = (lambda p, q: p <= q) if boundary else (lambda p, q: p < q)
    ok = lambda r: r[1] is not None and r[1] <= r[2] and r[3] <= r[4]
    want = sorted((p[0], q[0]) for p in ra for q in rb if ok(p) and ok(q) and less(p[1], q[2]) and less(q[1], p[2]) and less(p[3], q[4]) and less(q[3], p[4]))
    assert some(pairs.box_join(a, b, boundary), "pid_a", "pid_b") == want
    assert pairs.box_join(a.where("false"), b).count() == 0 and pairs.box_join(a, b.where("false")).count() == 0


def test_circles_of_all_radii(spark):
    rnd = random.Random(6)
    circles = [(k, rnd.uniform(-9, 9), rnd.uniform(-9, 9), rnd.choice([0.0, 0.5, 1.0, 7.0, None, -1.0])) for k in range(60)] + [(99, 3.0, 4.0, 5.0)]
    places = [(k, rnd.uniform(-9, 9), rnd.uniform(-9, 9)) for k in range(60)] + [(99, 0.0, 0.0)]
    a = spark.createDataFrame(circles, "pid long, x double, y double, r double")
    b = spark.createDataFrame(places, "pid long, x double, y double")
    for boundary in (True, False):
        want = sorted((p[0], q[0]) for p in circles for q in places if p[3] is not None and p[3] >= 0 and ((p[1] - q[1]) ** 2 + (p[2] - q[2]) ** 2 <= p[3] ** 2 if boundary else (p[1] - q[1]) ** 2 + (p[2] - q[2]) ** 2 < p[3] ** 2))
        got = pairs.circle_join(a, b, boundary)
        assert some(got, "pid_a", "pid_b") == want
        assert got.columns == ["pid_a", "x_a", "y_a", "r_a", "pid_b", "x_b", "y_b", "d"]


def test_reference_systems_must_agree(spark):
    from pointloom.functions import crs

    p = spark.createDataFrame([(1, 30.0, 114.0)], "pid long, x double, y double")
    moved = crs.transform(p, "EPSG:4326", "EPSG:3857")
    with pytest.raises(ValueError):
        pairs.circle_join(moved.withColumn("r", F.lit(1.0)), p)


def test_queries_are_registered():
    assert {"box_pairs", "box_pairs_open", "box_count", "box_collect", "circle_pairs"} <= set(QUERIES)


def test_points_are_shuffled_by_tile_not_by_cell(spark):
    """Nothing is shuffled or sorted once a left row is repeated for the cells around it."""
    q = crowd(spark, 50).withColumn("t", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))
    for joined in (pairs.distance_join(q.drop("t"), q.drop("t"), 1.5), pairs.st_join(q, q, 1.5, 2, "DAYS")):
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange ") == 2 and "Sort" not in plan and "Broadcast" not in plan
        left = plan[plan.index("ShuffledHashJoin"): plan.index("Exchange ")]
        assert "+ -1)" in left  # cells around are made above the exchange


@pytest.mark.parametrize("rows", [7, 60])
def test_both_sides_of_a_tile_are_dealt(spark, monkeypatch, rows):
    monkeypatch.setattr(pairs, "PART_ROWS", rows)
    monkeypatch.setattr(pairs, "SHARE_PAIRS", 500)
    p, q = crowd(spark, 200), crowd(spark, 100, 2)
    assert pairs._dealt(*pairs._sides(p, q, 1.5)[:2], ["cx", "cy"], [])[0] is not None
    assert some(pairs.distance_join(p, q, 1.5), "pid_a", "pid_b") == some(pairs.nested_loop_join(p, q, 1.5), "pid_a", "pid_b")
    by = [df.withColumn("sim", F.col("pid") % 2) for df in (p, q)]
    got = pairs.distance_join(*by, 1.5, by=("sim",))
    want = pairs.nested_loop_join(*by, 1.5).where("sim_a = sim_b")
    assert some(got, "pid_a", "pid_b") == some(want, "pid_a", "pid_b")


def test_points_on_a_circle_are_not_lost_by_rounding(spark):
    """Centre less radius lies right of the point, their difference is the radius all the same."""
    rows = [(k, x, 7.0, r) for k, (x, _, r) in enumerate(EDGE_ON)]
    circles = spark.createDataFrame(rows, "pid long, x double, y double, r double")
    places = spark.createDataFrame([(k, x, 7.0) for k, (_, x, _) in enumerate(EDGE_ON)], "pid long, x double, y double")
    assert all(x - r > near and (x - near) ** 2 <= r * r for x, near, r in EDGE_ON)
    got = pairs.circle_join(circles, places).where("pid_a = pid_b")
    assert sorted(r["pid_a"] for r in got.collect()) == list(range(len(EDGE_ON)))


EDGE_ON = ((6.73, 2.73, 4.0), (0.45, -0.05, 0.5), (0.68, -0.32, 1.0), (2.85, 0.85, 2.0))


def test_sums_per_point_and_per_key_are_dealt_once(spark):
    from pointloom.operators import kfunction, weighttable
    from pointloom.sources.boundary import Rectangle

    p, box, scale = crowd(spark, 60), Rectangle(-1.0, 41.0, -1.0, 41.0), kfunction.Scale(3.0, 3)
    plan = kfunction.local_k(p, box, scale)._jdf.queryExecution().executedPlan().toString()
    assert "ENSURE_REQUIREMENTS" not in plan and plan.count("Exchange ") == 3
    table = weighttable.new_weights(weighttable.pattern_pairs(p.where("pid < 30"), box, scale, 0.25), box, 0.25)
    curve, _ = weighttable.space_k(p, box, scale, 0.25, table)
    plan = curve._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ShuffledHashJoin") == 2  # the table's pairs and the pattern's, each found once
    alone, _ = weighttable.space_k(p, box, scale, 0.25)
    assert [(r["pairs"], round(r["sigma"], 6)) for r in curve.orderBy("i").collect()] == [(r["pairs"], round(r["sigma"], 6)) for r in alone.orderBy("i").collect()]


def test_rows_travel_without_cells_and_tiles(spark):
    q = crowd(spark, 50).withColumn("t", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))
    q = q.select(*(F.expr(f"CASE WHEN pid >= 0 THEN {c} END").alias(c) for c in q.columns))  # not a constant
    for joined, own in ((pairs.distance_join(q.drop("t"), q.drop("t"), 1.5), ["pid", "x", "y"]), (pairs.st_join(q, q, 1.5, 2, "MONTHS"), ["pid", "x", "y", "t"])):
        lines = joined._jdf.queryExecution().executedPlan().toString().splitlines()
        sent = [lines[k + 1] for k, line in enumerate(lines) if "Exchange " in line]
        assert len(sent) == 2
        for line, side, more in zip(sent, "ab", (["part"], ["part", "steps"])):
            for c in [f"{c}_{side}" for c in own] + more:
                assert f" {c}#" in line or f"[{c}#" in line
            assert not any(f" AS {c}" in line or f", {c}#" in line.split(" AS ")[0] for c in ("cx", "cy", "tile_", "lo#", "hi#"))


def test_tiles_of_rows_are_found_again(spark):
    rnd = random.Random(8)
    p = spark.createDataFrame([(k, rnd.choice([-1e-9, 0.0, 8.0, -8.0, rnd.uniform(-40, 40)]), rnd.uniform(-40, 40)) for k in range(300)], "pid long, x double, y double")
    cells = ["cx", "cy"]
    got = pairs._tiled(pairs._sides(p, p, 1.0)[1], cells, True).withColumn("steps", pairs._steps(cells))
    again = got.select("tile_cx", "tile_cy", *(v.alias(f"{k}_again") for k, v in pairs._stepped(cells, F.col("steps")).items()))
    assert got.count() > 300
    assert again.where("tile_cx_again != tile_cx OR tile_cy_again != tile_cy").count() == 0
    assert some(pairs.distance_join(p, p, 1.0), "pid_a", "pid_b") == some(pairs.nested_loop_join(p, p, 1.0), "pid_a", "pid_b")


@pytest.mark.parametrize("most, rows", [(4_000_000, 250_000), (300, 250_000), (300, 20), (4_000_000, 20)])
def test_cells_are_counted_only_in_tiles_that_may_have_many_pairs(spark, monkeypatch, most, rows):
    from collections import Counter
    from math import ceil, floor

    monkeypatch.setattr(pairs, "SHARE_PAIRS", most)
    monkeypatch.setattr(pairs, "PART_ROWS", rows)
    p, q = crowd(spark, 200), crowd(spark, 100, 2)
    keys, grouped = [], type(p).groupBy
    monkeypatch.setattr(type(p), "groupBy", lambda df, *cols: keys.append((cols, df)) or grouped(df, *cols))
    dense, held_a, held_b = pairs._dealt(*pairs._sides(p, q, 1.5)[:2], ["cx", "cy"], [])
    monkeypatch.undo()
    cells = {side: [tuple(floor(v / (1.5 * (1 + 1e-9))) for v in (r["x"], r["y"])) for r in df.collect()] for side, df in (("l", p), ("r", q))}
    left = Counter(((x // 8, y // 8), (x, y)) for x, y in cells["l"])
    right = Counter(((u, v), (x, y)) for x, y in cells["r"] for u in {(x - 1) // 8, (x + 1) // 8} for v in {(y - 1) // 8, (y + 1) // 8})
    want, want_a, want_b, large = {}, 0, 0, 0
    for tile in {k[0] for k in left} & {k[0] for k in right}:
        (n, m), square = (sum(c for k, c in side.items() if k[0] == tile) for side in (left, right)), sum(c * c for side in (left, right) for k, c in side.items() if k[0] == tile)
        b = max(1, ceil(m / rows))
        a = max(1, min(ceil(min(n * m, square * 4.5) / b / most), n))
        want_a, want_b, large = want_a + n * b, want_b + m * a, large + (n * m > most or m > rows)
        want |= {(*tile, a, b): 1} if a * b > 1 else {}
    assert (held_a, held_b) == (want_a, want_b)
    assert (some(dense, "tile_cx", "tile_cy", "shares_a", "shares_b") if dense is not None else []) == sorted(want)
    by_cell = [df for cols, df in keys if "cx" in cols]
    assert len(by_cell) == (1 if large else 0)
    if large:
        assert by_cell[0].select("tile_cx", "tile_cy").distinct().count() == large
