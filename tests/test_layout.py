"""Points along a Hilbert curve: neighbours, intervals and pruned row groups."""

import glob

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from pointloom.operators import layout, pairs
from pointloom.sources.boundary import Rectangle

FRAME = Rectangle(0.0, float(1 << layout.BITS), 0.0, float(1 << layout.BITS))


def test_keys_form_a_curve(spark):
    """Every cell has a key of its own, and cells of following keys touch."""
    side = spark.range(64)
    cells = side.select(F.col("id").cast("double").alias("x")).crossJoin(side.select(F.col("id").cast("double").alias("y")))
    rows = sorted((r["hkey"], r["x"], r["y"]) for r in layout.along_curve(cells, FRAME).collect())
    assert [r[0] for r in rows] == list(range(64 * 64))
    assert all(abs(a[1] - b[1]) + abs(a[2] - b[2]) == 1 for a, b in zip(rows, rows[1:]))
    assert all(layout._key(int(x), int(y)) == k for k, x, y in rows[::37])


def test_a_box_reads_few_row_groups(spark, tmp_path):
    n = 20_000
    pts = spark.range(n).select(F.col("id").alias("pid"), (F.pmod(F.xxhash64("id"), F.lit(70_000)) - 2000).cast("double").alias("x"), (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(70_000)) - 2000).cast("double").alias("y"))
    pts = pts.unionByName(spark.createDataFrame([(-1, None, 5.0)], "pid long, x double, y double"))
    path = str(tmp_path / "layout")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        layout.write_layout(pts, path, FRAME)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    stored = layout.read_layout(spark, path)
    assert stored.count() == n + 1
    for box in ((1000.0, 4000.0, 1000.0, 3000.0), (-5000.0, 200.0, -5000.0, 90_000.0), (3.0, 2.0, 0.0, 1.0), (0.0, 65_536.0, 0.0, 65_536.0)):
        want = {r["pid"] for r in pairs.range_query(pts, *box).collect()}
        assert {r["pid"] for r in layout.layout_query(stored, FRAME, *box).collect()} == want
        assert len(layout.key_intervals(FRAME, *box)) <= layout.INTERVALS
    spans = layout.key_intervals(FRAME, 1000.0, 4000.0, 1000.0, 3000.0)
    groups = [g.column(g.num_columns - 1).statistics for f in glob.glob(f"{path}/*.parquet") for m in [pq.ParquetFile(f).metadata] for g in map(m.row_group, range(m.num_row_groups))]
    read = [s for s in groups if s.has_min_max and any(low <= s.max and s.min <= high for low, high in spans)]
    assert len(groups) >= 4 and 1 <= len(read) < len(groups) / 2
    plan = layout.layout_query(stored, FRAME, 1000.0, 4000.0, 1000.0, 3000.0)._jdf.queryExecution().toString()
    assert "hkey" in plan.split("PushedFilters")[1]


def test_a_key_is_computed_once_a_row(spark):
    pts = spark.range(100).select(F.col("id").cast("double").alias("x"), F.col("id").cast("double").alias("y"))
    plan = layout.layout_query(layout.along_curve(pts, FRAME), FRAME, 10.0, 50.0, 5.0, 70.0)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("aggregate(") == 1
