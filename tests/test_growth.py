"""Work that must not be done per pair, or twice."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointloom.functions import timeunits, weights
from pointloom.operators import kfunction, pairs, simulate
from pointloom.sources.boundary import Polygon, Rectangle
from tests.test_joins import crowd, some

BEGIN, END = datetime(2023, 12, 31, 6, 30), datetime(2024, 3, 1, 0, 0, 0, 5)
BOX = Rectangle(-1.0, 41.0, -1.0, 41.0, BEGIN, END)


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def some_times():
    rnd = random.Random(5)
    days = [datetime(y, m, d, h) for y in (1968, 2023, 2024) for m, d in ((1, 1), (1, 31), (2, 28), (3, 1), (3, 31), (12, 31)) for h in (0, 6)]
    return days + [BEGIN, END, datetime(2024, 2, 29)] + [BEGIN + (END - BEGIN) * rnd.uniform(-0.2, 1.2) for _ in range(20)]


@pytest.mark.parametrize("unit", list(timeunits.Unit))
def test_clocks_equal_calendar_arithmetic(spark, unit):
    t = spark.createDataFrame([(v,) for v in some_times()], "t timestamp_ntz")
    t = t.withColumn("clock", timeunits.clock(unit, F.col("t")))
    t0, t1 = (F.lit(v).cast("timestamp_ntz") for v in (BEGIN, END))
    t = t.withColumn("free", timeunits.free_units(unit, F.col("t"), t0, t1, 40))
    two = t.select(F.col("t").alias("a"), F.col("clock").alias("ca"), "free").crossJoin(t.select(F.col("t").alias("b"), F.col("clock").alias("cb")))
    assert two.where(timeunits.clock_distance(unit, F.col("ca"), F.col("cb")) != timeunits.distance(unit, F.col("a"), F.col("b"))).count() == 0
    tau = t.withColumn("tau", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(40).cast("bigint"))))
    want = weights.temporal_weight(unit, F.col("t"), F.col("tau"), t0, t1)
    assert tau.where(weights.free_weight(F.col("tau"), F.col("free")) != want).count() == 0


@pytest.mark.parametrize("unit", ["DAYS", "MONTHS"])
def test_no_calendar_functions_above_the_join(spark, unit):
    p = crowd(spark, 60).withColumn("t", F.lit("2024-01-05 00:00:00").cast("timestamp_ntz"))
    scale = kfunction.Scale(1.5, 3, 4, 2, unit)
    for got in (kfunction.st_sums(p, BOX, scale), kfunction.border_st(p, BOX, scale)):
        plan = plan_of(got)
        work = plan[: plan.index("ShuffledHashJoin")].lower()
        assert not any(f in work for f in ("timestampadd", "timestampdiff", "datediff", "dayofmonth", "month("))


def test_an_envelope_finds_pairs_once(spark):
    p = crowd(spark, 60).withColumn("t", F.lit(BEGIN).cast("timestamp_ntz") + F.make_dt_interval((F.col("pid") % 50).cast("int")))
    scale = kfunction.Scale(1.5, 3, 4, 2)
    for got in (simulate.st_envelope(p, BOX, scale, 3), simulate.space_envelope(p, BOX, scale, 3), simulate.csr_envelope(spark, BOX, 30, scale, 3)):
        assert plan_of(got).count("ShuffledHashJoin") == 1
    # groups of simulations: empty thresholds are there, simulations without any cell are not
    cells = spark.createDataFrame([(1, 2, 1, 5.0), (4, 1, 2, 7.0)], "sim int, i int, j int, sigma double")
    full = kfunction.cumulate_st(cells, scale, "sim")
    assert full.count() == 2 * 3 * 2
    assert some(full.where("sigma > 0"), "sim", "i", "j", "sigma") == [(1, 2, 1, 5.0), (1, 2, 2, 5.0), (1, 3, 1, 5.0), (1, 3, 2, 5.0), (4, 1, 2, 7.0), (4, 2, 2, 7.0), (4, 3, 2, 7.0)]


@pytest.mark.parametrize("unit", ["DAYS", "HOURS", "MONTHS"])
def test_space_time_envelope_equals_the_curves(spark, unit):
    rnd = random.Random(9)
    rows = [(k, rnd.uniform(0, 9), rnd.uniform(0, 9), BEGIN + timedelta(minutes=rnd.randint(0, 86_000))) for k in range(80)]
    p = spark.createDataFrame(rows, "pid long, x double, y double, t timestamp_ntz")
    box, scale = Rectangle(-1.0, 10.0, -1.0, 10.0, BEGIN, END), kfunction.Scale(3.0, 3, {"DAYS": 6, "HOURS": 90, "MONTHS": 2}[unit], 2, unit)
    times = {(r["sim"], r["pid"]): r["t"] for r in simulate.permuted_times(p, 2).collect()}
    curves = []
    for sim in (1, 2):
        q = spark.createDataFrame([(k, x, y, times[sim, k]) for k, x, y, _ in rows], p.schema)
        curves.append({(r["i"], r["j"]): r["l"] for r in kfunction.st_k(q, box, scale).collect()})
    for r in simulate.st_envelope(p, box, scale, 2).collect():
        both = [c[r["i"], r["j"]] for c in curves]
        assert (r["l_min"], r["l_max"]) == (pytest.approx(min(both)), pytest.approx(max(both)))


def test_weights_at_one_edge_are_a_closed_form(spark, monkeypatch):
    """Circles that cross one edge only never leave the JVM."""

    def refuse(*_):
        def run(x, y, r):
            raise AssertionError("sent to Arrow")

        return F.arrow_udf(run, "double")

    rnd = random.Random(2)
    p = spark.createDataFrame([(k, rnd.uniform(0.1, 3), rnd.uniform(20, 30)) for k in range(80)], "pid long, x double, y double")
    house = Polygon(((0, 0), (0, 50), (40, 50), (40, 0), (0, 0)))
    scale = kfunction.Scale(4.0, 2)
    want = [r["sigma"] for r in kfunction.space_sums(p, p, Rectangle(0.0, 40.0, 0.0, 50.0), scale).orderBy("i").collect()]
    monkeypatch.setattr(kfunction, "polygon_weight", refuse)
    got = [r["sigma"] for r in kfunction.space_sums(p, p, house, scale).orderBy("i").collect()]
    assert got == pytest.approx(want)


def test_weights_at_corners_holes_and_outside(spark):
    """The pairs' weights by parts equal those of the polygon's circles."""
    rnd = random.Random(4)
    rings = (((0, 0), (0, 12), (5, 12), (5, 5), (6, 5), (6, 12), (14, 12), (14, 0), (0, 0)), ((7, 2), (9, 2), (9, 3), (7, 3), (7, 2)))
    house = Polygon(rings[0], (rings[1],))
    p = spark.createDataFrame([(k, rnd.uniform(-1, 15), rnd.uniform(-1, 13)) for k in range(250)], "pid long, x double, y double")
    found = kfunction.weighed_pairs(p, p, house, lambda a, b: pairs.distance_join(a, b, 2.0), 2.0).collect()
    x, y, d, w = (np.array([r[c] for r in found]) for c in ("x_a", "y_a", "d", "w"))
    apart = d > 0
    assert len(found) > 2000
    assert np.allclose(w[apart], weights.edge_index(house, 2.0).weights(x[apart], y[apart], d[apart]), rtol=1e-6)


def test_shared_areas_are_looked_up_by_place(spark):
    from pointloom.functions.shared import with_translation_weight

    p = crowd(spark, 60)
    house = Polygon(((-1, -1), (-1, 41), (41, 41), (41, -1), (-1, -1)))
    plan = plan_of(with_translation_weight(pairs.distance_join(p, p, 1.5), house, 1.5))
    assert "BroadcastHashJoin [__cell#" in plan
