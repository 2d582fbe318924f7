"""Golden values, properties and error cases of the point-pattern engine."""

import math
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointloom.functions import circles, crs, envelopes, timeunits
from pointloom.functions.weights import polygon_weights, rectangle_weight, register
from pointloom.operators import cube, kfunction, pairs, simulate
from pointloom.operators.kfunction import Scale
from pointloom.plans.api import run_kfunction
from pointloom.sources import points as pts
from pointloom.sources import results
from pointloom.sources.boundary import PAD, Polygon, Rectangle, envelope_region, read_geojson, units_between

SQUARE = Rectangle(1.0, 5.0, 1.0, 5.0)
RING = np.array([(1, 1), (1, 5), (5, 5), (5, 1), (1, 1)], float)
T = datetime(2024, 1, 10)

# Centre, neighbour, weight in the square.
WEIGHTS = [((3, 5), (3, 4), None, 2.0), ((3, 3), (3, 3), 1.0, 1.0), ((3, 3), (4, 3), 1.0, 1.0), ((3, 3), (5, 3), 1.0, 1.0), ((1.5, 3), (2.5, 3), 1.5, 1.5), ((1.5, 1.5), (2.5, 1.5), 2.4, 2.4), ((3, 3), (5.5, 3), 5.534985666816, 5.534985666816), ((3, 3), (13, 3), 100.0, 100.0), ((9, 3), (9, 3), 100.0, 100.0)]


@pytest.fixture(scope="module")
def some(spark):
    rng = np.random.default_rng(2)
    rows = [(int(k), float(x), float(y), datetime(2024, 1, 1 + int(d)), "ab"[k % 2]) for k, (x, y, d) in enumerate(zip(rng.uniform(0, 40, 150), rng.uniform(0, 30, 150), rng.integers(0, 28, 150)))]
    return spark.createDataFrame(rows, "pid long, x double, y double, t timestamp_ntz, mark string").cache()


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_golden_weights(spark):
    for (cx, cy), (nx, ny), rect, poly in WEIGHTS:
        r = math.hypot(cx - nx, cy - ny)
        if rect is not None:
            assert one(spark, rectangle_weight(SQUARE, F.lit(float(cx)), F.lit(float(cy)), F.lit(r)))[0] == pytest.approx(rect)
        for ring in (RING, RING[::-1]):
            assert polygon_weights([ring], np.array([float(cx)]), np.array([float(cy)]), np.array([r]))[0] == pytest.approx(poly)


def test_polygon_equals_closed_form(spark):
    rng = np.random.default_rng(1)
    x, y, r = rng.uniform(1.01, 4.99, 400), rng.uniform(1.01, 4.99, 400), rng.uniform(0.01, 7, 400)
    df = spark.createDataFrame([tuple(map(float, v)) for v in zip(x, y, r)], "x double, y double, r double")
    closed = [row[0] for row in df.select(rectangle_weight(SQUARE, F.col("x"), F.col("y"), F.col("r"))).collect()]
    assert np.allclose(polygon_weights([RING], x, y, r), closed, rtol=1e-9)


def test_registered_function(spark):
    register(spark, SQUARE)
    assert spark.sql("SELECT polygon_weight(1.5D, 1.5D, 1D)").first()[0] == pytest.approx(2.4)


def test_golden_curve(spark, sf):
    src = pts.events(spark, sf)
    box = envelope_region(src)
    assert box.area == pytest.approx(5086.450741621688)
    rows = kfunction.space_k(src, box, Scale(10.0, 5)).orderBy("i").collect()
    assert [r["pairs"] for r in rows] == [7618, 28128, 57656, 94246, 134498]
    assert [r["sigma"] for r in rows] == pytest.approx([7894.467015, 31349.908006, 69610.161856, 123727.077862, 193163.883662], abs=1e-5)
    assert [r["l"] for r in rows] == pytest.approx([1.341049, 3.009890, 4.539663, 6.096220, 7.638773], abs=1e-6)
    st = {(r["i"], r["j"]): r for r in kfunction.st_k(src, box, Scale(10.0, 5, 5, 5, "DAYS")).collect()}
    assert [st[5, j]["sigma"] for j in range(1, 6)] == pytest.approx([20083.061600, 32538.392989, 45378.887479, 58192.839676, 64940.221641], abs=1e-5)
    assert [st[1, j]["l"] for j in range(1, 6)] == pytest.approx([2.236039, 1.816595, 1.614920, 1.568871, 1.346610], abs=1e-6)


def test_projection(spark):
    x, y = crs.forward(F.lit(30.5), F.lit(114.3))
    assert tuple(one(spark, x, y)) == pytest.approx((12723817.797671, 3567983.455936), abs=1e-5)
    df = spark.createDataFrame([(30.5, 114.3)], "x double, y double")
    with pytest.raises(ValueError):
        crs.transform(df, "EPSG:4326", "EPSG:2154")
    back = crs.transform(crs.transform(df, "EPSG:4326", "EPSG:3857"), "EPSG:3857", "EPSG:4326").first()
    assert tuple(back) == pytest.approx((30.5, 114.3))
    with pytest.raises(ValueError):
        pairs.require_same_crs("EPSG:3857", None)


# A, b, unit, whole units between.
CALENDAR = [("2020-01-31", "2020-02-29", "MONTHS", 0), ("2016-02-29", "2017-02-28", "MONTHS", 11), ("2016-02-29", "2017-02-28", "YEARS", 0), ("2020-01-15", "2020-03-15", "MONTHS", 2), ("2020-03-15", "2020-01-16", "MONTHS", 1), ("2020-01-01 23:00:00", "2020-01-03 01:00:00", "DAYS", 2), ("2020-01-01 23:00:00", "2020-01-03 01:00:00", "HOURS", 26), ("2020-01-01", "2020-01-02", "SECONDS", 86400)]


@pytest.mark.parametrize("a,b,unit,n", CALENDAR)
def test_calendar(spark, a, b, unit, n):
    t = lambda s: F.lit(s).cast("timestamp_ntz")
    assert one(spark, timeunits.distance(unit, t(a), t(b)))[0] == n
    assert units_between(unit, datetime.fromisoformat(a), datetime.fromisoformat(b)) == n


def test_errors():
    with pytest.raises(ValueError):
        timeunits.Unit.of("WEEKS")
    with pytest.raises(ValueError):
        Scale(10.0, 5, 7, 2)
    with pytest.raises(ValueError):
        Polygon(((0, 0), (1, 1), (2, 2)))
    with pytest.raises(ValueError):
        circles.circle(F.lit(1.0), F.lit(1.0), F.lit(T), -1.0, 0, "DAYS")


def test_binning_by_comparison(spark):
    scale = Scale(0.7, 7)
    d = [scale.step * i for i in range(8)] + [math.nextafter(scale.step * i, 1) for i in range(1, 7)]
    df = spark.createDataFrame([(x,) for x in d], "d double")
    for r in df.withColumn("i", kfunction.space_bin(scale, F.col("d"))).collect():
        assert r["i"] == next(i for i in range(1, 9) if r["d"] <= scale.step * i)


def test_joins_equal_nested_loops(some):
    rows = some.collect()
    want = {(a["pid"], b["pid"]) for a in rows for b in rows if (a["x"] - b["x"]) ** 2 + (a["y"] - b["y"]) ** 2 <= 36}
    got = [tuple(r) for r in pairs.distance_join(some, some, 6.0).select("pid_a", "pid_b").collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert {(b, a) for a, b in want} == want
    near = {(a["pid"], b["pid"]) for a in rows for b in rows if (a["pid"], b["pid"]) in want and abs((a["t"] - b["t"]).days) <= 2}
    assert {tuple(r) for r in pairs.st_join(some, some, 6.0, 2, "DAYS").select("pid_a", "pid_b").collect()} == near
    plan = pairs.distance_join(some, some, 6.0)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_nested_loop_for_tiny_inputs(some, monkeypatch):
    cols = ["pid_a", "pid_b", "d"]
    for boundary in (True, False):
        want = pairs.distance_join(some, some, 6.0, boundary).select(*cols).collect()
        assert sorted(pairs.nested_loop_join(some, some, 6.0, boundary).select(*cols).collect()) == sorted(want)
    monkeypatch.setattr(pairs, "NESTED_ROWS", 5)
    with pytest.raises(ValueError, match="5 rows at most"):
        pairs.nested_loop_join(some, some, 6.0)
    with pytest.raises(ValueError, match="negative"):
        pairs.nested_loop_join(some, some, -1.0)


def test_points_at_exact_distance(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0), (2, 3.0, 4.0), (3, -5.0, 0.0)], "pid long, x double, y double")
    assert pairs.distance_join(df, df, 5.0).count() == 7
    assert pairs.distance_join(df, df, 5.0, boundary=False).count() == 3
    assert pairs.distance_join(df, df, 0.0).count() == 3


def test_multiplicities_equal_repeated_rows(some):
    box = envelope_region(some)
    scale = Scale(6.0, 3, 4, 2, "DAYS")
    twice, counted = some.unionByName(some), some.withColumn("cnt", F.lit(2))
    for f in (kfunction.space_k, kfunction.st_k):
        a, b = (sorted(map(tuple, f(df, box, scale).drop("pairs").collect())) for df in (twice, counted))
        for x, y in zip(a, b):
            assert x == pytest.approx(y)


def test_curves_grow(some):
    box = envelope_region(some)
    rows = kfunction.st_k(some, box, Scale(6.0, 3, 4, 2, "DAYS")).collect()
    at = {(r["i"], r["j"]): r["sigma"] for r in rows}
    assert len(at) == 6 and all(at[i, j] <= at[i + 1, j] for i in (1, 2) for j in (1, 2)) and all(at[i, 1] <= at[i, 2] for i in (1, 2, 3))


def test_empty_pattern_gives_a_full_grid(some):
    none = some.where("false")
    assert [r["sigma"] for r in kfunction.space_k(none, SQUARE, Scale(2.0, 4)).collect()] == [0.0] * 4
    region = Rectangle(0, 1, 0, 1, T, T)
    assert kfunction.st_k(none, region, Scale(2.0, 4, 4, 2)).count() == 8
    with pytest.raises(ValueError):
        envelope_region(none)


def test_local_sums_to_global(some):
    box = envelope_region(some)
    scale = Scale(6.0, 3)
    local = {r["i"]: r["s"] for r in kfunction.local_k(some, box, scale).groupBy("i").agg(F.sum("sigma").alias("s")).collect()}
    whole = {r["i"]: r["sigma"] for r in kfunction.space_k(some, box, scale).collect()}
    assert local == pytest.approx(whole)
    alone = kfunction.local_k(some, box, scale, include_self=False).where("i = 1").agg(F.sum("sigma")).first()[0]
    assert alone == pytest.approx(whole[1] - some.count())


def test_simulations(some):
    times = sorted(r["t"] for r in some.collect())
    dealt = simulate.permuted_times(some, 3)
    for k in (1, 2, 3):
        assert sorted(r["t"] for r in dealt.where(F.col("sim") == k).collect()) == times
    drawn = simulate.bootstrap(some, 3)
    assert {r["n"] for r in drawn.groupBy("sim").agg(F.sum("cnt").alias("n")).collect()} == {some.count()}
    box = envelope_region(some)
    for r in simulate.space_envelope(some, box, Scale(6.0, 3), 3).collect():
        assert r["l_min"] <= r["l_max"]
    house = Polygon(((0, 0), (0, 4), (2, 6), (4, 4), (4, 0), (0, 0)), (((1, 1), (1, 2), (2, 2), (2, 1), (1, 1)),))
    csr = simulate.monte_carlo(some.sparkSession, house, 50, 2).collect()
    sliver = Polygon(((0, 0), (100, 99.9), (100, 100), (0, 0)))
    assert simulate.monte_carlo(some.sparkSession, sliver, 1, 300).count() == 300
    assert simulate.space_envelope(some, box, Scale(6.0, 3), 0).count() == 0
    assert len(csr) == 100 and not any(1 < r["x"] < 2 and 1 < r["y"] < 2 for r in csr)


def test_slots_number_all_rows(some):
    got = sorted(r["slot"] for r in pairs.slots(some, F.md5(F.col("pid").cast("string"))).collect())
    assert got == list(range(1, some.count() + 1))


def test_readers(spark, tmp_path):
    (tmp_path / "p.csv").write_text('30.5,114.3,"07/04/2001 10:11:12"\n1,2,bad\n,3,"07/04/2001 10:11:12"\n')
    rows = pts.read_csv(spark, str(tmp_path / "p.csv")).collect()
    assert [tuple(r) for r in rows] == [(1, 30.5, 114.3, datetime(2001, 7, 4, 10, 11, 12))]
    assert pts.read_csv(spark, str(tmp_path / "p.csv"), constant_time=True).count() == 2
    assert pts.read_csv(spark, str(tmp_path / "p.csv"), constant_time=True, size=1).count() == 1
    (tmp_path / "i.csv").write_text("1,2,2001-07-04T10:11:12\n")
    assert pts.read_csv(spark, str(tmp_path / "i.csv"), formatted=False).first()["t"] == datetime(2001, 7, 4, 10, 11, 12)
    (tmp_path / "t.txt").write_text('"30.5","114.3","1999"\nx,y\n')
    assert [tuple(r) for r in pts.read_text(spark, str(tmp_path / "t.txt")).collect()] == [(1, 30.5, 114.3, datetime(1999, 6, 30))]
    assert pts.from_rows(spark, [(1, 1.0, 2.0, T)]).count() == 1


def test_geojson(spark, tmp_path):
    ring, hole = "[[1,2],[1,8],[9,8],[9,2],[1,2]]", "[[3,3],[3,4],[4,4],[3,3]]"
    feature = lambda c: '{"type":"Feature","geometry":{"type":"Polygon","coordinates":[%s]},"properties":{}}' % c
    doc = '{"type":"FeatureCollection","features":[%s]}'
    (tmp_path / "one.json").write_text(doc % feature(f"{ring},{hole}"))
    got = read_geojson(spark, str(tmp_path / "one.json"))
    assert got.outline[1] == (8.0, 1.0) and got.area == 48 - 0.5
    assert read_geojson(spark, str(tmp_path / "one.json"), project=True).outline[0][0] == pytest.approx(111319.49, abs=0.01)
    (tmp_path / "two.json").write_text(doc % ",".join([feature(ring)] * 2))
    with pytest.raises(ValueError):
        read_geojson(spark, str(tmp_path / "two.json"))


def test_region_volume():
    box = Rectangle(0, 2, 0, 3, datetime(2024, 1, 1), datetime(2024, 1, 1, 5))
    assert box.volume("DAYS") == 6 and box.volume("HOURS") == 30 and PAD > 0


def test_envelopes(spark):
    e = lambda *v: envelopes.envelope(*(F.lit(x) for x in v))
    a, b = e(0.0, 2.0, 0.0, 2.0, T, T), e(3.0, 2.0, 0.0, 2.0, T, T)
    assert tuple(one(spark, envelopes.adjacent(a, b), envelopes.intersects(a, b), envelopes.covers(a, a), envelopes.contains(a, a))) == (True, True, True, False)
    none = F.lit(None).cast("struct<x0:double,x1:double,y0:double,y1:double,t0:timestamp_ntz,t1:timestamp_ntz>")
    r = one(spark, envelopes.union(a, none)["x1"], envelopes.union(none, b)["x0"], envelopes.intersects(a, none), envelopes.intersection(a, e(9.0, 8.0, 0.0, 1.0, T, T)).isNull(), envelopes.ring_area(envelopes.ring(a)))
    assert tuple(r) == (2.0, 2.0, False, True, 4.0)


def test_result_files(spark, some, tmp_path):
    box = envelope_region(some)
    request = {"ktype": "ST", "maxSpatialDistance": 6, "maxTemporalDistance": 4, "spatialStep": 3, "temporalStep": 2, "simulationTimes": 2, "dataName": "p"}
    got = run_kfunction(spark, request, {"p": some}, box)
    assert len(got["kest"]) == 4 and len(got["kest"][0]) == 3 and got["kest"][0] == [0.0] * 3 and [r[0] for r in got["kest"]] == [0.0] * 4
    path = results.write_json(spark, got, str(tmp_path), 150)
    cells = results.read_matrices(spark, [path])
    merged = {(r["i"], r["j"]): r for r in results.merge(cells).collect()}
    assert merged[3, 2]["kest"] == got["kest"][3][2] and merged[3, 2]["kmax"] == got["kmax"][3][2] >= merged[3, 2]["kmin"]


def test_request_facade(spark, some):
    base = {"maxSpatialDistance": 6, "spatialStep": 3, "simulationTimes": 0, "dataName": "a", "dataName2": "b"}
    data = {"a": some.where("mark = 'a'"), "b": some.where("mark = 'b'")}
    box = envelope_region(some)
    assert len(run_kfunction(spark, base | {"ktype": "S"}, data, box)["kest"]) == 4
    assert len(run_kfunction(spark, base | {"ktype": "Cross"}, data, box)["kest"]) == 4
    local = run_kfunction(spark, base | {"ktype": "L"}, data, box)["kest"].collect()
    assert len(local) == 75 and len(local[0]["k"]) == 4
    for kind in ("S", "Cross", "ST"):
        got = run_kfunction(spark, base | {"ktype": kind, "simulationTimes": 2, "simulationType": "random", "maxTemporalDistance": 4, "temporalStep": 2}, data, box)
        assert len(got["kmin"]) == len(got["kmax"]) == len(got["kest"])
    edges = {(k, c): run_kfunction(spark, base | {"ktype": k, "edgeCorrection": c, "maxTemporalDistance": 4, "temporalStep": 2}, data, box)["kest"] for k in ("S", "ST", "Cross") for c in ("none", "translation", "border") if (k, c) != ("Cross", "border")}
    assert all(edges[k, "none"][3] != edges[k, "translation"][3] for k in ("S", "ST", "Cross")) and edges["S", "border"][3] != edges["S", "translation"][3]
    for bad in ({"ktype": "S", "edgeCorrection": "z"}, {"ktype": "L", "edgeCorrection": "border"}, {"ktype": "S", "edgeCorrection": "border", "simulationTimes": 2}, {"ktype": "X"}, {"ktype": "L", "simulationType": "random"}, {"ktype": "S", "simulationType": "z"}, {"ktype": "S", "dataName": "z"}, {"ktype": "Cross", "dataName2": "a"}, {"ktype": "S", "maxSpatialDistance": 0}):
        with pytest.raises(ValueError):
            run_kfunction(spark, base | bad, data, box)


def test_simulations_in_blocks(spark, some, monkeypatch):
    """Blocks of simulations give the rows of one block."""
    box, scale = envelope_region(some), Scale(6.0, 3, 4, 2)
    a, b = some.where("mark = 'a'"), some.where("mark = 'b'")
    forms = {
        "space": lambda: simulate.space_envelope(a, box, scale, 5),
        "cross": lambda: simulate.cross_envelope(a, b, box, scale, 5),
        "local": lambda: simulate.local_envelope(a, box, scale, 5),
        "st": lambda: simulate.st_envelope(a, box, scale, 5),
    }
    flat = lambda df: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect())
    want = {k: flat(f()) for k, f in forms.items()}
    monkeypatch.setattr(simulate, "BLOCK_SIMS", 2)
    assert all(want[k] and flat(f()) == want[k] for k, f in forms.items())
    assert simulate.space_envelope(a, box, scale, 0).count() == 0


def test_first_points_of_many(spark):
    """A large size isn't sorted whole; ties, nulls and far-off pids keep their order."""
    rows = [(None, 1.0, 0.0), (5, 3.0, 0.0), (5, 2.0, 1.0), (5, 2.0, 0.0), (-(2**63), 9.0, 9.0), (2**63 - 1, 8.0, 8.0), (7, 1.0, 1.0)]
    table = spark.createDataFrame(rows, "pid long, x double, y double")
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    for size in range(9):
        assert sorted(map(tuple, pts.first_points(table, size).collect()), key=repr) == sorted(order[:size], key=repr)
    many = spark.range(100_000).select((F.col("id") * 3).alias("pid"), F.lit(0.0).alias("x"))
    got = pts.first_points(many, 70_001)
    assert got.count() == 70_001 and got.agg(F.max("pid")).first()[0] == 210_000
    assert pts.first_points(many.drop("pid"), 3).count() == 3 and pts.first_points(many.where("false"), 3).count() == 0


def test_random_patterns_stay_apart(spark):
    """Each simulation has n points of the region and its time, paired within the simulation only."""
    box = Rectangle(0.0, 40.0, 0.0, 20.0, T, T + timedelta(days=9))
    drawn = simulate.monte_carlo(spark, box, 60, 3)
    rows = drawn.collect()
    assert len({(r["sim"], r["pid"]) for r in rows}) == 180 and all(T <= r["t"] < T + timedelta(days=9) and 0 < r["x"] < 40 and 0 < r["y"] < 20 for r in rows)
    want = sum(a["sim"] == b["sim"] and (a["x"] - b["x"]) ** 2 + (a["y"] - b["y"]) ** 2 <= 9 for a in rows for b in rows)
    joined = pairs.distance_join(drawn, drawn, 3.0, by=("sim",))
    assert joined.count() == want and joined.where("sim_a <> sim_b").count() == 0
    assert simulate.csr_envelope(spark, box, 60, Scale(3.0, 3), 0).count() == 0 and simulate.csr_envelope(spark, box, 0, Scale(3.0, 3), 2).count() == 0
    with pytest.raises(ValueError):
        simulate.csr_st_envelope(spark, Rectangle(0.0, 1.0, 0.0, 1.0), 5, Scale(1.0, 1, 2, 1), 2)


def test_all_kinds_from_a_file(spark, some, tmp_path):
    """CSV points to kest, kmin and kmax of every kind; local results are written as rows."""
    def write(name, part):
        lines = [f'{r["x"]},{r["y"]},"{r["t"]:%m/%d/%Y %H:%M:%S}"' for r in part.collect()]
        (tmp_path / name).write_text("\n".join([*lines, lines[0], "bad,row,"]))
        return pts.read_csv(spark, str(tmp_path / name))

    data = {"a": write("a.csv", some.where("mark = 'a'")), "b": write("b.csv", some.where("mark = 'b'"))}
    assert sorted(r["pid"] for r in data["a"].collect()) == list(range(1, 77))
    base = {"maxSpatialDistance": 6, "spatialStep": 3, "maxTemporalDistance": 4, "temporalStep": 2, "simulationTimes": 3, "dataName": "a", "dataName2": "b"}
    for kind in ("S", "ST", "Cross"):
        got = run_kfunction(spark, base | {"ktype": kind}, data)
        flat = lambda m: [v for r in m for v in r] if kind == "ST" else m
        low, high = flat(got["kmin"]), flat(got["kmax"])
        assert len(low) == len(high) == len(flat(got["kest"])) and all(a <= b for a, b in zip(low, high) if a is not None)
    got = run_kfunction(spark, base | {"ktype": "L"}, data)
    path = results.write_json(spark, got, str(tmp_path), 76)
    rows = spark.read.json(f"{path}.kest").collect()
    assert len(rows) == 76 and all(len(r["k"]) == len(r["kmin"]) == len(r["kmax"]) == 4 for r in rows)
    assert all(a <= b for r in rows for a, b in zip(r["kmin"], r["kmax"]))


def test_envelopes_equal_curves_of_each_pattern(spark, some):
    """The shared pairs give what K of every drawn pattern alone gives."""
    box = envelope_region(some)
    scale = Scale(6.0, 3, 4, 2, "DAYS")
    drawn = simulate.bootstrap(some, 3)
    curves = []
    for k in (1, 2, 3):
        pattern = some.join(drawn.where(F.col("sim") == k), "pid").select("x", "y", "cnt")
        curves.append([r["l"] for r in kfunction.space_k(pattern, box, scale).orderBy("i").collect()])
    band = simulate.space_envelope(some, box, scale, 3).orderBy("i").collect()
    assert [r["l_min"] for r in band] == pytest.approx([min(c) for c in zip(*curves)])
    assert [r["l_max"] for r in band] == pytest.approx([max(c) for c in zip(*curves)])
    times, surfaces = simulate.permuted_times(some, 2), []
    for k in (1, 2):
        pattern = some.drop("t").join(times.where(F.col("sim") == k), "pid").select("pid", "x", "y", "t")
        surfaces.append({(r["i"], r["j"]): r["l"] for r in kfunction.st_k(pattern, box, scale).collect()})
    for r in simulate.st_envelope(some, box, scale, 2).collect():
        pair = [s[r["i"], r["j"]] for s in surfaces]
        assert (r["l_min"], r["l_max"]) == pytest.approx((min(pair), max(pair)))


def test_local_of_an_empty_pattern(some):
    assert kfunction.local_k(some.where("false"), SQUARE, Scale(2.0, 4)).count() == 0


def test_reference_systems_must_agree(spark):
    df = spark.createDataFrame([(1, 30.5, 114.3)], "pid long, x double, y double")
    metres = crs.transform(df, "EPSG:4326", "EPSG:3857")
    assert crs.crs_of(metres) == "EPSG:3857" and pairs.distance_join(metres, metres, 1.0).count() == 1
    with pytest.raises(ValueError):
        pairs.distance_join(df, metres, 1.0)


def test_circles_and_holes(spark):
    ring = lambda *p: F.array(*(F.struct(F.lit(float(a)).alias("x"), F.lit(float(b)).alias("y")) for a, b in p))
    outline, hole = ring((0, 0), (0, 10), (10, 10), (10, 0), (0, 0)), ring((3, 3), (3, 7), (7, 7), (7, 3), (3, 3))
    for x, y, r, want in ((5, 5, 1, False), (5, 5, 2, True), (1, 1, 0.5, True), (20, 5, 1, False), (11, 5, 1, True)):
        c = circles.circle(F.lit(float(x)), F.lit(float(y)), F.lit(T), r, 0, "DAYS")
        assert one(spark, circles.intersects_polygon(c, outline, F.array(hole)))[0] is want


def test_epochs_of_zones(spark):
    t = F.lit("2024-07-01 12:00:00").cast("timestamp_ntz")
    ms = timeunits.to_epoch_ms(t, "Asia/Shanghai")
    assert tuple(one(spark, ms, timeunits.from_epoch_ms(ms, "Asia/Shanghai"), timeunits.from_epoch_ms(ms))) == (1719806400000, datetime(2024, 7, 1, 12), datetime(2024, 7, 1, 4))


def test_time_cells_of_calendar_units(spark):
    """Partners at the ends of long months and leap years are found."""
    days = [datetime(2023, 12, 31), datetime(2024, 1, 31), datetime(2024, 2, 29), datetime(2024, 3, 31), datetime(2025, 2, 28), datetime(2025, 3, 1), datetime(1969, 12, 31, 23, 59, 59)]
    df = spark.createDataFrame([(k, 0.0, 0.0, t) for k, t in enumerate(days)], "pid long, x double, y double, t timestamp_ntz")
    for unit, span in (("MONTHS", 1), ("YEARS", 1), ("DAYS", 31), ("SECONDS", 0), ("YEARS", 60)):
        a, b = df.select(F.col("pid").alias("pa"), F.col("t").alias("ta")), df.select(F.col("pid").alias("pb"), F.col("t").alias("tb"))
        near = (F.col("tb") >= timeunits.shift(unit, F.col("ta"), -span)) & (F.col("tb") <= timeunits.shift(unit, F.col("ta"), span))
        want = {tuple(r) for r in a.join(b, near).select("pa", "pb").collect()}
        got = [tuple(r) for r in pairs.st_join(df, df, 1.0, span, unit).select("pid_a", "pid_b").collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_cube(some):
    c = cube.Constraints(("a",), box=(0, 20, 0, 30))
    assert cube.total(some, c).first()["n"] == some.where("mark = 'a' AND x <= 20").count()
    assert cube.total(some, c.without("categories", "box")).first()["n"] == some.count()
    assert cube.widen(3600, 86400 * 30, 100) == 28800
    assert cube.time_bins("2009-01-01_00:00:00_1h") == (datetime(2009, 1, 1), 3600)
    assert cube.time_bins("2009-01-01_06:30:00_1d12h5m2s") == (datetime(2009, 1, 1, 6, 30), 129902)
    for wrong in ("2009-01-01_00:00:00", "2009-01-01_00:00:00_0h", "2009-01-01_00:00:00_1w"):
        with pytest.raises(ValueError):
            cube.time_bins(wrong)
    far = some.select(F.lit(89.9).alias("lat"), F.lit(180.0).alias("lon"), "pid")
    assert [tuple(r) for r in cube.tile_counts(far, 3).collect()] == [(7, 0, some.count())]


def test_range_filter_reaches_the_scan(spark, sf):
    plan = pairs.range_query(pts.events(spark, sf), 1.0, 2.0, 3.0, 4.0).select("pid")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(value)" in plan and "props" not in plan


def test_rest_stands_without_the_training_operators():
    """Nothing outside the subpackage imports it, except the guarded entry."""
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    for f in (root / "pointloom").rglob("*.py"):
        if "llm" not in f.parts:
            assert "llm" not in f.read_text()


def test_entry_imports_without_the_training_operators(tmp_path):
    """The rest, copied without both folders and the pipeline, still offers its queries."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root / "pointloom", tmp_path / "pointloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) >= 80 and not any(k.startswith('op') for k in q) and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)
