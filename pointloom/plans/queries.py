"""Queries over the test tables, one per operator: functions of (spark, sf_dir)."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import circles, crs, envelopes, timeunits, weights
from ..operators import cube, kfunction, layout, pairs, regions, simulate, weighttable
from ..operators.kfunction import Scale
from ..sources import points as pts
from ..sources import results
from ..sources.boundary import Polygon, Rectangle, envelope_region

# Fixed values shared with the SQL twins.
SPACE = Scale(10.0, 5)
DAYS = Scale(10.0, 5, 5, 5, "DAYS")
MONTHS = Scale(10.0, 5, 12, 4, "MONTHS")
SIM = Scale(5.0, 5)
SIM_ST = Scale(5.0, 5, 5, 5, "DAYS")
SIMS = 3
BASE = datetime(2024, 1, 1)
BOX = (50.0, 150.0, 2.0, 9.0)
WHEN = (datetime(2024, 1, 5), datetime(2024, 1, 15))
MARKS = ("click", "error", "purchase", "signup", "view")
ZOOM = 4
#: Outline and hole of a polygon, as shares of a rectangle's sides.
HOUSE = (((0, 0), (0, 0.71), (0.13, 1), (1, 1), (1, 0.23), (0.87, 0), (0, 0)), ((0.41, 0.43), (0.53, 0.43), (0.47, 0.61), (0.41, 0.43)))
#: A concave polygon.
OUTLINE = ((-1.3, -1.7), (-0.9, 500.3), (120.7, 900.1), (340.9, 480.7), (600.3, -2.1), (150.2, 3.3), (-1.3, -1.7))

QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _r(c, digits: int = 6):
    return F.round(F.col(c) if isinstance(c, str) else c, digits)


# -- sources -----------------------------------------------------------------------------


@query
def point_scan_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pts.first_points(pts.events(spark, sf_dir), 500)


@query
def pattern_stats(spark, sf_dir):
    return pts.pattern_stats(pts.events(spark, sf_dir))


@query
def replication_fold(spark, sf_dir):
    return pts.fold(pts.events(spark, sf_dir), "x", "y")


@query
def time_parse(spark, sf_dir):
    src = pts.events(spark, sf_dir)
    text = F.concat(F.lit('"'), F.date_format("t", "MM/dd/yyyy HH:mm:ss"), F.lit('"'))
    iso = F.date_format("t", "yyyy-MM-dd'T'HH:mm:ss")
    return src.select("pid", pts.parse_time(text).alias("from_text"), pts.parse_time(iso, formatted=False).alias("from_iso"), pts.parse_time(F.lit(pts.CONSTANT_TIME)).alias("constant"))


@query
def envelope_boundary(spark, sf_dir):
    box = envelope_region(pts.events(spark, sf_dir))
    return spark.range(1).select(*(F.lit(getattr(box, k)).alias(k) for k in ("x0", "x1", "y0", "y1")), F.lit(box.area).alias("area"))


# -- projections and calendar ----------------------------------------------------------------


@query
def crs_forward(spark, sf_dir):
    x, y = crs.forward(F.col("lat"), F.col("lon"))
    return pts.latlon(spark, sf_dir).select("pid", _r(x, 4).alias("x"), _r(y, 4).alias("y"))


@query
def crs_inverse(spark, sf_dir):
    moved = crs.transform(pts.latlon(spark, sf_dir).select("pid", F.col("lat").alias("x"), F.col("lon").alias("y")), "EPSG:4326", "EPSG:3857")
    back = crs.transform(moved, "EPSG:3857", "EPSG:4326")
    return back.select("pid", _r("x", 6).alias("lat"), _r("y", 6).alias("lon"))


@query
def latlng_to_tile(spark, sf_dir):
    tx, ty = crs.tile_of(F.col("lat"), F.col("lon"), 9)
    _, south = crs.tile_of(F.col("lat"), F.col("lon"), 9, flip_y=True)
    return pts.latlon(spark, sf_dir).select("pid", tx.alias("tile_x"), ty.alias("tile_y"), south.alias("tile_y_south"))


@query
def tile_to_latlng(spark, sf_dir):
    tx, ty = crs.tile_of(F.col("lat"), F.col("lon"), 9)
    lat, lon = crs.tile_centre(F.col("tx"), F.col("ty"), 9)
    return pts.latlon(spark, sf_dir).select("pid", tx.alias("tx"), ty.alias("ty")).select("pid", _r(lat).alias("lat"), _r(lon).alias("lon"))


@query
def time_trunc(spark, sf_dir):
    return pts.events(spark, sf_dir).select("pid", *(timeunits.truncate(u, F.col("t")).alias(u.name.lower()) for u in timeunits.Unit))


@query
def epoch_convert(spark, sf_dir):
    ms = timeunits.to_epoch_ms(F.col("t"))
    return pts.events(spark, sf_dir).select("pid", ms.alias("ms"), timeunits.from_epoch_ms(ms).alias("back"))


def _next(points: DataFrame, *cols: str) -> DataFrame:
    """Each point with the point of the next pid, as columns x2 and so on."""
    other = points.select((F.col("pid") - 1).alias("pid"), *(F.col(c).alias(f"{c}2") for c in cols))
    return points.select("pid", *cols).join(other, "pid")


def _tdist(name: str, source, jump: int):
    def run(spark, sf_dir):
        src = source(spark, sf_dir)
        other = src.select((F.col("pid") - jump).alias("pid"), F.col("t").alias("t2"))
        return src.join(other, "pid").select("pid", timeunits.distance(name, F.col("t"), F.col("t2")).alias("n"))

    run.__name__ = f"tdist_{name.lower()}"
    return query(run)


for _name, _source in (("YEARS", pts.orders), ("MONTHS", pts.orders), ("DAYS", pts.orders), ("HOURS", pts.events), ("MINUTES", pts.events), ("SECONDS", pts.events)):
    _tdist(_name, _source, 1)


# -- envelopes and predicates ----------------------------------------------------------------


def _boxes(spark, sf_dir) -> DataFrame:
    """Pairs of boxes around neighbouring events, on a coarse lattice so that faces coincide."""
    src = _next(pts.events(spark, sf_dir), "x", "y", "t")
    lattice = lambda c, k: F.floor(F.col(c) / k) * F.lit(float(k))
    day = lambda c: F.date_trunc("DAY", F.col(c)).cast("timestamp_ntz")

    def box(s: str, w: float, days: int):
        x, y, t = lattice(f"x{s}", 40), lattice(f"y{s}", 4), day(f"t{s}")
        return envelopes.envelope(x + w, x, y, y + w / 10, timeunits.shift("DAYS", t, days), t)

    return src.select("pid", box("", 80.0, 3).alias("a"), box("2", 40.0, 2).alias("b"))


@query
def envelope_area_volume(spark, sf_dir):
    e = F.col("a")
    return _boxes(spark, sf_dir).select("pid", envelopes.width(e).alias("width"), envelopes.height(e).alias("height"), envelopes.area(e).alias("area"), envelopes.interval(e, "HOURS").alias("hours"), envelopes.volume(e).alias("volume"))


def _flat(e, *extra):
    return [*extra, *(e[k].alias(k) for k in ("x0", "x1", "y0", "y1", "t0", "t1"))]


@query
def envelope_intersection(spark, sf_dir):
    return _boxes(spark, sf_dir).select("pid", envelopes.intersection(F.col("a"), F.col("b")).alias("e")).select(*_flat(F.col("e"), "pid"))


@query
def envelope_union(spark, sf_dir):
    return _boxes(spark, sf_dir).select("pid", envelopes.union(F.col("a"), F.col("b")).alias("e")).select(*_flat(F.col("e"), "pid"))


@query
def envelope_centre(spark, sf_dir):
    return _boxes(spark, sf_dir).select("pid", envelopes.centre(F.col("a")).alias("c")).select("pid", "c.*")


def _predicate(name: str):
    def run(spark, sf_dir):
        return _boxes(spark, sf_dir).select("pid", getattr(envelopes, name)(F.col("a"), F.col("b")).alias("holds"))

    run.__name__ = f"envelope_{name}"
    return query(run)


for _name in ("intersects", "covers", "contains", "adjacent"):
    _predicate(_name)


def _circles(spark, sf_dir) -> DataFrame:
    src = _next(pts.events(spark, sf_dir), "x", "y", "t")
    return src.withColumn("c", circles.circle(F.col("x"), F.col("y"), F.col("t"), 60.0, 10, "DAYS"))


@query
def circle_covers(spark, sf_dir):
    return _circles(spark, sf_dir).select("pid", circles.covers_point(F.col("c"), F.col("x2"), F.col("y2"), F.col("t2")).alias("holds"))


@query
def circle_contains(spark, sf_dir):
    return _circles(spark, sf_dir).select("pid", circles.contains_point(F.col("c"), F.col("x2"), F.col("y2"), F.col("t2")).alias("holds"))


def _ring(spark, sf_dir) -> DataFrame:
    e = envelopes.envelope(F.col("x2"), F.col("x2") + 30.0, F.col("y2"), F.col("y2") + 8.0, F.col("t2"), F.col("t2"))
    return _circles(spark, sf_dir).withColumn("ring", envelopes.ring(e))


@query
def circle_covers_polygon(spark, sf_dir):
    return _ring(spark, sf_dir).select("pid", circles.covers_ring(F.col("c"), F.col("ring")).alias("holds"))


@query
def circle_intersects_polygon(spark, sf_dir):
    return _ring(spark, sf_dir).select("pid", circles.intersects_ring(F.col("c"), F.col("ring")).alias("holds"))


@query
def polygon_area(spark, sf_dir):
    return _ring(spark, sf_dir).select("pid", _r(envelopes.ring_area(F.col("ring"))).alias("area"))


@query
def point_strings(spark, sf_dir):
    src = pts.events(spark, sf_dir)
    return src.select("pid", F.concat(F.lit("POINT ("), F.format_string("%.2f", F.col("x")), F.lit(" "), F.format_string("%.2f", F.col("y")), F.lit(")")).alias("spatial"), F.date_format("t", "yyyy-MM-dd HH:mm:ss").alias("temporal"))


# -- joins -------------------------------------------------------------------------------------


def _self(spark, sf_dir) -> DataFrame:
    return pts.events(spark, sf_dir).select("pid", "x", "y", "t")


@query
def distance_pairs(spark, sf_dir):
    p = pairs.distance_join(_self(spark, sf_dir).drop("t"), _self(spark, sf_dir).drop("t"), 2.0)
    return p.select("pid_a", "pid_b", _r("d").alias("d"))


@query
def distance_pairs_open(spark, sf_dir):
    p = pairs.distance_join(_self(spark, sf_dir).drop("t"), _self(spark, sf_dir).drop("t"), 2.0, boundary=False)
    return p.select("pid_a", "pid_b")


@query
def st_distance_pairs(spark, sf_dir):
    return pairs.st_join(_self(spark, sf_dir), _self(spark, sf_dir), 5.0, 3, "DAYS").select("pid_a", "pid_b", _r("d").alias("d"))


@query
def st_month_pairs(spark, sf_dir):
    src = pts.orders(spark, sf_dir).select("pid", "x", "y", "t")
    return pairs.st_join(src, src, 5.0, 6, "MONTHS").select("pid_a", "pid_b")


@query
def distance_count(spark, sf_dir):
    return pairs.count_per_left(pairs.distance_join(_self(spark, sf_dir).drop("t"), _self(spark, sf_dir).drop("t"), 5.0))


@query
def st_distance_count(spark, sf_dir):
    return pairs.count_per_left(pairs.st_join(_self(spark, sf_dir), _self(spark, sf_dir), 5.0, 3, "DAYS"))


@query
def distance_collect(spark, sf_dir):
    got = pairs.collect_per_left(pairs.distance_join(_self(spark, sf_dir).drop("t"), _self(spark, sf_dir).drop("t"), 2.0))
    return got.select("pid_a", F.array_join(F.col("partners").cast("array<string>"), ",").alias("partners"))


@query
def cross_pairs(spark, sf_dir):
    src = pts.events(spark, sf_dir)
    p = pairs.distance_join(src.where("mark = 'click'").select("pid", "x", "y"), src.where("mark = 'error'").select("pid", "x", "y"), 5.0)
    return p.select("pid_a", "pid_b", _r("d").alias("d"))


def _sized(spark, sf_dir, mark: str, *kept: str) -> DataFrame:
    """Boxes of very different sizes around the events of a mark, some of them points, with times up to five days long."""
    p = F.col("pid")
    far = F.when(p % 97 == 0, 80.0).otherwise(1.0)
    w, h = (p % 7) * 0.25 * far, (p % 5) * 0.125 * far
    src = pts.events(spark, sf_dir).where(F.col("mark") == mark)
    return src.select("pid", (F.col("x") - w).alias("x0"), (F.col("x") + w).alias("x1"), (F.col("y") - h).alias("y0"), (F.col("y") + h).alias("y1"), F.col("t").alias("t0"), F.timestamp_add("DAY", (p % 6).cast("int"), F.col("t")).alias("t1")).select("pid", *kept)


PLAN, WHOLE = ("x0", "x1", "y0", "y1"), ("x0", "x1", "y0", "y1", "t0", "t1")


@query
def box_pairs(spark, sf_dir):
    return pairs.box_join(_sized(spark, sf_dir, "click", *WHOLE), _sized(spark, sf_dir, "error", *WHOLE)).select("pid_a", "pid_b")


@query
def box_pairs_open(spark, sf_dir):
    return pairs.box_join(_sized(spark, sf_dir, "click", *WHOLE), _sized(spark, sf_dir, "error", *WHOLE), boundary=False).select("pid_a", "pid_b")


@query
def box_count(spark, sf_dir):
    return pairs.count_per_left(pairs.box_join(_sized(spark, sf_dir, "view", *PLAN), _sized(spark, sf_dir, "error", *PLAN)))


@query
def box_collect(spark, sf_dir):
    got = pairs.collect_per_left(pairs.box_join(_sized(spark, sf_dir, "purchase", *WHOLE), _sized(spark, sf_dir, "view", *WHOLE)))
    return got.select("pid_a", F.array_join(F.col("partners").cast("array<string>"), ",").alias("partners"))


@query
def circle_pairs(spark, sf_dir):
    """Radii that differ by row."""
    src = pts.events(spark, sf_dir)
    r = (F.col("pid") % 9) * F.when(F.col("pid") % 89 == 0, 10.0).otherwise(0.5)
    got = pairs.circle_join(src.where("mark = 'click'").select("pid", "x", "y", r.alias("r")), src.where("mark = 'signup'").select("pid", "x", "y"))
    return got.select("pid_a", "pid_b", _r("d").alias("d"))


@query
def range_query(spark, sf_dir):
    return pairs.range_query(pts.events(spark, sf_dir), *BOX, *WHEN).select("pid", "x", "y")


@query
def hilbert_range(spark, sf_dir):
    """A range query by intervals of Hilbert keys."""
    src = pts.events(spark, sf_dir)
    frame = envelope_region(src)
    return layout.layout_query(layout.along_curve(src, frame), frame, *BOX, *WHEN).select("pid", "x", "y")


@query
def index_remove(spark, sf_dir):
    src = pts.events(spark, sf_dir)
    return pairs.remove(src, pairs.range_query(src, *BOX)).select("pid")


@query
def partition_envelopes(spark, sf_dir):
    return pairs.cell_envelopes(pts.events(spark, sf_dir), 50.0)


@query
def local_count_global_sum(spark, sf_dir):
    return kfunction.count_global(pairs.distance_join(_self(spark, sf_dir).drop("t"), _self(spark, sf_dir).drop("t"), 5.0))


# -- weights -----------------------------------------------------------------------------------


@query
def weight_spatial_rect(spark, sf_dir):
    src = pts.events(spark, sf_dir)
    box = envelope_region(src)
    return src.select("pid", *(_r(weights.rectangle_weight(box, F.col("x"), F.col("y"), F.lit(r)), 5).alias(f"w{int(r)}") for r in (0.0, 3.0, 10.0, 40.0)))


@query
def weight_temporal(spark, sf_dir):
    src = pts.orders(spark, sf_dir)
    box = envelope_region(src)
    t0, t1 = (F.lit(t).cast("timestamp_ntz") for t in (box.t0, box.t1))
    tau = lambda n: F.lit(n).cast("bigint")
    cases = (("days", "DAYS", 400), ("months", "MONTHS", 9), ("zero", "YEARS", 0))
    return src.select("pid", *(weights.temporal_weight(u, F.col("t"), tau(n), t0, t1).alias(name) for name, u, n in cases))


@query
def weight_combined(spark, sf_dir):
    src = pts.events(spark, sf_dir)
    box = envelope_region(src)
    t0, t1 = (F.lit(t).cast("timestamp_ntz") for t in (box.t0, box.t1))
    w = weights.rectangle_weight(box, F.col("x"), F.col("y"), F.lit(6.0)) * weights.temporal_weight("DAYS", F.col("t"), F.lit(4).cast("bigint"), t0, t1)
    return src.select("pid", _r(w, 5).alias("w"))


@query
def weight_translation(spark, sf_dir):
    src = pts.events(spark, sf_dir)
    box = envelope_region(src)
    return src.select("pid", _r(weights.translation_weight(box, F.col("x") / 10, F.col("y") / 10), 5).alias("w"))


# -- K functions -------------------------------------------------------------------------------


@query
def space_k(spark, sf_dir):
    src = pts.events(spark, sf_dir)
    got = kfunction.space_k(src, envelope_region(src), SPACE)
    return got.select("i", "d", "pairs", _r("sigma", 3).alias("sigma"), _r("k", 4).alias("k"))


@query
def space_l(spark, sf_dir):
    src = pts.events(spark, sf_dir)
    return kfunction.space_k(src, envelope_region(src), SPACE).select("i", "d", _r("l", 5).alias("l"))


@query
def space_l_translation(spark, sf_dir):
    src = pts.events(spark, sf_dir)
    return kfunction.space_k(src, envelope_region(src), SPACE, correction="translation").select("i", "d", _r("l", 5).alias("l"))


@query
def space_l_border(spark, sf_dir):
    src = pts.events(spark, sf_dir)
    return kfunction.border_space(src, envelope_region(src), Scale(5.0, 5)).select("i", "d", "pairs", "centres", _r("l", 5).alias("l"))


@query
def st_l_border(spark, sf_dir):
    src = pts.events(spark, sf_dir)
    got = kfunction.border_st(src, envelope_region(src), SIM_ST)
    return got.select("i", "j", "d", "tau", "pairs", "centres", _r("l", 5).alias("l"))


@query
def st_k(spark, sf_dir):
    src = pts.events(spark, sf_dir)
    got = kfunction.st_k(src, envelope_region(src), DAYS)
    return got.select("i", "j", "d", "tau", _r("sigma", 3).alias("sigma"), _r("k", 4).alias("k"))


@query
def st_l(spark, sf_dir):
    src = pts.events(spark, sf_dir)
    return kfunction.st_k(src, envelope_region(src), DAYS).select("i", "j", "d", "tau", _r("l", 5).alias("l"))


@query
def st_l_months(spark, sf_dir):
    src = pts.orders(spark, sf_dir)
    return kfunction.st_k(src, envelope_region(src), MONTHS).select("i", "j", "d", "tau", _r("l", 5).alias("l"))


@query
def st_text(spark, sf_dir):
    """The surface as printed lines of four decimals."""
    src = pts.events(spark, sf_dir)
    got = kfunction.st_k(src, envelope_region(src), DAYS)
    return results.pivot_text(got.withColumn("l", F.when(F.col("l").isNotNull(), F.format_string("%.4f", "l"))))


@query
def cross_l(spark, sf_dir):
    src = pts.events(spark, sf_dir)
    got = kfunction.cross_k(src.where("mark = 'click'"), src.where("mark = 'error'"), envelope_region(src), SPACE)
    return got.select("i", "d", "pairs", _r("l", 5).alias("l"))


@query
def local_l(spark, sf_dir):
    src = pts.events(spark, sf_dir)
    return kfunction.local_k(src, envelope_region(src), SIM).select("pid", "i", _r("l", 5).alias("l"))


def _districts(spark, sf_dir) -> DataFrame:
    """A house-shaped polygon with a hole for each region of the table, side by side across the events' rectangle."""
    box = envelope_region(pts.events(spark, sf_dir))
    rings = F.array(*(F.array(*(F.struct(F.lit(float(u)).alias("u"), F.lit(float(v)).alias("v")) for u, v in ring)) for ring in HOUSE))
    rows = spark.read.parquet(f"{sf_dir}/region.parquet").select(F.col("r_regionkey").cast("bigint").alias("region"), F.posexplode(rings).alias("ring", "line"))
    rows = rows.select("region", "ring", F.posexplode("line").alias("vertex", "p"))
    x = box.x0 + (F.col("region") + F.col("p.u")) * ((box.x1 - box.x0) / 5)
    return rows.select("region", "ring", "vertex", x.alias("x"), (box.y0 + F.col("p.v") * (box.y1 - box.y0)).alias("y"))


@query
def polygon_members(spark, sf_dir):
    """Every event with the polygon of a table that it lies in."""
    return regions.points_in(pts.events(spark, sf_dir).select("pid", "x", "y"), _districts(spark, sf_dir)).select("pid", "region")


@query
def polygon_counts(spark, sf_dir):
    return regions.count_in(pts.events(spark, sf_dir), _districts(spark, sf_dir))


@query
def multipolygon_filter(spark, sf_dir):
    """Events in a region of several parts, holes left out."""
    whole = _districts(spark, sf_dir).select(F.lit("all").alias("region"), F.col("region").alias("part"), "ring", "vertex", "x", "y").where("part <> 2")
    return regions.points_in(pts.events(spark, sf_dir).select("pid", "x", "y"), whole).select("pid")



def _house(spark, sf_dir) -> Polygon:
    """The events' rectangle with two corners cut off and a hole."""
    box = envelope_region(pts.events(spark, sf_dir))
    at = lambda u, v: (box.x0 + u * (box.x1 - box.x0), box.y0 + v * (box.y1 - box.y0))
    outline, hole = (tuple(at(*p) for p in ring) for ring in HOUSE)
    return Polygon(outline, (hole,), box.t0, box.t1)


def _inside(points: DataFrame, house: Polygon) -> DataFrame:
    rings = [F.array(*(F.struct(F.lit(a).alias("x"), F.lit(b).alias("y")) for a, b in ring)) for ring in house.rings()]
    return points.where(circles.inside_ring(F.col("x"), F.col("y"), rings[0]) & ~circles.inside_ring(F.col("x"), F.col("y"), rings[1]))


@query
def polygon_l(spark, sf_dir):
    """Space L in a polygon."""
    src = pts.events(spark, sf_dir)
    house = _house(spark, sf_dir)
    return kfunction.space_k(_inside(src, house), house, SPACE).select("i", "d", "pairs", _r("l", 5).alias("l"))


@query
def polygon_l_translation(spark, sf_dir):
    """Space L in a polygon by the area that it shares with its moved copies."""
    src = pts.events(spark, sf_dir)
    house = _house(spark, sf_dir)
    return kfunction.space_k(_inside(src, house), house, SPACE, correction="translation").select("i", "d", "pairs", _r("l", 5).alias("l"))


@query
def polygon_l_border(spark, sf_dir):
    src = pts.events(spark, sf_dir)
    house = _house(spark, sf_dir)
    return kfunction.border_space(_inside(src, house), house, Scale(5.0, 5)).select("i", "d", "pairs", "centres", _r("l", 5).alias("l"))


@query
def polygon_as_rectangle_translation(spark, sf_dir):
    """The shared area of a rectangle's ring: the closed form's SQL holds for it too."""
    src = pts.events(spark, sf_dir)
    box = envelope_region(src)
    return kfunction.space_k(src, Polygon(box.rings()[0], (), box.t0, box.t1), SPACE, correction="translation").select("i", "d", _r("l", 5).alias("l"))


@query
def polygon_as_rectangle_l(spark, sf_dir):
    """The polygon weight on a rectangle's ring: the closed form's SQL holds for it too."""
    src = pts.events(spark, sf_dir)
    box = envelope_region(src)
    return kfunction.space_k(src, Polygon(box.rings()[0], (), box.t0, box.t1), SPACE).select("i", "d", _r("l", 5).alias("l"))


@query
def polygon_filter(spark, sf_dir):
    ring = F.array(*(F.struct(F.lit(a).alias("x"), F.lit(b).alias("y")) for a, b in OUTLINE))
    src = pts.events(spark, sf_dir)
    return cube.Constraints(mask=lambda x, y: circles.inside_ring(x, y, ring)).apply(src).select("pid")


# -- simulations -------------------------------------------------------------------------------


@query
def perm_times(spark, sf_dir):
    return simulate.permuted_times(pts.events(spark, sf_dir), SIMS)


@query
def bootstrap_draw(spark, sf_dir):
    return simulate.bootstrap(pts.events(spark, sf_dir), SIMS)


@query
def sim_envelope_space(spark, sf_dir):
    src = pts.events(spark, sf_dir)
    got = simulate.space_envelope(src, envelope_region(src), SIM, SIMS)
    return got.select("i", "d", _r("l_min", 5).alias("l_min"), _r("l_max", 5).alias("l_max"))


@query
def sim_envelope_st(spark, sf_dir):
    src = pts.events(spark, sf_dir)
    got = simulate.st_envelope(src, envelope_region(src), SIM_ST, SIMS)
    return got.select("i", "j", "d", "tau", _r("l_min", 5).alias("l_min"), _r("l_max", 5).alias("l_max"))


#: Step of rounded weights.
STEP = 0.25


@query
def weight_table_l(spark, sf_dir):
    """L curve by weights of a table that the clicks' run has left and this one extends."""
    src = pts.events(spark, sf_dir)
    box = envelope_region(src)
    table = weighttable.new_weights(weighttable.pattern_pairs(src.where("mark = 'click'"), box, SPACE, STEP), box, STEP)
    curve, _ = weighttable.space_k(src, box, SPACE, STEP, table)
    return curve.select("i", "d", "pairs", _r("l", 5).alias("l"))


@query
def weight_table_hits(spark, sf_dir):
    """Of all events' pairs, how many find their weight in the table that the clicks' run has left."""
    src = pts.events(spark, sf_dir)
    box = envelope_region(src)
    table = weighttable.new_weights(weighttable.pattern_pairs(src.where("mark = 'click'"), box, SPACE, STEP), box, STEP)
    got = weighttable.hit_rates(weighttable.pattern_pairs(src, box, SPACE, STEP), table)
    return got.select("pairs", "misses", "hits", _r("hit_percent", 4).alias("hit_percent"))


@query
def monte_carlo_draw(spark, sf_dir):
    src = pts.events(spark, sf_dir)
    return simulate.monte_carlo(spark, envelope_region(src), src.count(), SIMS).select("sim", "pid", _r("x").alias("x"), _r("y").alias("y"))


@query
def monte_carlo_space(spark, sf_dir):
    """L curves of complete randomness in a polygon."""
    house = _house(spark, sf_dir)
    drawn = simulate.monte_carlo(spark, house, 400, 1)
    return kfunction.space_k(drawn, house, Scale(50.0, 5)).select("i", "d", _r("l", 5).alias("l"))


@query
def csr_envelope(spark, sf_dir):
    """As many random points as there are events, in their box."""
    src = pts.events(spark, sf_dir)
    got = simulate.csr_envelope(spark, envelope_region(src), src.count(), SIM, SIMS)
    return got.select("i", "d", _r("l_min", 5).alias("l_min"), _r("l_max", 5).alias("l_max"))


@query
def csr_cross_envelope(spark, sf_dir):
    src = pts.events(spark, sf_dir)
    many = [src.where(F.col("mark") == mark).count() for mark in ("click", "error")]
    got = simulate.csr_cross_envelope(spark, envelope_region(src), *many, SIM, SIMS)
    return got.select("i", "d", _r("l_min", 5).alias("l_min"), _r("l_max", 5).alias("l_max"))


@query
def csr_st_envelope(spark, sf_dir):
    src = pts.events(spark, sf_dir)
    got = simulate.csr_st_envelope(spark, envelope_region(src), src.count(), SIM_ST, SIMS)
    return got.select("i", "j", "d", "tau", _r("l_min", 5).alias("l_min"), _r("l_max", 5).alias("l_max"))


@query
def result_merge(spark, sf_dir):
    """Merging K results: the categories' pair counts stand for files, in their names' order."""
    src = pts.events(spark, sf_dir)
    cells = src.select("mark", F.floor(F.col("x") / 100).cast("int").alias("i"), F.floor(F.col("y") / 5).cast("int").alias("j"), "x", "y")
    cells = cells.groupBy("mark", "i", "j").agg(F.count("*").cast("double").alias("kest"), F.min("x").alias("kmin"), F.max("x").alias("kmax"))
    kinds = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).alias("v")) for k in ("kest", "kmin", "kmax"))))
    return results.merge(cells.select("mark", "i", "j", kinds.alias("q")).select("mark", "i", "j", "q.*"), "mark")


# -- cube --------------------------------------------------------------------------------------


@query
def cube_category_filter(spark, sf_dir):
    return cube.Constraints(categories=("click", "view")).apply(pts.events(spark, sf_dir)).select("pid", "mark")


@query
def cube_category_counts(spark, sf_dir):
    return cube.category_counts(pts.events(spark, sf_dir))


@query
def cube_time_interval(spark, sf_dir):
    return cube.Constraints(start=WHEN[0], end=WHEN[1]).apply(pts.events(spark, sf_dir)).select("pid", "t")


@query
def cube_time_series(spark, sf_dir):
    return cube.time_series(pts.events(spark, sf_dir), BASE, cube.widen(3600, 30 * 86400, 300), 300)


@query
def cube_rect_count(spark, sf_dir):
    return cube.total(pts.events(spark, sf_dir), cube.Constraints(box=BOX))


@query
def cube_tile_counts(spark, sf_dir):
    return cube.tile_counts(pts.latlon(spark, sf_dir), ZOOM, 2)


@query
def cube_tile_stats(spark, sf_dir):
    return cube.tile_stats(cube.tile_counts(pts.latlon(spark, sf_dir), ZOOM, 2))


@query
def cube_topk(spark, sf_dir):
    src = pts.events(spark, sf_dir).withColumn("mark", F.concat("mark", (F.col("pid") % 17).cast("string")))
    return cube.top_categories(src, 25)


@query
def cube_total(spark, sf_dir):
    return cube.total(pts.events(spark, sf_dir), cube.Constraints(("click", "view"), *WHEN, BOX))


@query
def cube_crossfilter(spark, sf_dir):
    return cube.cross_filter_table(pts.events(spark, sf_dir), cube.Constraints(("click",), *WHEN, BOX), BASE, 86400, 40)


@query
def cube_pyramid(spark, sf_dir):
    """Every zoom level by category, from a cube of the finest one."""
    return cube.pyramid(cube.tile_cube(pts.latlon(spark, sf_dir), 7, "mark"), 7)


@query
def cube_merge(spark, sf_dir):
    """A cube of some categories merged with the others' points, one tile drilled down."""
    src = pts.latlon(spark, sf_dir)
    old = cube.tile_cube(src.where("mark <> 'click'"), 7)
    both = cube.merge_cubes(old, cube.tile_cube(src.where("mark = 'click'"), 7))
    return cube.drill_down(cube.pyramid(both, 7), 2, 1, 2, 3)


@query
def cube_time_bounds(spark, sf_dir):
    return cube.time_bounds(pts.events(spark, sf_dir))


@query
def cube_bbox(spark, sf_dir):
    return cube.bbox(pts.latlon(spark, sf_dir), "lat", "lon")


@query
def cube_pivot_grid(spark, sf_dir):
    got = cube.pivot_grid(pts.latlon(spark, sf_dir), ZOOM, MARKS)
    return got.withColumn("height", _r("height", 5))
