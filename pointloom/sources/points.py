"""Point tables (pid, x, y, t, mark, cnt) from CSV, text, lists and the test tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.slots import slots

CSV_SCHEMA = "latitude double, longitude double, time string"
CONSTANT_TIME = "07/01/1996 00:00:00"
FORMAT = "MM/dd/yyyy HH:mm:ss"


def parse_time(text: Column, formatted: bool = True) -> Column:
    """Zone-free time of a text, quotes ignored: month/day/year with a time, or ISO. Null if malformed."""
    bare = F.trim(F.replace(text, F.lit('"'), F.lit("")))
    if formatted:
        return F.try_to_timestamp(bare, F.lit(FORMAT)).cast("timestamp_ntz")
    return bare.try_cast("timestamp_ntz")


def read_csv(spark: SparkSession, path: str, formatted: bool = True, size: int | None = None, constant_time: bool = False) -> DataFrame:
    """Points of a headerless latitude, longitude, time file; x is the latitude.

    pid numbers the rows from 1 in the order of a digest of their contents, so it repeats on every
    run; with size the first rows in that order stay. With constant_time the time column is ignored. Rows without coordinates (or time) go.
    """
    raw = spark.read.schema(CSV_SCHEMA).csv(path)
    when = parse_time(F.lit(CONSTANT_TIME)) if constant_time else parse_time(F.col("time"), formatted)
    pts = raw.select(F.col("latitude").alias("x"), F.col("longitude").alias("y"), when.alias("t")).where("x IS NOT NULL AND y IS NOT NULL AND t IS NOT NULL")
    pts = _numbered(pts)
    return first_points(pts, size) if size is not None else pts


def _numbered(points: DataFrame) -> DataFrame:
    """points (x, y, t) with a pid, without sorting them in one task."""
    content = F.md5(F.concat_ws("|", *(F.col(c).cast("string") for c in points.columns)))
    return slots(points, content).select(F.col("slot").alias("pid"), *points.columns)


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """Points of lines latitude, longitude, year, possibly quoted; a year means its 30 June. pid as in read_csv()."""
    part = F.split(F.replace(F.col("value"), F.lit('"'), F.lit("")), ",")
    number = lambda k: F.trim(part.getItem(k)).try_cast("double")
    year = F.trim(part.getItem(2)).try_cast("int")
    when = F.make_timestamp_ntz(year, F.lit(6), F.lit(30), F.lit(0), F.lit(0), F.lit(0))
    pts = spark.read.text(path).select(number(0).alias("x"), number(1).alias("y"), when.alias("t")).where("x IS NOT NULL AND y IS NOT NULL AND t IS NOT NULL")
    return _numbered(pts)

#: Ranges of pids that first_points() counts.
PID_RANGES = 4096


def from_rows(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """In-memory points: (pid, x, y, t)."""
    return spark.createDataFrame(rows, "pid bigint, x double, y double, t timestamp_ntz")


def first_points(points: DataFrame, size: int) -> DataFrame:
    """The first points by pid, or by all columns where there is none: a limit that repeats.

    Whole numbers as pids are counted in PID_RANGES equal ranges: those before the last one that is needed stay
    as they are, and only that one's points are put in order, so a large size needs no task that holds
    it. Points of one pid are taken in the order of the other columns; null pids come first.
    """
    order = ["pid", *(c for c in points.columns if c != "pid")] if "pid" in points.columns else list(points.columns)
    if "pid" not in points.columns or points.schema["pid"].dataType.typeName() not in ("byte", "short", "integer", "long"):
        return points.orderBy(*order).limit(size)
    low, high = points.agg(F.min("pid"), F.max("pid")).first()
    if low is None or size <= 0:
        return points.orderBy(*order).limit(max(0, size))
    width = (high - low) // PID_RANGES + 1
    place = F.coalesce(F.floor((F.col("pid").cast("decimal(20,0)") - F.lit(low)) / F.lit(width)).cast("int"), F.lit(-1))
    counts = sorted(points.groupBy(place.alias("k")).count().collect())  # a row per range
    before, edge = 0, None
    for k, n in counts:
        if before + n > size:
            edge = k
            break
        before += n
    if edge is None:
        return points
    return points.where(place < edge).unionByName(points.where(place == edge).orderBy(*order).limit(size - before))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    src = spark.read.parquet(f"{sf_dir}/events.parquet")
    pts = src.select(F.col("event_id").alias("pid"), F.col("value").alias("x"), F.col("user_id").cast("double").alias("y"), F.col("ts").alias("t"), F.col("event_type").alias("mark"))
    return pts.where("x IS NOT NULL AND y IS NOT NULL")


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    src = spark.read.parquet(f"{sf_dir}/orders.parquet")
    pts = src.select(F.col("o_orderkey").alias("pid"), (F.col("o_totalprice") / 1000).alias("x"), F.col("o_custkey").cast("double").alias("y"), F.col("o_orderdate").alias("t"), F.col("o_orderstatus").alias("mark"))
    return pts.where("x IS NOT NULL AND y IS NOT NULL")


def latlon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events spread over the globe: for the projection and tile operators."""
    src = spark.read.parquet(f"{sf_dir}/events.parquet")
    lon = -180.0 + 360.0 * ((F.col("event_id") * 7919) % 10007) / 10007.0
    lat = -80.0 + 160.0 * ((F.col("event_id") * 104729 + F.col("user_id")) % 10009) / 10009.0
    return src.select(F.col("event_id").alias("pid"), lat.alias("lat"), lon.alias("lon"), F.col("ts").alias("t"), F.col("event_type").alias("mark"))


def pattern_stats(points: DataFrame) -> DataFrame:
    """Count and bounding box of a pattern in one pass."""
    return points.agg(F.count("*").alias("n"), *(f(c).alias(f"{g}_{c}") for c in ("x", "y", "t") for f, g in ((F.min, "min"), (F.max, "max"))))


def fold(points: DataFrame, *by: str) -> DataFrame:
    """Distinct places (and times) with their multiplicity cnt; an existing cnt is added up."""
    many = F.sum("cnt") if "cnt" in points.columns else F.count("*")
    return points.groupBy(*(by or ("x", "y", "t"))).agg(many.cast("bigint").alias("cnt"))
