"""Study regions: rectangles and polygons with a time interval."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.timeunits import Unit

#: Distance by which a rectangle taken from the data is widened: points must not lie on the
#: border, where the weight is degenerate, nor circles touch it exactly.
PAD = 0.7310585


def units_between(unit: str | Unit, a: datetime, b: datetime) -> int:
    """Whole units between two times, by the rules of functions.timeunits.distance."""
    unit = Unit.of(unit)
    if b < a:
        a, b = b, a
    if unit in (Unit.YEARS, Unit.MONTHS):
        months = (b.year - a.year) * 12 + b.month - a.month
        months -= months > 0 and b.day < a.day
        return months // 12 if unit is Unit.YEARS else months
    if unit is Unit.DAYS:
        return (b.date() - a.date()).days
    return (b - a) // {Unit.HOURS: _hours(1), Unit.MINUTES: _hours(1) / 60, Unit.SECONDS: _hours(1) / 3600}[unit]


def _hours(n: int):
    from datetime import timedelta

    return timedelta(hours=n)


@dataclass(frozen=True)
class Region:
    """Common part of study regions: a time interval, and what depends on the area."""

    def volume(self, unit: str) -> float:
        """Area times whole units of time; the area alone if these are 0."""
        return self.area * (units_between(unit, self.t0, self.t1) or 1)


@dataclass(frozen=True)
class Rectangle(Region):
    x0: float
    x1: float
    y0: float
    y1: float
    t0: datetime | None = None
    t1: datetime | None = None

    @property
    def area(self) -> float:
        return (self.x1 - self.x0) * (self.y1 - self.y0)

    def rings(self) -> tuple:
        return (((self.x0, self.y0), (self.x0, self.y1), (self.x1, self.y1), (self.x1, self.y0), (self.x0, self.y0)),)


@dataclass(frozen=True)
class Polygon(Region):
    """Closed rings of (x, y): the first is the outline, others are holes."""

    outline: tuple
    holes: tuple = ()
    t0: datetime | None = None
    t1: datetime | None = None

    def __post_init__(self):
        for ring in self.rings():
            if len(ring) < 4 or ring[0] != ring[-1]:
                raise ValueError("a ring needs three vertices and must be closed")

    def rings(self) -> tuple:
        return (self.outline, *self.holes)

    @property
    def area(self) -> float:
        def one(ring):
            return abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:]))) / 2

        return one(self.outline) - sum(map(one, self.holes))

    def rectangle(self) -> Rectangle:
        xs, ys = zip(*self.outline)
        return Rectangle(min(xs), max(xs), min(ys), max(ys), self.t0, self.t1)


@dataclass(frozen=True)
class MultiPolygon(Region):
    """Polygons that don't overlap, as one region."""

    parts: tuple
    t0: datetime | None = None
    t1: datetime | None = None

    def __post_init__(self):
        if not self.parts:
            raise ValueError("a region needs a part")

    def rings(self) -> tuple:
        return tuple(ring for part in self.parts for ring in part.rings())

    @property
    def area(self) -> float:
        return sum(part.area for part in self.parts)

    def rectangle(self) -> Rectangle:
        boxes = [part.rectangle() for part in self.parts]
        return Rectangle(min(b.x0 for b in boxes), max(b.x1 for b in boxes), min(b.y0 for b in boxes), max(b.y1 for b in boxes), self.t0, self.t1)


def envelope_region(points: DataFrame, pad: float = PAD) -> Rectangle:
    """The points' own rectangle, widened by pad, and their time interval."""
    cols = [F.min("x"), F.max("x"), F.min("y"), F.max("y")]
    cols += [F.min("t"), F.max("t")] if "t" in points.columns else [F.lit(None), F.lit(None)]
    x0, x1, y0, y1, t0, t1 = points.agg(*cols).first()
    if x0 is None:
        raise ValueError("no points")
    return Rectangle(x0 - pad, x1 + pad, y0 - pad, y1 + pad, t0, t1)


def geojson_vertices(spark: SparkSession, path: str, label: str | None = None) -> DataFrame:
    """(feature, part, ring, vertex, lon, lat) of the Polygons and MultiPolygons of a GeoJSON feature collection.

    feature is the feature's number, or its property of the name label. Other geometries are left out.
    """
    schema = "features array<struct<properties:map<string,string>,geometry:struct<type:string,coordinates:string>>>"
    doc = spark.read.schema(schema).option("multiLine", True).json(path)
    feats = doc.select(F.posexplode("features").alias("number", "f"))
    name = F.col("number") if label is None else F.try_element_at("f.properties", F.lit(label))
    ring = "array<array<array<double>>>"
    one = F.array(F.from_json("f.geometry.coordinates", ring))
    many = F.from_json("f.geometry.coordinates", f"array<{ring}>")
    parts = F.when(F.col("f.geometry.type") == "Polygon", one).when(F.col("f.geometry.type") == "MultiPolygon", many)
    out = feats.select(name.alias("feature"), F.posexplode(parts).alias("part", "rings"))
    out = out.select("feature", "part", F.posexplode("rings").alias("ring", "line"))
    out = out.select("feature", "part", "ring", F.posexplode("line").alias("vertex", "p"))
    return out.select("feature", "part", "ring", "vertex", F.col("p")[0].alias("lon"), F.col("p")[1].alias("lat"))


def geojson_regions(spark: SparkSession, path: str, label: str, project: bool = False) -> DataFrame:
    """Labelled regions of a feature collection as a table for operators.regions: region, part, ring, vertex, x, y.

    x and y are (lat, lon), or metres if project. Features without the label have none and are left out.
    """
    from ..functions.crs import forward

    x, y = forward(F.col("lat"), F.col("lon")) if project else (F.col("lat"), F.col("lon"))
    rows = geojson_vertices(spark, path, label).where("feature IS NOT NULL")
    return rows.select(F.col("feature").alias("region"), "part", "ring", "vertex", x.alias("x"), y.alias("y"))


def read_geojson(spark: SparkSession, path: str, project: bool = False, t0: datetime | None = None, t1: datetime | None = None, several: bool = False) -> Polygon | MultiPolygon:
    """The region of a GeoJSON file with one feature, a Polygon or a MultiPolygon; further rings are holes.

    With several all features are one region, otherwise more than one is an error, as is none.
    Vertices become (lat, lon), or metres if project. A boundary is one object of the query, so its vertices are collected.
    """
    from ..functions.crs import forward

    x, y = forward(F.col("lat"), F.col("lon")) if project else (F.col("lat"), F.col("lon"))
    rows = geojson_vertices(spark, path).select("feature", "part", "ring", "vertex", x.alias("a"), y.alias("b"))
    parts: dict[tuple, dict[int, list]] = {}
    for r in rows.orderBy("feature", "part", "ring", "vertex").collect():
        parts.setdefault((r["feature"], r["part"]), {}).setdefault(r["ring"], []).append((r["a"], r["b"]))
    features = len({k[0] for k in parts})
    if not features or (features > 1 and not several):
        raise ValueError("a boundary file needs exactly one polygon feature")
    found = []
    for _, rings in sorted(parts.items()):
        outline, *holes = (tuple(v) for _, v in sorted(rings.items()))
        found.append(Polygon(outline, tuple(holes), t0, t1))
    return found[0] if len(found) == 1 else MultiPolygon(tuple(found), t0, t1)
