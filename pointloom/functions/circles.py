"""Circles with a time interval: structs (x, y, r, t_lo, t_hi), and their predicates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .timeunits import shift


def circle(x: Column, y: Column, t: Column, r: float, span: int, unit: str) -> Column:
    """Circle of radius r around a point, from t - span to t + span units."""
    if r < 0 or span < 0:
        raise ValueError("radii must not be negative")
    return F.struct(x.alias("x"), y.alias("y"), F.lit(float(r)).alias("r"), shift(unit, t, -span).alias("t_lo"), shift(unit, t, span).alias("t_hi"))


def _square(c: Column, x: Column, y: Column) -> Column:
    return (c["x"] - x) * (c["x"] - x) + (c["y"] - y) * (c["y"] - y)


def covers_point(c: Column, x: Column, y: Column, t: Column) -> Column:
    """Closed in space and time; the same as intersecting a point."""
    return (_square(c, x, y) <= c["r"] * c["r"]) & (t >= c["t_lo"]) & (t <= c["t_hi"])


def contains_point(c: Column, x: Column, y: Column, t: Column) -> Column:
    return (_square(c, x, y) < c["r"] * c["r"]) & (t > c["t_lo"]) & (t < c["t_hi"])


def covers_ring(c: Column, ring: Column) -> Column:
    """All vertices of a ring (array of (x, y)) are covered in space."""
    return F.forall(ring, lambda p: _square(c, p["x"], p["y"]) <= c["r"] * c["r"])


def _meets_segment(c: Column, a: Column, b: Column) -> Column:
    dx, dy = b["x"] - a["x"], b["y"] - a["y"]
    length = dx * dx + dy * dy
    along = (c["x"] - a["x"]) * dx + (c["y"] - a["y"]) * dy
    s = F.when(length > 0, F.least(F.greatest(along / length, F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
    return _square(c, a["x"] + s * dx, a["y"] + s * dy) <= c["r"] * c["r"]


def inside_ring(x: Column, y: Column, ring: Column) -> Column:
    """Whether a point lies inside a closed ring, by the parity of edges to its right."""
    idx = F.sequence(F.lit(1), F.size(ring) - 1)

    def crossed(k):
        a, b = F.element_at(ring, k), F.element_at(ring, k + 1)
        straddles = (a["y"] > y) != (b["y"] > y)
        at = a["x"] + (y - a["y"]) * (b["x"] - a["x"]) / F.when(straddles, b["y"] - a["y"]).otherwise(1.0)
        return straddles & (x < at)

    return F.size(F.filter(idx, crossed)) % 2 == 1


def intersects_ring(c: Column, ring: Column) -> Column:
    """An edge of the ring is met, or the centre lies inside."""
    idx = F.sequence(F.lit(1), F.size(ring) - 1)
    met = F.exists(idx, lambda k: _meets_segment(c, F.element_at(ring, k), F.element_at(ring, k + 1)))
    return met | inside_ring(c["x"], c["y"], ring)


def _rim(c: Column, ring: Column) -> Column:
    return F.exists(F.sequence(F.lit(1), F.size(ring) - 1), lambda k: _meets_segment(c, F.element_at(ring, k), F.element_at(ring, k + 1)))


def intersects_polygon(c: Column, outline: Column, holes: Column) -> Column:
    """An edge of the outline or of a hole (array of rings) is met, or the centre lies inside and in no hole."""
    inside = inside_ring(c["x"], c["y"], outline) & ~F.exists(holes, lambda h: inside_ring(c["x"], c["y"], h))
    return _rim(c, outline) | F.exists(holes, lambda h: _rim(c, h)) | inside
