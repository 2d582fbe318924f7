"""Space-time boxes as struct columns (x0, x1, y0, y1, t0, t1): sizes, combinations, predicates.

A null envelope stands for the empty one.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .timeunits import distance

_AXES = (("x0", "x1"), ("y0", "y1"), ("t0", "t1"))


def envelope(xa: Column, xb: Column, ya: Column, yb: Column, ta: Column, tb: Column) -> Column:
    """Box of two corners in any order; null if a coordinate is null."""
    parts = []
    for (lo, hi), a, b in zip(_AXES, (xa, ya, ta), (xb, yb, tb)):
        parts += [F.least(a, b).alias(lo), F.greatest(a, b).alias(hi)]
    whole = xa.isNotNull() & xb.isNotNull() & ya.isNotNull() & yb.isNotNull() & ta.isNotNull() & tb.isNotNull()
    return F.when(whole, F.struct(*parts))


def width(e: Column) -> Column:
    return e["x1"] - e["x0"]


def height(e: Column) -> Column:
    return e["y1"] - e["y0"]


def area(e: Column) -> Column:
    return width(e) * height(e)


def interval(e: Column, unit: str = "SECONDS") -> Column:
    return distance(unit, e["t0"], e["t1"])


def volume(e: Column, unit: str = "SECONDS") -> Column:
    return area(e) * interval(e, unit)


def centre(e: Column) -> Column:
    """Midpoint; its time in whole seconds from the start."""
    half = F.floor(interval(e, "SECONDS") / 2).cast("int")
    return F.struct(((e["x0"] + e["x1"]) / 2).alias("x"), ((e["y0"] + e["y1"]) / 2).alias("y"), F.timestamp_add("SECOND", half, e["t0"]).alias("t"))


def intersection(a: Column, b: Column) -> Column:
    """Common box, null if there is none."""
    parts = []
    for lo, hi in _AXES:
        parts += [F.greatest(a[lo], b[lo]).alias(lo), F.least(a[hi], b[hi]).alias(hi)]
    return F.when(intersects(a, b), F.struct(*parts))


def union(a: Column, b: Column) -> Column:
    """Smallest box around both; a null one adds nothing."""
    parts = []
    for lo, hi in _AXES:
        parts += [F.least(a[lo], b[lo]).alias(lo), F.greatest(a[hi], b[hi]).alias(hi)]
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(F.struct(*parts))


def _all(test, a: Column, b: Column) -> Column:
    out = F.lit(True)
    for lo, hi in _AXES:
        out = out & test(a[lo], a[hi], b[lo], b[hi])
    return F.coalesce(out, F.lit(False))


def intersects(a: Column, b: Column) -> Column:
    return _all(lambda al, ah, bl, bh: (al <= bh) & (bl <= ah), a, b)


def covers(a: Column, b: Column) -> Column:
    return _all(lambda al, ah, bl, bh: (al <= bl) & (bh <= ah), a, b)


def contains(a: Column, b: Column) -> Column:
    """b lies strictly within a on all six sides."""
    return _all(lambda al, ah, bl, bh: (al < bl) & (bh < ah), a, b)


def adjacent(a: Column, b: Column) -> Column:
    """The boxes share one face: equal on two axes, touching on the third."""
    same = [(a[lo] == b[lo]) & (a[hi] == b[hi]) for lo, hi in _AXES]
    touch = [(a[lo] == b[hi]) | (a[hi] == b[lo]) for lo, hi in _AXES]
    faces = [touch[k] & same[(k + 1) % 3] & same[(k + 2) % 3] for k in range(3)]
    return F.coalesce(faces[0] | faces[1] | faces[2], F.lit(False))


def ring(e: Column) -> Column:
    """Closed clockwise ring of the box's ground plan, from its lowest corner up."""
    corners = (("x0", "y0"), ("x0", "y1"), ("x1", "y1"), ("x1", "y0"), ("x0", "y0"))
    return F.array(*(F.struct(e[x].alias("x"), e[y].alias("y")) for x, y in corners))


def ring_area(points: Column) -> Column:
    """Area of a closed ring of (x, y) structs."""
    n = F.size(points)
    idx = F.sequence(F.lit(1), n - 1)
    cross = lambda k: F.element_at(points, k)["x"] * F.element_at(points, k + 1)["y"] - F.element_at(points, k + 1)["x"] * F.element_at(points, k)["y"]
    return F.abs(F.aggregate(F.transform(idx, cross), F.lit(0.0), lambda s, v: s + v)) / 2
