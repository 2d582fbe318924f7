"""Points in tables of polygons: cells marked inner or border, joined by cell.

Edges are filed under every cell that they touch. Each cell has an anchor, at the same place in all of them;
the crossings on a row's line of anchors before one tell by their parity whether it lies inside. Between
two border cells of a row all cells are alike, so the inner ones follow from a running sum over the border
cells. A point in an inner cell needs no test; in a border cell the segment from the anchor to the
point is tested against the edges of that cell only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .pairs import require_same_crs
from ..functions.crs import crs_of

#: An anchor's place as shares of the cell, off the places where edges usually lie.
ACROSS, UP = 0.31830989, 0.48710585
#: Cells along the longer side of all regions, where no size is given.
CELLS = 256
#: By this share of a cell edges are filed wider than they are, so that rounding loses none.
SLACK = 1e-9


def edges_of(vertices: DataFrame) -> DataFrame:
    """(region, ax, ay, bx, by) of closed rings (region, part and ring where there are several, vertex, x, y)."""
    ring = [c for c in ("region", "part", "ring") if c in vertices.columns]
    along = Window.partitionBy(*ring).orderBy("vertex")
    both = vertices.select(*ring, F.col("x").alias("ax"), F.col("y").alias("ay"), F.lead("x").over(along).alias("bx"), F.lead("y").over(along).alias("by"))
    return both.where("bx IS NOT NULL AND (ax <> bx OR ay <> by)").select("region", "ax", "ay", "bx", "by")


def cell_size(vertices: DataFrame) -> float:
    """The longer side of all vertices over CELLS."""
    w, h = vertices.agg(F.max("x") - F.min("x"), F.max("y") - F.min("y")).first()
    return max(w or 0.0, h or 0.0) / CELLS or 1.0


def _cell(v: Column, size: float) -> Column:
    return F.floor(v / F.lit(size)).cast("bigint")


def region_cells(vertices: DataFrame, size: float) -> DataFrame:
    """(region, cx, cy, edges, anchored) of the cells that a region covers or touches; edges is null for inner cells, anchored says
    whether the anchor lies inside."""
    e = edges_of(vertices)
    slack = size * SLACK
    # along x: the columns that an edge passes, and the part of it in each
    cols = e.withColumn("cx", F.explode(F.sequence(_cell(F.least("ax", "bx") - slack, size), _cell(F.greatest("ax", "bx") + slack, size))))
    run = F.col("bx") - F.col("ax")
    at = lambda x: F.when(run == 0, None).otherwise(F.least(F.greatest((x - F.col("ax")) / run, F.lit(0.0)), F.lit(1.0)))
    y = lambda t, other: F.coalesce(F.col("ay") + t * (F.col("by") - F.col("ay")), other)
    y0, y1 = y(at(F.col("cx") * size - slack), F.col("ay")), y(at((F.col("cx") + 1) * size + slack), F.col("by"))
    filed = cols.withColumn("cy", F.explode(F.sequence(_cell(F.least(y0, y1) - slack, size), _cell(F.greatest(y0, y1) + slack, size))))
    filed = filed.select("region", "cx", "cy", F.struct("ax", "ay", "bx", "by").alias("edge"), F.lit(0).alias("crossed"))
    # along y: after which anchor an edge crosses a row's line of them
    rows = e.withColumn("cy", F.explode(F.sequence(_cell(F.least("ay", "by"), size), _cell(F.greatest("ay", "by"), size))))
    line = (F.col("cy") + UP) * size
    rows = rows.where((F.col("ay") > line) != (F.col("by") > line))
    crossing = F.col("ax") + (line - F.col("ay")) / (F.col("by") - F.col("ay")) * run
    rows = rows.select("region", _cell(crossing - ACROSS * size, size).alias("cx"), "cy", F.lit(None).cast(filed.schema["edge"].dataType).alias("edge"), F.lit(1).alias("crossed"))
    border = filed.unionByName(rows).groupBy("region", "cx", "cy").agg(F.collect_list("edge").alias("edges"), F.sum("crossed").alias("crossed"))
    row = Window.partitionBy("region", "cy").orderBy("cx")  # the border cells of one row of one region
    before = F.coalesce(F.sum("crossed").over(row.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    border = border.select("region", "cx", "cy", "edges", "crossed", before.alias("before"), F.lead("cx").over(row).alias("next"))
    odd = lambda n: n % 2 == 1
    gap = border.where(odd(F.col("before") + F.col("crossed")) & (F.col("next") > F.col("cx") + 1))
    inner = gap.select("region", F.explode(F.sequence(F.col("cx") + 1, F.col("next") - 1)).alias("cx"), "cy", F.lit(None).cast(border.schema["edges"].dataType).alias("edges"), F.lit(True).alias("anchored"))
    return inner.unionByName(border.select("region", "cx", "cy", "edges", odd(F.col("before")).alias("anchored")))


def _crosses(edge: Column, px: Column, py: Column, qx: Column, qy: Column) -> Column:
    """The segment p to q and an edge cut each other; an edge's end counts for one of its two edges."""
    side = lambda x, y: (qx - px) * (y - py) - (qy - py) * (x - px) > 0
    of = lambda x, y: (edge["bx"] - edge["ax"]) * (y - edge["ay"]) - (edge["by"] - edge["ay"]) * (x - edge["ax"]) > 0
    return (side(edge["ax"], edge["ay"]) != side(edge["bx"], edge["by"])) & (of(px, py) != of(qx, qy))


def points_in(points: DataFrame, vertices: DataFrame, size: float | None = None) -> DataFrame:
    """points and the region that each lies in, a row for each region; points in none are left out.

    vertices has closed rings (region, part and ring where there are several, vertex, x, y), holes and parts by
    even-odd rule. Regions may touch or overlap. A point on a border is in or out by rounding, as in ray casting.
    size is the width of a cell, by default such that CELLS lie along the longer side. Points and
    vertices with nulls have no place. Reference systems that differ are an error.
    """
    require_same_crs(crs_of(points), crs_of(vertices))
    vertices = vertices.where("x IS NOT NULL AND y IS NOT NULL AND region IS NOT NULL")
    size = cell_size(vertices) if size is None else size
    cells = region_cells(vertices, size)
    kept = points.drop("region").columns
    here = points.drop("region").select(F.struct(*kept).alias("point"), "x", "y", _cell(F.col("x"), size).alias("cx"), _cell(F.col("y"), size).alias("cy"))
    both = here.join(cells, ["cx", "cy"])
    cut = F.filter("edges", lambda e: _crosses(e, (F.col("cx") + ACROSS) * size, (F.col("cy") + UP) * size, F.col("x"), F.col("y")))
    inside = F.col("edges").isNull() | (F.col("anchored") != (F.size(cut) % 2 == 1))
    return both.where(inside).select("point.*", "region")


def count_in(points: DataFrame, vertices: DataFrame, size: float | None = None) -> DataFrame:
    """region and n, the number of points in it; regions without points are left out."""
    return points_in(points.select("x", "y"), vertices, size).groupBy("region").agg(F.count("*").alias("n"))
