"""Distance, space-time and box joins as equi-joins on grid cells.

A cell of the distance joins is just over one radius wide, so partners lie in the 3 x 3 cells around
a point. In time a cell is as long as the span, or as its longest calendar form, and three are looked at.
What is shuffled are tiles of TILE_CELLS cells a side: a left row goes to its own tile, a right row
also to those that it borders on. Rows travel without cells in space, tiles and limits of time, which a task works out
again. Only there is a left row repeated for the cells around it,
each of which is looked up in a hash table of the right rows; the exact test is the join's residual
condition. Each pair is found once. The cell in time does travel: it costs more to work out than to send.

Tiles (of one that may have many pairs its cells, too), and cells of box joins, are counted before the join. The left rows of one with many pairs are dealt
to shares, and its right rows are copied to each of them, so that it is pairs that are balanced, not bytes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.crs import crs_of
from ..functions.timeunits import longest_seconds, seconds_of, shift
from .slots import slots  # noqa: F401

#: Pairs of a cell or tile that one task compares, about.
SHARE_PAIRS = 4_000_000
#: Cells with more pairs than that are sent to all tasks, up to this number of them.
DENSE_CELLS = 10_000
#: Cells along a side of a tile, in space and in time.
TILE_CELLS = 8
#: Rows of a side that one task of a tile join holds, about; more rows make more tasks.
PART_ROWS = 250_000
#: Rows of the right side of a nested loop.
NESTED_ROWS = 100_000


def dense_cells(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame | None:
    """(*keys, shares) of the cells in which a and b have more than SHARE_PAIRS pairs; None if there are none.

    One count per cell, summed within tasks first.
    """
    both = a.select(*keys, F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(b.select(*keys, F.lit(0).alias("l"), F.lit(1).alias("r")))
    many = both.groupBy(*keys).agg(F.sum("l").cast("double").alias("l"), F.sum("r").cast("double").alias("r"))
    shares = F.least(F.ceil(F.col("l") * F.col("r") / SHARE_PAIRS), F.col("l")).cast("int")
    dense = many.where(F.col("l") * F.col("r") > SHARE_PAIRS).select(*keys, shares.alias("shares"))
    found = dense.limit(DENSE_CELLS + 1).collect()
    if not found:
        return None
    if len(found) > DENSE_CELLS:
        return dense
    return F.broadcast(a.sparkSession.createDataFrame(found, dense.schema))


def cell_join(a: DataFrame, b: DataFrame, keys: list[str], fits: Column) -> DataFrame:
    """a and b joined on their cells and the condition fits; both lose the cell columns.

    Rows of a that are equal in all columns go to one share.
    """
    share, dense = "cell_share", dense_cells(a, b, keys)
    if dense is None:
        a, b = a.withColumn(share, F.lit(0)), b.withColumn(share, F.lit(0))
    else:
        dealt = F.pmod(F.xxhash64(*a.columns), F.col("shares").cast("bigint")).cast("int")
        a = a.join(dense, keys, "left").withColumn(share, F.coalesce(dealt, F.lit(0))).drop("shares")
        b = b.join(dense, keys, "left").withColumn(share, F.explode(F.sequence(F.lit(0), F.coalesce(F.col("shares") - 1, F.lit(0))))).drop("shares")
    on = [*keys, share]
    # dealt to all partitions, whatever the bytes: pairs are many more than rows suggest
    a = a.repartition(int(a.sparkSession.conf.get("spark.sql.shuffle.partitions")), *on)
    same = a[on[0]] == b[on[0]]
    for k in on[1:]:
        same &= a[k] == b[k]
    return a.join(b, same & fits).drop(*on)


def _suffixed(df: DataFrame, side: str) -> list[Column]:
    return [F.col(c).alias(f"{c}_{side}") for c in df.columns]


def parts_of(spark: SparkSession, rows: int) -> int:
    """Number of partitions in which so many rows are about PART_ROWS each, at least the session's."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // PART_ROWS))


def _cells(r: float, length: int | None, side: str = "") -> dict[str, Column]:
    """Cells of a row in space and, if there is a length, in time; side: suffix of the row's columns."""
    size = r * (1 + 1e-9) if r > 0 else 1.0
    cells = {"cx": F.floor(F.col(f"x{side}") / size), "cy": F.floor(F.col(f"y{side}") / size)}
    if length is not None:
        cells["ct"] = F.floor(seconds_of(F.col(f"t{side}")) / F.lit(length))
    return cells


def _sides(left: DataFrame, right: DataFrame, r: float, length: int | None = None, by: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides with their cells; length: seconds of a time cell.

    Columns by, which both sides have, are further keys.
    """
    require_same_crs(crs_of(left), crs_of(right))
    cells = _cells(r, length)
    keys = cells | {f"cell_{c}": F.col(c) for c in by}
    a = left.select(*_suffixed(left, "a"), *(v.alias(k) for k, v in keys.items()))
    b = right.select(*_suffixed(right, "b"), *(v.alias(k) for k, v in keys.items()))
    # rows without a place or a time have no partners
    placed = " AND ".join(f"{k} IS NOT NULL" for k in cells)
    return a.where(placed), b.where(placed), list(keys)


def _tile(c: Column) -> Column:
    return F.floor(c / TILE_CELLS)


def _tiled(df: DataFrame, cells: list[str], around: bool) -> DataFrame:
    """df with its tile (tile_cx and so on); around: a row for each tile with a cell next to the row's own."""
    for c in cells:
        own = _tile(F.col(c))
        if around:
            own = F.explode(F.array_distinct(F.array(_tile(F.col(c) - 1), _tile(F.col(c) + 1))))
        df = df.withColumn(f"tile_{c}", own)
    return df


def _steps(cells: list[str]) -> Column:
    """One number for how far a row's tile lies from that of its cell: two bits for each axis."""
    far = [F.shiftleft((F.col(f"tile_{c}") - _tile(F.col(c)) + 1).cast("int"), 2 * k) for k, c in enumerate(cells)]
    return sum(far[1:], far[0])


def _stepped(cells: list[str], steps: Column) -> dict[str, Column]:
    """The tile that _steps() was made of."""
    return {f"tile_{c}": _tile(F.col(c)) + F.shiftright(steps, 2 * k).bitwiseAND(3) - 1 for k, c in enumerate(cells)}


def _rows_by(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, l, r): the rows of a and b."""
    one, none = F.lit(1.0), F.lit(0.0)
    both = a.select(*keys, one.alias("l"), none.alias("r")).unionByName(b.select(*keys, none.alias("l"), one.alias("r")))
    return both.groupBy(*keys).agg(F.sum("l").alias("l"), F.sum("r").alias("r"))


def _dealt(a: DataFrame, b: DataFrame, cells: list[str], more: list[str]) -> tuple[DataFrame | None, int, int]:
    """(tiles, left rows, right rows): (tile, shares_a, shares_b) of the tiles that are dealt to several shares, None if there are none.

    A tile has no more pairs to compare than rows of a by rows of b, nor than 3 ** axes / 2 times the squares of its cells' counts.
    Cells are counted only in tiles whose rows leave it open: where points are sparse there are about as many cells as rows.
    """
    tile = [f"tile_{c}" for c in cells] + more
    a, b = _tiled(a.select(*cells, *more), cells, False), _tiled(b.select(*cells, *more), cells, True)
    tiles = _rows_by(a, b, tile).where("l > 0 AND r > 0")
    open_ = (F.col("l") * F.col("r") > SHARE_PAIRS) | (F.col("r") > PART_ROWS)
    sure = tiles.agg(F.sum(F.when(~open_, F.col("l"))), F.sum(F.when(~open_, F.col("r"))), F.count_if(open_)).first()
    rows = int(sure[0] or 0), int(sure[1] or 0)
    if not sure[2]:
        return None, *rows
    large = tiles.where(open_).select(*tile)
    if sure[2] <= DENSE_CELLS:
        large = F.broadcast(a.sparkSession.createDataFrame(large.collect(), large.schema))
    each = _rows_by(a.join(large, tile, "left_semi"), b.join(large, tile, "left_semi"), [*tile, *cells])
    many = each.groupBy(*tile).agg(F.sum("l").alias("l"), F.sum("r").alias("r"), F.sum(F.col("l") * F.col("l") + F.col("r") * F.col("r")).alias("q"))
    work = F.least(F.col("l") * F.col("r"), F.col("q") * (3 ** len(cells) / 2))
    shares_b = F.greatest(F.ceil(F.col("r") / PART_ROWS), F.lit(1))
    many = many.withColumn("shares_b", shares_b.cast("int"))
    shares_a = F.greatest(F.least(F.ceil(work / F.col("shares_b") / SHARE_PAIRS), F.col("l")), F.lit(1))
    many = many.withColumn("shares_a", shares_a.cast("int"))
    split = F.col("shares_a") * F.col("shares_b") > 1
    held = many.agg(F.sum(F.col("l") * F.col("shares_b")), F.sum(F.col("r") * F.col("shares_a")), F.count_if(split)).first()
    rows = rows[0] + int(held[0] or 0), rows[1] + int(held[1] or 0)
    if not held[2]:
        return None, *rows
    dense = many.where(split).select(*tile, "shares_a", "shares_b")
    if held[2] > DENSE_CELLS:
        return dense, *rows
    return F.broadcast(a.sparkSession.createDataFrame(dense.collect(), dense.schema)), *rows


def tile_join(left: DataFrame, right: DataFrame, r: float, fits: Column, length: int | None = None, by: tuple[str, ...] = (), part: bool = False, limits: dict[str, Column] | None = None) -> DataFrame:
    """The rows of neighbouring cells joined on the condition fits, columns suffixed _a and _b; length and by are those of _sides().

    The rows of a tile are dealt by both sides' hashes, so that no task holds more than some PART_ROWS of its right rows;
    rows that are equal in all columns go to one share. With part the number of the task stays as a column: groups
    by it and others need no shuffle. limits are columns of left rows that only fits needs.
    """
    a, b, keys = _sides(left, right, r, length, by)
    spark, more = a.sparkSession, [f"cell_{c}" for c in by]
    cells = [k for k in keys if k not in more]
    tile = [f"tile_{c}" for c in cells] + more
    dense, left_rows, right_rows = _dealt(a, b, cells, more)
    number = {side: F.pmod(F.xxhash64(*df.columns), F.col(f"shares_{side}").cast("bigint")).cast("int") for side, df in (("a", a), ("b", b))}
    a, b = _tiled(a, cells, False), _tiled(b, cells, True)
    shares = []
    if dense is not None:
        shares = ["share_a", "share_b"]
        every = lambda side: F.explode(F.sequence(F.lit(0), F.coalesce(F.col(f"shares_{side}") - 1, F.lit(0))))
        own = lambda side: F.coalesce(number[side], F.lit(0))
        a = a.join(dense, tile, "left").withColumn("share_a", own("a")).withColumn("share_b", every("b")).drop("shares_a", "shares_b")
        b = b.join(dense, tile, "left").withColumn("share_b", own("b")).withColumn("share_a", every("a")).drop("shares_a", "shares_b")
    parts = parts_of(spark, max(left_rows, right_rows))
    # by number, so that the join on tiles and cells keeps this partitioning
    task = F.pmod(F.xxhash64(*tile, *shares), F.lit(parts)).cast("int")
    a, b = (df.withColumns({"part": task, "steps": _steps(cells)}).drop(*tile, "cx", "cy") for df in (a, b))
    # a left row's tile is its cell's own
    a, b = (df.repartitionById(parts, F.col("part")) for df in (a.drop("steps"), b))
    again = lambda side: _cells(r, None, side) | {f"cell_{c}": F.col(f"{c}{side}") for c in by}
    a = a.withColumns(again("_a") | (limits or {})).withColumns({f"tile_{c}": _tile(F.col(c)) for c in cells})
    b = b.withColumns(again("_b")).withColumns(_stepped(cells, F.col("steps"))).drop("steps")
    for c in cells:
        a = a.withColumn(c, F.explode(F.array(*(F.col(c) + n for n in (-1, 0, 1)))))
    on = ["part", *tile, *shares, *cells]
    same = a[on[0]] == b[on[0]]
    for k in on[1:]:
        same &= a[k] == b[k]
    joined = a.join(b.hint("shuffle_hash"), same & fits)
    kept = [c for c in joined.columns if c not in on and c not in (limits or {})]
    return joined.select(*([a["part"]] if part else []), *kept)


def within(r: float, boundary: bool = True):
    dx, dy = F.col("x_a") - F.col("x_b"), F.col("y_a") - F.col("y_b")
    square = dx * dx + dy * dy
    return square <= r * r if boundary else square < r * r


def distance_join(left: DataFrame, right: DataFrame, r: float, boundary: bool = True, by: tuple[str, ...] = (), part: bool = False) -> DataFrame:
    """All (a, b) at most r apart, columns suffixed _a and _b, and their distance d.

    Ordered pairs; a table joined to itself gives the self pairs too. boundary=False asks for
    less than r. Tables need x and y; rows without them have no partners. Pairs agree in the
    columns by; part is that of tile_join(). Sides of different reference systems (functions.crs) are an error.
    """
    if r < 0:
        raise ValueError("the radius must not be negative")
    dx, dy = F.col("x_a") - F.col("x_b"), F.col("y_a") - F.col("y_b")
    return tile_join(left, right, r, within(r, boundary), by=by, part=part).withColumn("d", F.sqrt(dx * dx + dy * dy))


def nested_loop_join(left: DataFrame, right: DataFrame, r: float, boundary: bool = True) -> DataFrame:
    """distance_join() without cells, for tiny inputs: every point of left against a sent copy of right.

    right is counted; more than NESTED_ROWS rows are an error, so that what is sent has a bound.
    """
    if r < 0:
        raise ValueError("the radius must not be negative")
    require_same_crs(crs_of(left), crs_of(right))
    if right.limit(NESTED_ROWS + 1).count() > NESTED_ROWS:
        raise ValueError(f"a nested loop takes {NESTED_ROWS} rows at most, distance_join() takes any number")
    a, b = (df.select(*(F.col(c).alias(f"{c}_{side}") for c in df.columns)) for df, side in ((left, "a"), (right, "b")))
    dx, dy = F.col("x_a") - F.col("x_b"), F.col("y_a") - F.col("y_b")
    return a.join(F.broadcast(b), within(r, boundary)).withColumn("d", F.sqrt(dx * dx + dy * dy))


def st_join(left: DataFrame, right: DataFrame, r: float, span: int, unit: str, boundary: bool = True, by: tuple[str, ...] = ()) -> DataFrame:
    """distance_join() with t_b from t_a - span to t_a + span units of calendar arithmetic."""
    if span < 0:
        raise ValueError("the time span must not be negative")
    limits = {"lo": shift(unit, F.col("t_a"), -span), "hi": shift(unit, F.col("t_a"), span)}
    when = (F.col("t_b") >= F.col("lo")) & (F.col("t_b") <= F.col("hi"))
    if not boundary:
        when = (F.col("t_b") > F.col("lo")) & (F.col("t_b") < F.col("hi"))
    dx, dy = F.col("x_a") - F.col("x_b"), F.col("y_a") - F.col("y_b")
    joined = tile_join(left, right, r, within(r, boundary) & when, longest_seconds(unit, span) + 1, by, limits=limits)
    return joined.withColumn("d", F.sqrt(dx * dx + dy * dy))


def _box_cells(boxes: DataFrame, side: str, levels: list[int]) -> DataFrame:
    """boxes with a row for each level from their own on and each cell there that they touch: four a level at most."""
    c = lambda name: F.col(f"{name}_{side}")
    out = boxes.select(*_suffixed(boxes, side), _level(F.col("x0"), F.col("x1"), F.col("y0"), F.col("y1")).alias(f"level_{side}"))
    out = out.withColumn("level", F.explode(F.filter(F.array(*map(F.lit, levels)), lambda m: m >= c("level"))))
    cell = lambda v: F.floor(v / F.pow(F.lit(2.0), F.col("level"))).cast("bigint")
    for axis in ("x", "y"):
        out = out.withColumn(f"c{axis}", F.explode(F.sequence(cell(c(f"{axis}0")), cell(c(f"{axis}1")))))
    return out


def _level(x0: Column, x1: Column, y0: Column, y1: Column) -> Column:
    """Exponent of the power of two that a box's longer side doesn't exceed."""
    side = F.greatest(x1 - x0, y1 - y0)
    return F.when(side > LEAST_SIDE, F.ceil(F.log2(side) + 1e-9)).otherwise(F.lit(LEAST_LEVEL)).cast("int")


#: Boxes with shorter sides, points among them, are filed in cells of 2 ** LEAST_LEVEL.
LEAST_LEVEL = -3
LEAST_SIDE = 2.0**LEAST_LEVEL


def box_join(left: DataFrame, right: DataFrame, boundary: bool = True) -> DataFrame:
    """All (a, b) whose boxes (x0, x1, y0, y1 and, if both sides have them, t0, t1) meet; columns suffixed _a and _b.

    Boxes that touch meet; with boundary=False they must overlap by more than their borders. Boxes of all sizes can be
    mixed: a pair meets in cells as wide as the larger of the two and is kept in the one that has the low
    corner of what they share, so it is found once. Boxes with a null have no partners. Sides whose columns
    x name different reference systems are an error.
    """
    require_same_crs(crs_of(left), crs_of(right))
    whole = "x0 <= x1 AND y0 <= y1"
    left, right = left.where(whole), right.where(whole)
    level = _level(F.col("x0"), F.col("x1"), F.col("y0"), F.col("y1")).alias("level")
    # exponents of sizes: a double has some two thousand
    levels = sorted(r["level"] for r in left.select(level).unionByName(right.select(level)).distinct().collect())
    if not levels:
        levels = [LEAST_LEVEL]
    a, b = _box_cells(left, "a", levels), _box_cells(right, "b", levels)
    less = (lambda x, y: x <= y) if boundary else (lambda x, y: x < y)
    axes = ["x", "y"] + (["t"] if {"t0", "t1"} <= set(left.columns) & set(right.columns) else [])
    col, fits = F.col, F.lit(True)
    for v in axes:
        fits &= less(col(f"{v}0_a"), col(f"{v}1_b")) & less(col(f"{v}0_b"), col(f"{v}1_a"))
    size = F.pow(F.lit(2.0), F.greatest("level_a", "level_b"))
    owner = [F.floor(F.greatest(col(f"{v}0_a"), col(f"{v}0_b")) / size).cast("bigint") for v in ("x", "y")]
    fits &= (a["level"] == F.greatest("level_a", "level_b")) & (a["cx"] == owner[0]) & (a["cy"] == owner[1])
    return cell_join(a, b, ["level", "cx", "cy"], fits).drop("level_a", "level_b")


def circle_join(left: DataFrame, right: DataFrame, boundary: bool = True) -> DataFrame:
    """All (a, b) with the point b (x, y) in the circle a (x, y, r), radii differing by row; as distance_join() otherwise.

    Circles with a null or a radius below 0 have no partners.
    """
    # wider by far more than rounding: the box only finds candidates
    wide = lambda c: F.col("r") + (F.abs(F.col(c)) + F.col("r")) * F.lit(1e-12)
    circles = left.withColumns({f"{c}{k}": F.col(c) + sign * wide(c) for c in "xy" for k, sign in ((0, F.lit(-1.0)), (1, F.lit(1.0)))}).where("r >= 0")
    places = right.withColumns({"x0": F.col("x"), "x1": F.col("x"), "y0": F.col("y"), "y1": F.col("y")})
    near = box_join(circles.drop("t0", "t1"), places.drop("t0", "t1"))
    dx, dy = F.col("x_a") - F.col("x_b"), F.col("y_a") - F.col("y_b")
    square = dx * dx + dy * dy
    near = near.where(square <= F.col("r_a") * F.col("r_a") if boundary else square < F.col("r_a") * F.col("r_a"))
    return near.drop(*(f"{c}{k}_{side}" for c in "xy" for k in "01" for side in "ab")).withColumn("d", F.sqrt(square))


def count_per_left(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("pid_a").agg(F.count("*").alias("n"))


def collect_per_left(pairs: DataFrame) -> DataFrame:
    """The partners of each left point, sorted."""
    return pairs.groupBy("pid_a").agg(F.array_sort(F.collect_list("pid_b")).alias("partners"))


def range_query(points: DataFrame, x0: float, x1: float, y0: float, y1: float, t0=None, t1=None) -> DataFrame:
    """Points in a closed box; plain comparisons, so that they reach the scan."""
    out = points.where(F.col("x").between(x0, x1) & F.col("y").between(y0, y1))
    if t0 is not None:
        out = out.where(F.col("t").between(F.lit(t0), F.lit(t1)))
    return out


def remove(points: DataFrame, gone: DataFrame) -> DataFrame:
    """Points whose pid isn't in gone."""
    return points.join(gone.select("pid"), "pid", "left_anti")


def cell_envelopes(points: DataFrame, size: float) -> DataFrame:
    """Count and bounding box of the points of each grid cell."""
    cell = lambda c: F.floor(F.col(c) / size).cast("bigint").alias(f"c{c}")
    box = [f(c).alias(f"{g}_{c}") for c in ("x", "y") for f, g in ((F.min, "min"), (F.max, "max"))]
    return points.groupBy(cell("x"), cell("y")).agg(F.count("*").alias("n"), *box)


def require_same_crs(left: str | None, right: str | None) -> None:
    """Both sides of a join must be in the same reference system."""
    if left != right:
        raise ValueError(f"the sides have different reference systems: {left}, {right}")
