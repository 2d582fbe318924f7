"""DuckDB twins of the queries, written from the definitions rather than from the plans."""

from __future__ import annotations

from .queries import BOX, HOUSE, OUTLINE, ZOOM

PAD = 0.7310585
_PI = "pi()"

EVENTS = "SELECT event_id AS pid, value AS x, CAST(user_id AS DOUBLE) AS y, ts AS t, event_type AS mark FROM events WHERE value IS NOT NULL AND user_id IS NOT NULL"
ORDERS = "SELECT o_orderkey AS pid, o_totalprice / 1000 AS x, CAST(o_custkey AS DOUBLE) AS y, o_orderdate AS t, o_orderstatus AS mark FROM orders WHERE o_totalprice IS NOT NULL AND o_custkey IS NOT NULL"
LATLON = "SELECT event_id AS pid, -80.0 + 160.0 * ((event_id * 104729 + user_id) % 10009) / CAST(10009.0 AS DOUBLE) AS lat, -180.0 + 360.0 * ((event_id * 7919) % 10007) / CAST(10007.0 AS DOUBLE) AS lon, ts AS t, event_type AS mark FROM events"
LATLON = LATLON.replace("-80.0", "CAST(-80.0 AS DOUBLE)").replace("160.0", "CAST(160.0 AS DOUBLE)").replace("-180.0", "CAST(-180.0 AS DOUBLE)").replace("360.0", "CAST(360.0 AS DOUBLE)")

SQL: dict[str, str] = {}


def _box(source: str) -> str:
    return f"pts AS ({source}), box AS (SELECT min(x) - {PAD}::DOUBLE AS bx0, max(x) + {PAD}::DOUBLE AS bx1, min(y) - {PAD}::DOUBLE AS by0, max(y) + {PAD}::DOUBLE AS by1, min(t) AS bt0, max(t) AS bt1, count(*) AS n FROM pts)"


def _weight(x: str, y: str, r: str) -> str:
    """Closed form of the rectangle's isotropic weight; bx0..by1 in scope."""
    sides = (f"({x} - bx0)", f"(by1 - {y})", f"(bx1 - {x})", f"({y} - by0)")
    a = [f"(CASE WHEN {d} < {r} THEN acos(least({d} / {r}, 1.0::DOUBLE)) ELSE 0.0::DOUBLE END)" for d in sides]
    corners = " + ".join(f"greatest(0.0::DOUBLE, {a[k]} + {a[(k + 1) % 4]} - {_PI} / 2)" for k in range(4))
    inside = f"(2 * {_PI} - (2 * ({' + '.join(a)}) - ({corners})))"
    near = f"least({', '.join(sides)})"
    return f"(CASE WHEN {near} <= 0 THEN 100.0::DOUBLE WHEN {r} <= {near} THEN 1.0::DOUBLE WHEN {inside} > 1e-12 THEN least(100.0::DOUBLE, 2 * {_PI} / {inside}) ELSE 100.0::DOUBLE END)"


_MONTHS = """((year(b) * 12 + month(b)) - (year(a) * 12 + month(a))
  - CASE WHEN year(b) * 12 + month(b) > year(a) * 12 + month(a) AND day(b) < day(a) THEN 1 ELSE 0 END
  + CASE WHEN year(b) * 12 + month(b) < year(a) * 12 + month(a) AND day(b) > day(a) THEN 1 ELSE 0 END)"""


def _tau(unit: str, a: str, b: str) -> str:
    months = _MONTHS.replace("(b)", f"({b})").replace("(a)", f"({a})")
    return {
        "YEARS": f"CAST(abs({months}) // 12 AS BIGINT)",
        "MONTHS": f"CAST(abs({months}) AS BIGINT)",
        "DAYS": f"CAST(abs(CAST({b} AS DATE) - CAST({a} AS DATE)) AS BIGINT)",
        "HOURS": f"CAST(abs(epoch_us({b}) - epoch_us({a})) // 3600000000 AS BIGINT)",
        "MINUTES": f"CAST(abs(epoch_us({b}) - epoch_us({a})) // 60000000 AS BIGINT)",
        "SECONDS": f"CAST(abs(epoch_us({b}) - epoch_us({a})) // 1000000 AS BIGINT)",
    }[unit]


def _span(unit: str, n: str) -> str:
    return {"MONTHS": f"to_months(CAST({n} AS INTEGER))", "DAYS": f"to_days(CAST({n} AS INTEGER))", "YEARS": f"to_years(CAST({n} AS INTEGER))"}[unit]


def _temporal(unit: str, t: str, tau: str) -> str:
    inside = f"{t} - {_span(unit, tau)} >= bt0 AND {t} + {_span(unit, tau)} <= bt1"
    return f"(CASE WHEN {t} < bt0 OR {t} > bt1 THEN 0.0::DOUBLE WHEN {tau} = 0 OR ({inside}) THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END)"


_SQUARE = "(a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)"


def _near(r: float, op: str = "<=") -> str:
    return f"b.x BETWEEN a.x - {r + 1e-6} AND a.x + {r + 1e-6} AND b.y BETWEEN a.y - {r + 1e-6} AND a.y + {r + 1e-6} AND {_SQUARE} {op} {r}::DOUBLE * {r}::DOUBLE"


# -- sources -----------------------------------------------------------------------------

SQL["point_scan_limit"] = f"SELECT * FROM ({EVENTS}) ORDER BY pid LIMIT 500"
SQL["pattern_stats"] = f"SELECT count(*) AS n, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y, min(t) AS min_t, max(t) AS max_t FROM ({EVENTS})"
SQL["replication_fold"] = f"SELECT x, y, count(*) AS cnt FROM ({EVENTS}) GROUP BY x, y"
SQL["time_parse"] = f"SELECT pid, date_trunc('second', t) AS from_text, date_trunc('second', t) AS from_iso, TIMESTAMP '1996-07-01 00:00:00' AS constant FROM ({EVENTS})"
SQL["envelope_boundary"] = f"WITH {_box(EVENTS)} SELECT bx0 AS x0, bx1 AS x1, by0 AS y0, by1 AS y1, (bx1 - bx0) * (by1 - by0) AS area FROM box"

# -- projections and calendar ----------------------------------------------------------------

SQL["crs_forward"] = f"SELECT pid, round(6378137.0::DOUBLE * radians(lon), 4) AS x, round(6378137.0::DOUBLE * ln(tan({_PI} / 4 + radians(lat) / 2)), 4) AS y FROM ({LATLON})"
SQL["crs_inverse"] = f"SELECT pid, round(lat, 6) AS lat, round(lon, 6) AS lon FROM ({LATLON})"


def _tiles(zoom: int) -> str:
    n = 1 << zoom
    lat = "radians(least(greatest(lat, -85.0511::DOUBLE), 85.0511::DOUBLE))"
    tx = f"CAST(least(greatest(floor((lon + 180.0::DOUBLE) / 360.0::DOUBLE * {n}), 0), {n - 1}) AS BIGINT)"
    ty = f"CAST(least(greatest(floor((1.0::DOUBLE - ln(tan({lat}) + 1.0::DOUBLE / cos({lat})) / {_PI}) / 2.0::DOUBLE * {n}), 0), {n - 1}) AS BIGINT)"
    return f"SELECT *, {tx} AS tile_x, {ty} AS tile_y FROM ({LATLON})"


SQL["latlng_to_tile"] = f"SELECT pid, tile_x, tile_y, 511 - tile_y AS tile_y_south FROM ({_tiles(9)})"
_E = f"exp({_PI} * (1.0::DOUBLE - 2.0::DOUBLE * (tile_y + 0.5::DOUBLE) / 512))"
SQL["tile_to_latlng"] = f"SELECT pid, round(degrees(atan(({_E} - 1 / {_E}) / 2)), 6) AS lat, round((tile_x + 0.5::DOUBLE) / 512 * 360.0::DOUBLE - 180.0::DOUBLE, 6) AS lon FROM ({_tiles(9)})"
SQL["time_trunc"] = f"SELECT pid, {', '.join(f'''CAST(date_trunc('{u[:-1]}', t) AS TIMESTAMP) AS {u}''' for u in ('years', 'months', 'days', 'hours', 'minutes', 'seconds'))} FROM ({EVENTS})"
SQL["epoch_convert"] = f"SELECT pid, epoch_us(t) // 1000 AS ms, make_timestamp(epoch_us(t) // 1000 * 1000) AS back FROM ({EVENTS})"
for _u, _src in (("YEARS", ORDERS), ("MONTHS", ORDERS), ("DAYS", ORDERS), ("HOURS", EVENTS), ("MINUTES", EVENTS), ("SECONDS", EVENTS)):
    SQL[f"tdist_{_u.lower()}"] = f"WITH p AS ({_src}) SELECT p.pid, {_tau(_u, 'p.t', 'q.t')} AS n FROM p JOIN p q ON q.pid = p.pid + 1"

# -- envelopes and predicates ----------------------------------------------------------------

_BOXES = f"""WITH p AS ({EVENTS}), boxes AS (
  SELECT p.pid, floor(p.x / 40) * 40.0::DOUBLE AS ax0, floor(p.x / 40) * 40.0::DOUBLE + 80.0::DOUBLE AS ax1,
    floor(p.y / 4) * 4.0::DOUBLE AS ay0, floor(p.y / 4) * 4.0::DOUBLE + 8.0::DOUBLE AS ay1,
    CAST(date_trunc('day', p.t) AS TIMESTAMP) AS at0, CAST(date_trunc('day', p.t) AS TIMESTAMP) + INTERVAL 3 DAY AS at1,
    floor(q.x / 40) * 40.0::DOUBLE AS bx0, floor(q.x / 40) * 40.0::DOUBLE + 40.0::DOUBLE AS bx1,
    floor(q.y / 4) * 4.0::DOUBLE AS by0, floor(q.y / 4) * 4.0::DOUBLE + 4.0::DOUBLE AS by1,
    CAST(date_trunc('day', q.t) AS TIMESTAMP) AS bt0, CAST(date_trunc('day', q.t) AS TIMESTAMP) + INTERVAL 2 DAY AS bt1
  FROM p JOIN p q ON q.pid = p.pid + 1)"""
_MEET = "ax0 <= bx1 AND bx0 <= ax1 AND ay0 <= by1 AND by0 <= ay1 AND at0 <= bt1 AND bt0 <= at1"
SQL["envelope_area_volume"] = f"{_BOXES} SELECT pid, ax1 - ax0 AS width, ay1 - ay0 AS height, (ax1 - ax0) * (ay1 - ay0) AS area, CAST(72 AS BIGINT) AS hours, (ax1 - ax0) * (ay1 - ay0) * 259200 AS volume FROM boxes"
SQL["envelope_intersection"] = f"{_BOXES} SELECT pid, " + ", ".join(f"CASE WHEN {_MEET} THEN {f}(a{c}, b{c}) END AS {c}" for f, c in (("greatest", "x0"), ("least", "x1"), ("greatest", "y0"), ("least", "y1"), ("greatest", "t0"), ("least", "t1"))) + " FROM boxes"
SQL["envelope_union"] = f"{_BOXES} SELECT pid, " + ", ".join(f"{f}(a{c}, b{c}) AS {c}" for f, c in (("least", "x0"), ("greatest", "x1"), ("least", "y0"), ("greatest", "y1"), ("least", "t0"), ("greatest", "t1"))) + " FROM boxes"
SQL["envelope_centre"] = f"{_BOXES} SELECT pid, (ax0 + ax1) / 2 AS x, (ay0 + ay1) / 2 AS y, at0 + INTERVAL 36 HOUR AS t FROM boxes"
SQL["envelope_intersects"] = f"{_BOXES} SELECT pid, {_MEET} AS holds FROM boxes"
SQL["envelope_covers"] = f"{_BOXES} SELECT pid, ax0 <= bx0 AND bx1 <= ax1 AND ay0 <= by0 AND by1 <= ay1 AND at0 <= bt0 AND bt1 <= at1 AS holds FROM boxes"
SQL["envelope_contains"] = f"{_BOXES} SELECT pid, ax0 < bx0 AND bx1 < ax1 AND ay0 < by0 AND by1 < ay1 AND at0 < bt0 AND bt1 < at1 AS holds FROM boxes"
_SAME = {c: f"(a{c}0 = b{c}0 AND a{c}1 = b{c}1)" for c in "xyt"}
_TOUCH = {c: f"(a{c}0 = b{c}1 OR a{c}1 = b{c}0)" for c in "xyt"}
SQL["envelope_adjacent"] = f"{_BOXES} SELECT pid, ({_TOUCH['x']} AND {_SAME['y']} AND {_SAME['t']}) OR ({_TOUCH['y']} AND {_SAME['x']} AND {_SAME['t']}) OR ({_TOUCH['t']} AND {_SAME['x']} AND {_SAME['y']}) AS holds FROM boxes"

_NEXT = f"WITH p AS ({EVENTS}), two AS (SELECT p.*, q.x AS x2, q.y AS y2, q.t AS t2 FROM p JOIN p q ON q.pid = p.pid + 1)"
_FAR = "((x - {u}) * (x - {u}) + (y - {v}) * (y - {v}))"
_D2 = _FAR.format(u="x2", v="y2")
SQL["circle_covers"] = f"{_NEXT} SELECT pid, {_D2} <= 3600 AND t2 >= t - INTERVAL 10 DAY AND t2 <= t + INTERVAL 10 DAY AS holds FROM two"
SQL["circle_contains"] = f"{_NEXT} SELECT pid, {_D2} < 3600 AND t2 > t - INTERVAL 10 DAY AND t2 < t + INTERVAL 10 DAY AS holds FROM two"
_CORNERS = [("x2", "y2"), ("x2", "(y2 + 8)"), ("(x2 + 30)", "(y2 + 8)"), ("(x2 + 30)", "y2")]
SQL["circle_covers_polygon"] = f"{_NEXT} SELECT pid, {' AND '.join(_FAR.format(u=u, v=v) + ' <= 3600' for u, v in _CORNERS)} AS holds FROM two"
# a box is met if its point nearest to the centre is
SQL["circle_intersects_polygon"] = f"{_NEXT} SELECT pid, {_FAR.format(u='least(greatest(x, x2), x2 + 30)', v='least(greatest(y, y2), y2 + 8)')} <= 3600 AS holds FROM two"
SQL["polygon_area"] = f"{_NEXT} SELECT pid, 240.0::DOUBLE AS area FROM two"
SQL["point_strings"] = f"SELECT pid, 'POINT (' || printf('%.2f', x) || ' ' || printf('%.2f', y) || ')' AS spatial, strftime(t, '%Y-%m-%d %H:%M:%S') AS temporal FROM ({EVENTS})"

# -- joins -------------------------------------------------------------------------------------


def _pairs(source: str, r: float, more: str = "", op: str = "<=", cols: str = "") -> str:
    return f"WITH p AS ({source}) SELECT a.pid AS pid_a, b.pid AS pid_b{cols} FROM p a JOIN p b ON {_near(r, op)}{more}"


_DIST = f", round(sqrt({_SQUARE}), 6) AS d"
_IN3 = " AND b.t BETWEEN a.t - INTERVAL 3 DAY AND a.t + INTERVAL 3 DAY"
SQL["distance_pairs"] = _pairs(EVENTS, 2.0, cols=_DIST)
SQL["distance_pairs_open"] = _pairs(EVENTS, 2.0, op="<")
SQL["st_distance_pairs"] = _pairs(EVENTS, 5.0, _IN3, cols=_DIST)
SQL["st_month_pairs"] = _pairs(ORDERS, 5.0, " AND b.t BETWEEN a.t - to_months(6) AND a.t + to_months(6)")
SQL["distance_count"] = f"SELECT pid_a, count(*) AS n FROM ({_pairs(EVENTS, 5.0)}) GROUP BY pid_a"
SQL["st_distance_count"] = f"SELECT pid_a, count(*) AS n FROM ({_pairs(EVENTS, 5.0, _IN3)}) GROUP BY pid_a"
SQL["distance_collect"] = f"SELECT pid_a, string_agg(CAST(pid_b AS VARCHAR), ',' ORDER BY pid_b) AS partners FROM ({_pairs(EVENTS, 2.0)}) GROUP BY pid_a"
SQL["cross_pairs"] = _pairs(EVENTS, 5.0, " AND a.mark = 'click' AND b.mark = 'error'", cols=_DIST)
_FARTHER = "CASE WHEN pid % 97 = 0 THEN 80.0::DOUBLE ELSE 1.0::DOUBLE END"
_SIZED = f"""SELECT pid, mark, x - (pid % 7) * 0.25::DOUBLE * {_FARTHER} AS x0, x + (pid % 7) * 0.25::DOUBLE * {_FARTHER} AS x1,
  y - (pid % 5) * 0.125::DOUBLE * {_FARTHER} AS y0, y + (pid % 5) * 0.125::DOUBLE * {_FARTHER} AS y1, t AS t0, t + to_days(CAST(pid % 6 AS INTEGER)) AS t1 FROM ({EVENTS})"""
_meet = lambda left, right, axes, less: f"SELECT a.pid AS pid_a, b.pid AS pid_b FROM ({_SIZED}) a JOIN ({_SIZED}) b ON a.mark = '{left}' AND b.mark = '{right}' AND " + " AND ".join(f"a.{v}0 {less} b.{v}1 AND b.{v}0 {less} a.{v}1" for v in axes)
SQL["box_pairs"] = _meet("click", "error", "xyt", "<=")
SQL["box_pairs_open"] = _meet("click", "error", "xyt", "<")
SQL["box_count"] = f"SELECT pid_a, count(*) AS n FROM ({_meet('view', 'error', 'xy', '<=')}) GROUP BY pid_a"
SQL["box_collect"] = f"SELECT pid_a, string_agg(CAST(pid_b AS VARCHAR), ',' ORDER BY pid_b) AS partners FROM ({_meet('purchase', 'view', 'xyt', '<=')}) GROUP BY pid_a"
_REACH = "((a.pid % 9) * CASE WHEN a.pid % 89 = 0 THEN 10.0::DOUBLE ELSE 0.5::DOUBLE END)"
SQL["circle_pairs"] = f"SELECT a.pid AS pid_a, b.pid AS pid_b{_DIST} FROM ({EVENTS}) a JOIN ({EVENTS}) b ON a.mark = 'click' AND b.mark = 'signup' AND abs(a.x - b.x) <= {_REACH} AND {_SQUARE} <= {_REACH} * {_REACH}"
_INBOX = f"x BETWEEN {BOX[0]} AND {BOX[1]} AND y BETWEEN {BOX[2]} AND {BOX[3]}"
SQL["range_query"] = f"SELECT pid, x, y FROM ({EVENTS}) WHERE {_INBOX} AND t BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-15'"
SQL["hilbert_range"] = SQL["range_query"]
SQL["index_remove"] = f"SELECT pid FROM ({EVENTS}) WHERE NOT ({_INBOX})"
SQL["partition_envelopes"] = f"SELECT CAST(floor(x / 50) AS BIGINT) AS cx, CAST(floor(y / 50) AS BIGINT) AS cy, count(*) AS n, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y FROM ({EVENTS}) GROUP BY 1, 2"
SQL["local_count_global_sum"] = f"SELECT CAST(count(*) AS BIGINT) AS total, count(DISTINCT pid_a) AS points FROM ({_pairs(EVENTS, 5.0)})"

# -- weights -----------------------------------------------------------------------------------

SQL["weight_spatial_rect"] = f"WITH {_box(EVENTS)} SELECT pid, " + ", ".join(f"round({_weight('x', 'y', f'{r}::DOUBLE')}, 5) AS w{int(r)}" for r in (0.0, 3.0, 10.0, 40.0)) + " FROM pts, box"
SQL["weight_temporal"] = f"WITH {_box(ORDERS)} SELECT pid, {_temporal('DAYS', 't', '400')} AS days, {_temporal('MONTHS', 't', '9')} AS months, {_temporal('YEARS', 't', '0')} AS zero FROM pts, box"
SQL["weight_combined"] = f"WITH {_box(EVENTS)} SELECT pid, round({_weight('x', 'y', '6.0::DOUBLE')} * {_temporal('DAYS', 't', '4')}, 5) AS w FROM pts, box"
_SHIFT = "(greatest(0.0::DOUBLE, bx1 - bx0 - abs({dx})) * greatest(0.0::DOUBLE, by1 - by0 - abs({dy})))"
_MOVED = lambda dx, dy: f"(CASE WHEN {_SHIFT.format(dx=dx, dy=dy)} > 0 THEN least(100.0::DOUBLE, (bx1 - bx0) * (by1 - by0) / {_SHIFT.format(dx=dx, dy=dy)}) ELSE 100.0::DOUBLE END)"
SQL["weight_translation"] = f"WITH {_box(EVENTS)} SELECT pid, round({_MOVED('x / 10', 'y / 10')}, 5) AS w FROM pts, box"

# -- K functions -------------------------------------------------------------------------------


def _space(source: str, r: float, s: int, weight: str, more: str = "") -> str:
    """CTEs up to curve (i, d, pairs, sigma): sums of all pairs up to each threshold."""
    step = f"{r / s}::DOUBLE"
    return f"""WITH {_box(source)}, pairs AS (
      SELECT sqrt({_SQUARE}) AS d, a.pid AS pid_a, a.x AS ax, a.y AS ay, b.x AS ox, b.y AS oy FROM pts a JOIN pts b ON {_near(r)}{more}
    ), weighed AS (SELECT pid_a, d, {weight} AS w FROM pairs, box), grid AS (SELECT CAST(i AS INTEGER) AS i, {step} * i AS d FROM range(1, {s + 1}) g(i)),
    curve AS (SELECT g.i, g.d, CAST(count(*) AS BIGINT) AS pairs, sum(w) AS sigma FROM grid g JOIN weighed p ON p.d <= g.d GROUP BY g.i, g.d)"""


_ISO = _weight("ax", "ay", "d")
_AREA = "((bx1 - bx0) * (by1 - by0))"
_K = f"((sigma - n) / (n * (n / {_AREA})))"
_L = f"round(CASE WHEN {_K} >= 0 THEN sqrt({_K} / {_PI}) - d END, 5)"
SQL["space_k"] = f"{_space(EVENTS, 10.0, 5, _ISO)} SELECT i, d, pairs, round(sigma, 3) AS sigma, round({_K}, 4) AS k FROM curve, box"
SQL["space_l"] = f"{_space(EVENTS, 10.0, 5, _ISO)} SELECT i, d, {_L} AS l FROM curve, box"
SQL["polygon_as_rectangle_l"] = SQL["space_l"]
SQL["polygon_as_rectangle_translation"] = f"{_space(EVENTS, 10.0, 5, _MOVED('(ox - ax)', '(oy - ay)'))} SELECT i, d, {_L} AS l FROM curve, box"
SQL["space_l_translation"] = f"{_space(EVENTS, 10.0, 5, _MOVED('(ox - ax)', '(oy - ay)'))} SELECT i, d, {_L} AS l FROM curve, box"
_EDGE = "least(a.x - bx0, bx1 - a.x, a.y - by0, by1 - a.y)"
SQL["space_l_border"] = f"""WITH {_box(EVENTS)}, grid AS (SELECT CAST(i AS INTEGER) AS i, 1.0::DOUBLE * i AS d FROM range(1, 6) g(i)),
  c AS (SELECT i, count(*) AS centres FROM grid g JOIN (SELECT {_EDGE} AS edge FROM pts a, box) e ON e.edge >= g.d GROUP BY i),
  p AS (SELECT i, count(*) AS pairs FROM grid g JOIN (SELECT {_EDGE} AS edge, sqrt({_SQUARE}) AS dist FROM box, pts a JOIN pts b ON {_near(5.0)}) e ON e.edge >= g.d AND e.dist <= g.d GROUP BY i),
  k AS (SELECT g.i, g.d, coalesce(pairs, 0) AS pairs, coalesce(centres, 0) AS centres, (pairs - centres) / (centres * (n / {_AREA})) AS k FROM box, grid g LEFT JOIN c ON g.i = c.i LEFT JOIN p ON g.i = p.i)
  SELECT i, d, pairs, centres, round(CASE WHEN k >= 0 THEN sqrt(k / {_PI}) - d END, 5) AS l FROM k"""


def _st(source: str, r: float, s: int, t: int, u: int, unit: str) -> str:
    return f"""WITH {_box(source)}, pairs AS (
      SELECT sqrt({_SQUARE}) AS d, a.x AS ax, a.y AS ay, a.t AS ta, {_tau(unit, 'a.t', 'b.t')} AS tau
      FROM pts a JOIN pts b ON {_near(r)} AND b.t BETWEEN a.t - {_span(unit, str(t))} AND a.t + {_span(unit, str(t))}
    ), weighed AS (SELECT d, tau, {_ISO} * {_temporal(unit, 'ta', 'tau')} AS w FROM pairs, box),
    grid AS (SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, {r / s}::DOUBLE * i AS d, CAST({t // u} AS BIGINT) * j AS tau FROM range(1, {s + 1}) g(i), range(1, {u + 1}) h(j)),
    cells AS (SELECT g.i, g.j, g.d, g.tau, sum(w) AS sigma FROM grid g JOIN weighed p ON p.d <= g.d AND p.tau <= g.tau GROUP BY ALL),
    vol AS (SELECT *, {_AREA} * coalesce(nullif({_tau(unit, 'bt0', 'bt1')}, 0), 1) AS volume FROM box)"""


_KST = "((sigma - n) / (n * (n / volume)))"
_LST = f"round(CASE WHEN {_KST} >= 0 THEN sqrt({_KST} / (2 * {_PI} * tau)) - d END, 5)"
SQL["st_k"] = f"{_st(EVENTS, 10.0, 5, 5, 5, 'DAYS')} SELECT i, j, d, tau, round(sigma, 3) AS sigma, round({_KST}, 4) AS k FROM cells, vol"
SQL["st_l"] = f"{_st(EVENTS, 10.0, 5, 5, 5, 'DAYS')} SELECT i, j, d, tau, {_LST} AS l FROM cells, vol"
SQL["st_text"] = f"""{_st(EVENTS, 10.0, 5, 5, 5, 'DAYS')}, surface AS (SELECT i, j, CASE WHEN {_KST} >= 0 THEN sqrt({_KST} / (2 * {_PI} * tau)) - d END AS l FROM cells, vol)
  SELECT i, string_agg(coalesce(printf('%.4f', l), ''), ',' ORDER BY j) AS line FROM surface GROUP BY i"""
SQL["st_l_months"] = f"{_st(ORDERS, 10.0, 5, 12, 4, 'MONTHS')} SELECT i, j, d, tau, {_LST} AS l FROM cells, vol"
SQL["st_l_border"] = f"""WITH {_box(EVENTS)}, sites AS (SELECT a.*, {_EDGE} AS edge FROM pts a, box),
  grid AS (SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, 1.0::DOUBLE * i AS d, CAST(j AS BIGINT) AS tau FROM range(1, 6) g(i), range(1, 6) h(j)),
  c AS (SELECT i, j, count(*) AS centres FROM grid JOIN sites ON edge >= d AND t - to_days(CAST(tau AS INTEGER)) >= (SELECT bt0 FROM box) AND t + to_days(CAST(tau AS INTEGER)) <= (SELECT bt1 FROM box) GROUP BY i, j),
  near AS (SELECT a.edge, a.t, sqrt({_SQUARE}) AS dist, {_tau('DAYS', 'a.t', 'b.t')} AS apart FROM sites a JOIN sites b ON {_near(5.0)} AND b.t BETWEEN a.t - {_span('DAYS', '5')} AND a.t + {_span('DAYS', '5')}),
  p AS (SELECT i, j, count(*) AS pairs FROM grid JOIN near ON edge >= d AND dist <= d AND apart <= tau AND t - to_days(CAST(tau AS INTEGER)) >= (SELECT bt0 FROM box) AND t + to_days(CAST(tau AS INTEGER)) <= (SELECT bt1 FROM box) GROUP BY i, j),
  vol AS (SELECT {_AREA} * coalesce(nullif({_tau('DAYS', 'bt0', 'bt1')}, 0), 1) AS volume, n FROM box),
  k AS (SELECT g.*, CAST(coalesce(pairs, 0) AS BIGINT) AS pairs, coalesce(centres, 0) AS centres, (pairs - centres) / (centres * (n / volume)) AS k FROM vol, grid g LEFT JOIN c USING (i, j) LEFT JOIN p USING (i, j))
  SELECT i, j, d, tau, pairs, centres, round(CASE WHEN k >= 0 THEN sqrt(k / (2 * {_PI} * tau)) - d END, 5) AS l FROM k"""
_MARKED = "(SELECT count(*) FROM pts WHERE mark = '{}')"
SQL["cross_l"] = f"{_space(EVENTS, 10.0, 5, _ISO, ' AND a.mark = {0} AND b.mark = {1}'.format(chr(39) + 'click' + chr(39), chr(39) + 'error' + chr(39)))} SELECT i, d, pairs, round(sqrt(sigma * ({_AREA} / ({_MARKED.format('click')} * {_MARKED.format('error')})) / {_PI}) - d, 5) AS l FROM curve, box"
SQL["local_l"] = f"{_space(EVENTS, 5.0, 5, _ISO)} SELECT p.pid_a AS pid, g.i, round(sqrt(any_value({_AREA} / n) * sum(w) / {_PI}) - g.d, 5) AS l FROM box, grid g JOIN weighed p ON p.d <= g.d GROUP BY p.pid_a, g.i, g.d"
_EDGES = ", ".join(f"({a[0]}::DOUBLE, {a[1]}::DOUBLE, {b[0]}::DOUBLE, {b[1]}::DOUBLE)" for a, b in zip(OUTLINE, OUTLINE[1:]))
SQL["polygon_filter"] = f"WITH edges(ax, ay, ex, ey) AS (VALUES {_EDGES}), p AS ({EVENTS}) SELECT pid FROM p, edges WHERE (ay > y) <> (ey > y) AND x < ax + (y - ay) * (ex - ax) / (ey - ay) GROUP BY pid HAVING count(*) % 2 = 1"

# -- simulations -------------------------------------------------------------------------------

_PLACE = "place AS (SELECT pid, row_number() OVER (ORDER BY md5('place|' || pid)) AS slot FROM pts)"
_DRAWN = f"""{_PLACE}, draws AS (
  SELECT CAST(sim AS INTEGER) AS sim, CAST('0x' || substr(md5('draw|' || sim || '|' || k), 1, 15) AS BIGINT) % (SELECT count(*) FROM pts) + 1 AS slot
  FROM range(1, 4) s(sim), (SELECT row_number() OVER () - 1 AS k FROM pts)
), drawn AS (SELECT sim, pid, count(*) AS cnt FROM draws JOIN place USING (slot) GROUP BY sim, pid)"""
_PERM = f"""{_PLACE}, times AS (
  SELECT CAST(sim AS INTEGER) AS sim, t, row_number() OVER (PARTITION BY sim ORDER BY md5(sim || '|' || pid)) AS slot FROM pts, range(1, 4) s(sim)
), perm AS (SELECT sim, pid, t FROM times JOIN place USING (slot))"""
SQL["perm_times"] = f"WITH pts AS ({EVENTS}), {_PERM} SELECT sim, pid, t FROM perm"
SQL["bootstrap_draw"] = f"WITH pts AS ({EVENTS}), {_DRAWN} SELECT sim, pid, cnt FROM drawn"
_PAIRS5 = f"spairs AS (SELECT a.pid AS pid_a, b.pid AS pid_b, sqrt({_SQUARE}) AS d, a.x AS ax, a.y AS ay FROM pts a JOIN pts b ON {_near(5.0)})"
_STEP = "0.25::DOUBLE"
_ROUNDED = f"""{_box(EVENTS)}, rp AS (SELECT a.x AS ex, a.y AS ey, sqrt({_SQUARE}) AS ed, a.mark = 'click' AND b.mark = 'click' AS old FROM pts a JOIN pts b ON {_near(10.0)}),
  rk AS (SELECT *, least(ex - bx0, bx1 - ex, ey - by0, by1 - ey) < {_STEP} AS loose, floor(ex / {_STEP} + 0.5::DOUBLE) AS kx, floor(ey / {_STEP} + 0.5::DOUBLE) AS ky, floor(ed / {_STEP} + 0.5::DOUBLE) AS kr FROM rp, box)"""
SQL["weight_table_l"] = f"""WITH {_ROUNDED}, moved AS (SELECT ed, CASE WHEN loose THEN ex ELSE kx * {_STEP} END AS ax, CASE WHEN loose THEN ey ELSE ky * {_STEP} END AS ay, CASE WHEN loose THEN ed ELSE kr * {_STEP} END AS d FROM rk),
  weighed AS (SELECT ed, {_ISO} AS w FROM moved, box), grid AS (SELECT CAST(i AS INTEGER) AS i, 2.0::DOUBLE * i AS d FROM range(1, 6) g(i)),
  sums AS (SELECT g.i, g.d, count(*) AS pairs, sum(w) AS sigma FROM grid g JOIN weighed p ON p.ed <= g.d GROUP BY g.i, g.d)
  SELECT i, d, pairs, {_L} AS l FROM sums, box"""
_FOLDED = _ROUNDED.replace("pts a JOIN pts b", "sites a JOIN sites b").replace("a.mark = 'click' AND b.mark = 'click'", "a.old AND b.old").replace("rp AS", "sites AS (SELECT x, y, bool_or(mark = 'click') AS old FROM pts GROUP BY x, y), rp AS")
SQL["weight_table_hits"] = f"""WITH {_FOLDED}, each AS (SELECT count(*) AS n, bool_or(old) AS known, bool_or(loose) AS loose FROM rk GROUP BY kx, ky, kr, loose),
  sums AS (SELECT CAST(sum(n) AS BIGINT) AS pairs, CAST(sum(CASE WHEN loose THEN n WHEN known THEN 0 ELSE 1 END) AS BIGINT) AS misses FROM each)
  SELECT pairs, misses, pairs - misses AS hits, round(100.0::DOUBLE * (pairs - misses) / pairs, 4) AS hit_percent FROM sums"""
SQL["sim_envelope_space"] = f"""WITH {_box(EVENTS)}, {_DRAWN}, {_PAIRS5}, weighed AS (SELECT pid_a, pid_b, d, {_ISO} AS w FROM spairs, box),
  grid AS (SELECT CAST(i AS INTEGER) AS i, 1.0::DOUBLE * i AS d FROM range(1, 6) g(i)),
  sums AS (SELECT a.sim, g.i, g.d, sum(w * a.cnt * b.cnt) AS sigma FROM weighed p JOIN drawn a ON a.pid = p.pid_a JOIN drawn b ON b.pid = p.pid_b AND a.sim = b.sim JOIN grid g ON p.d <= g.d GROUP BY a.sim, g.i, g.d),
  curves AS (SELECT i, d, CASE WHEN {_K} >= 0 THEN sqrt({_K} / {_PI}) - d END AS l FROM sums, box)
  SELECT i, d, round(min(l), 5) AS l_min, round(max(l), 5) AS l_max FROM curves GROUP BY i, d"""
SQL["sim_envelope_st"] = f"""WITH {_box(EVENTS)}, {_PERM}, {_PAIRS5}, weighed AS (SELECT pid_a, pid_b, d, {_ISO} AS w FROM spairs, box),
  timed AS (SELECT a.sim, p.d, p.w, a.t AS ta, {_tau('DAYS', 'a.t', 'b.t')} AS tau FROM weighed p JOIN perm a ON a.pid = p.pid_a JOIN perm b ON b.pid = p.pid_b AND a.sim = b.sim
    WHERE b.t BETWEEN a.t - INTERVAL 5 DAY AND a.t + INTERVAL 5 DAY),
  grid AS (SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, 1.0::DOUBLE * i AS d, CAST(j AS BIGINT) AS tau FROM range(1, 6) g(i), range(1, 6) h(j)),
  sums AS (SELECT q.sim, g.i, g.j, g.d, g.tau, sum(q.w * {_temporal('DAYS', 'q.ta', 'q.tau')}) AS sigma FROM timed q, box, grid g WHERE q.d <= g.d AND q.tau <= g.tau GROUP BY ALL),
  vol AS (SELECT *, {_AREA} * coalesce(nullif({_tau('DAYS', 'bt0', 'bt1')}, 0), 1) AS volume FROM box),
  curves AS (SELECT i, j, d, tau, CASE WHEN {_KST} >= 0 THEN sqrt({_KST} / (2 * {_PI} * tau)) - d END AS l FROM sums, vol)
  SELECT i, j, d, tau, round(min(l), 5) AS l_min, round(max(l), 5) AS l_max FROM curves GROUP BY i, j, d, tau"""
_HEX = "(CAST('0x' || substr(h, {}, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296.0::DOUBLE"
SQL["monte_carlo_draw"] = f"""WITH {_box(EVENTS)} SELECT sim, pid, round(bx0 + (bx1 - bx0) * {_HEX.format(1)}, 6) AS x, round(by0 + (by1 - by0) * {_HEX.format(9)}, 6) AS y
  FROM box, (SELECT CAST(sim AS INTEGER) AS sim, pid, md5('csr|' || sim || '|' || pid) AS h FROM range(1, 4) s(sim), range(0, (SELECT count(*) FROM pts)) p(pid))"""



def _random(name: str, many: str) -> str:
    """(sim, x, y, t) of random points in box; many: how many of them a simulation."""
    return f"""(SELECT sim, bx0 + (bx1 - bx0) * {_HEX.format(1)} AS x, by0 + (by1 - by0) * {_HEX.format(9)} AS y, bt0 + to_seconds(CAST(floor((epoch_us(bt1) - epoch_us(bt0)) // 1000000 * ({_HEX.format(17)})) AS BIGINT)) AS t
    FROM box, (SELECT CAST(sim AS INTEGER) AS sim, md5('{name}|' || sim || '|' || pid) AS h FROM range(1, 4) s(sim), range(0, {many}) p(pid)))"""


def _random_space(first: str, second: str, k: str) -> str:
    return f"""WITH {_box(EVENTS)}, ra AS {first}, rb AS {second}, pairs AS (SELECT a.sim, a.x AS ax, a.y AS ay, sqrt({_SQUARE}) AS d FROM ra a JOIN rb b ON a.sim = b.sim AND {_near(5.0)}),
  weighed AS (SELECT sim, d, {_ISO} AS w FROM pairs, box), grid AS (SELECT CAST(i AS INTEGER) AS i, 1.0::DOUBLE * i AS d FROM range(1, 6) g(i)),
  sums AS (SELECT sim, g.i, g.d, sum(w) AS sigma FROM weighed p JOIN grid g ON p.d <= g.d GROUP BY sim, g.i, g.d),
  curves AS (SELECT i, d, CASE WHEN {k} >= 0 THEN sqrt({k} / {_PI}) - d END AS l FROM sums, box)
  SELECT i, d, round(min(l), 5) AS l_min, round(max(l), 5) AS l_max FROM curves GROUP BY i, d"""


_ALL = _random("csr", "(SELECT count(*) FROM pts)")
_MARKED = "(SELECT count(*) FROM pts WHERE mark = '{}')"
SQL["csr_envelope"] = _random_space(_ALL, _ALL, _K)
SQL["csr_cross_envelope"] = _random_space(_random("csr", _MARKED.format("click")), _random("csr2", _MARKED.format("error")), f"(sigma * ({_AREA} / ({_MARKED.format('click')} * {_MARKED.format('error')})))")
SQL["csr_st_envelope"] = f"""WITH {_box(EVENTS)}, ra AS {_ALL}, pairs AS (SELECT a.sim, a.x AS ax, a.y AS ay, a.t AS ta, {_tau('DAYS', 'a.t', 'b.t')} AS tau, sqrt({_SQUARE}) AS d
    FROM ra a JOIN ra b ON a.sim = b.sim AND {_near(5.0)} AND b.t BETWEEN a.t - INTERVAL 5 DAY AND a.t + INTERVAL 5 DAY),
  weighed AS (SELECT sim, d, tau, {_ISO} * {_temporal('DAYS', 'ta', 'tau')} AS w FROM pairs, box),
  grid AS (SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, 1.0::DOUBLE * i AS d, CAST(j AS BIGINT) AS tau FROM range(1, 6) g(i), range(1, 6) h(j)),
  sums AS (SELECT sim, g.i, g.j, g.d, g.tau, sum(w) AS sigma FROM grid g JOIN weighed p ON p.d <= g.d AND p.tau <= g.tau GROUP BY ALL),
  vol AS (SELECT *, {_AREA} * coalesce(nullif({_tau('DAYS', 'bt0', 'bt1')}, 0), 1) AS volume FROM box),
  curves AS (SELECT i, j, d, tau, CASE WHEN {_KST} >= 0 THEN sqrt({_KST} / (2 * {_PI} * tau)) - d END AS l FROM sums, vol)
  SELECT i, j, d, tau, round(min(l), 5) AS l_min, round(max(l), 5) AS l_max FROM curves GROUP BY i, j, d, tau"""


# A polygon's weight: the circle is cut where it meets edges, and arcs count by their midpoints.
_SIDES = ", ".join(f"({a[0]}::DOUBLE, {a[1]}::DOUBLE, {b[0]}::DOUBLE, {b[1]}::DOUBLE)" for ring in HOUSE for a, b in zip(ring, ring[1:]))
_SHARE = abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(HOUSE[0], HOUSE[0][1:]))) / 2 - abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(HOUSE[1], HOUSE[1][1:]))) / 2
_BORDER = f"""edges AS (SELECT px, py, qx - px AS gx, qy - py AS gy FROM (
    SELECT bx0 + u * (bx1 - bx0) AS px, by0 + v * (by1 - by0) AS py, bx0 + u2 * (bx1 - bx0) AS qx, by0 + v2 * (by1 - by0) AS qy FROM box, (VALUES {_SIDES}) e(u, v, u2, v2)))"""
_CROSSES = lambda x, y: f"(py > {y}) <> (py + gy > {y}) AND {x} < px + ({y} - py) / gy * gx"
_ALONG = "greatest(0.0::DOUBLE, least(1.0::DOUBLE, ((x - px) * gx + (y - py) * gy) / (gx * gx + gy * gy)))"


def _polygon(r: float, s: int) -> str:
    """CTEs from ins (pid, x, y) and edges up to curve (i, d, pairs, sigma) and size (n, area)."""
    root = "qb * qb - qa * qc"
    return f"""sites AS (SELECT pid, x, y, min(sqrt((x - px - {_ALONG} * gx) ** 2 + (y - py - {_ALONG} * gy) ** 2)) AS edge FROM ins, edges GROUP BY pid, x, y),
  pairs AS (SELECT row_number() OVER () AS k, a.x AS ax, a.y AS ay, a.edge, sqrt({_SQUARE}) AS d FROM sites a JOIN sites b ON {_near(r)}),
  far AS (SELECT k, ax, ay, d FROM pairs WHERE d > edge),
  lines AS (SELECT *, gx * gx + gy * gy AS qa, (px - ax) * gx + (py - ay) * gy AS qb, (px - ax) ** 2 + (py - ay) ** 2 - d * d AS qc FROM far, edges),
  meets AS (SELECT *, unnest([(-qb - sqrt({root})) / qa, (-qb + sqrt({root})) / qa]) AS s FROM lines WHERE {root} > 0),
  cuts AS (SELECT k, ax, ay, d, atan2(py + s * gy - ay, px + s * gx - ax) AS th FROM meets WHERE s BETWEEN 0 AND 1),
  arcs AS (
    SELECT k, ax, ay, d, th AS lo, coalesce(lead(th) OVER w, first_value(th) OVER w + 2 * {_PI}) AS hi FROM cuts WINDOW w AS (PARTITION BY k ORDER BY th)
    UNION ALL SELECT k, ax, ay, d, 0.7 - {_PI}, 0.7 + {_PI} FROM far WHERE k NOT IN (SELECT k FROM cuts)
  ),
  mids AS (SELECT k, lo, hi, ax + d * cos((lo + hi) / 2) AS mx, ay + d * sin((lo + hi) / 2) AS my FROM arcs),
  kept AS (SELECT k, hi - lo AS arc FROM mids, edges WHERE {_CROSSES("mx", "my")} GROUP BY k, lo, hi HAVING count(*) % 2 = 1),
  inside AS (SELECT k, sum(arc) AS angle FROM kept GROUP BY k),
  weighed AS (SELECT d, CASE WHEN d <= edge THEN 1.0::DOUBLE WHEN angle > 1e-12 THEN least(100.0::DOUBLE, 2 * {_PI} / angle) ELSE 100.0::DOUBLE END AS w FROM pairs LEFT JOIN inside USING (k)),
  grid AS (SELECT CAST(i AS INTEGER) AS i, {r / s}::DOUBLE * i AS d FROM range(1, {s + 1}) g(i)),
  curve AS (SELECT g.i, g.d, CAST(count(*) AS BIGINT) AS pairs, sum(w) AS sigma FROM grid g JOIN weighed p ON p.d <= g.d GROUP BY g.i, g.d),
  size AS (SELECT (SELECT count(*) FROM ins) AS n, {_AREA} * {_SHARE}::DOUBLE AS area FROM box)"""


_KPOLY = "((sigma - n) / (n * (n / area)))"
_LPOLY = f"round(CASE WHEN {_KPOLY} >= 0 THEN sqrt({_KPOLY} / {_PI}) - d END, 5)"
SQL["polygon_l"] = f"""WITH {_box(EVENTS)}, {_BORDER},
  ins AS (SELECT pid, x, y FROM pts, edges WHERE {_CROSSES("x", "y")} GROUP BY pid, x, y HAVING count(*) % 2 = 1),
  {_polygon(10.0, 5)} SELECT i, d, pairs, {_LPOLY} AS l FROM curve, size"""
SQL["monte_carlo_space"] = f"""WITH {_box(EVENTS)}, {_BORDER},
  drawn AS (SELECT pid, h, bx0 + (bx1 - bx0) * {_HEX.format(1)} AS x, by0 + (by1 - by0) * {_HEX.format(9)} AS y FROM box, (SELECT pid, md5('csr|1|' || pid) AS h FROM range(0, {int(400 / _SHARE * 3) + 64}) p(pid))),
  ins AS (SELECT pid, x, y FROM drawn, edges WHERE {_CROSSES("x", "y")} GROUP BY pid, h, x, y HAVING count(*) % 2 = 1 ORDER BY h LIMIT 400),
  {_polygon(50.0, 5)} SELECT i, d, {_LPOLY} AS l FROM curve, size"""
_TURN = lambda ring: sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:])) > 0
# 1 where an edge bounds the region on its left
_BOUNDS = ", ".join(
    f"({a[0]}::DOUBLE, {a[1]}::DOUBLE, {b[0]}::DOUBLE, {b[1]}::DOUBLE, {1 if (_TURN(ring) == (k == 0)) == (b[1] < a[1]) else -1})" for k, ring in enumerate(HOUSE) for a, b in zip(ring, ring[1:]) if a[1] != b[1]
)
_GAP = lambda y: f"(e.xl + ({y} - e.yl) * e.slope - f.xl - hx - ({y} - f.yl - hy) * f.slope)"
_SHARED = f"""sides AS (SELECT side, CASE WHEN v < v2 THEN u ELSE u2 END * (bx1 - bx0) + bx0 AS xl, by0 + least(v, v2) * (by1 - by0) AS yl, by0 + greatest(v, v2) * (by1 - by0) AS yh,
    (u2 - u) * (bx1 - bx0) / ((v2 - v) * (by1 - by0)) AS slope FROM box, (VALUES {_BOUNDS}) e(u, v, u2, v2, side)),
  shifts AS (SELECT i, j, i * (10.0::DOUBLE / 64) AS hx, j * (10.0::DOUBLE / 64) AS hy FROM range(-64, 65) g(i), range(0, 65) h(j)),
  gaps AS (SELECT i, j, e.side * f.side AS s, high - low AS tall, {_GAP("low")} AS d0, {_GAP("high")} AS d1
    FROM shifts, sides e, sides f, LATERAL (SELECT greatest(e.yl, f.yl + hy) AS low, least(e.yh, f.yh + hy) AS high) WHERE low < high),
  areas AS (SELECT i, j, greatest(0.0::DOUBLE, -sum(s * tall * CASE WHEN d0 > 0 AND d1 < 0 THEN d0 * d0 / (d0 - d1) WHEN d0 < 0 AND d1 > 0 THEN d1 * d1 / (d1 - d0) ELSE greatest(d0, 0) + greatest(d1, 0) END) / 2) AS area FROM gaps GROUP BY i, j)"""
SQL["polygon_l_translation"] = f"""WITH {_box(EVENTS)}, {_BORDER}, {_SHARED},
  ins AS (SELECT pid, x, y FROM pts, edges WHERE {_CROSSES("x", "y")} GROUP BY pid, x, y HAVING count(*) % 2 = 1),
  size AS (SELECT (SELECT count(*) FROM ins) AS n, {_AREA} * {_SHARE}::DOUBLE AS area FROM box),
  moves AS (SELECT sqrt({_SQUARE}) AS d, CASE WHEN b.y < a.y THEN -1 ELSE 1 END * (b.x - a.x) / (10.0::DOUBLE / 64) AS u, abs(b.y - a.y) / (10.0::DOUBLE / 64) AS v FROM ins a JOIN ins b ON {_near(10.0)}),
  placed AS (SELECT *, CAST(least(63, floor(u)) AS BIGINT) AS ci, CAST(least(63, floor(v)) AS BIGINT) AS cj FROM moves),
  mixed AS (SELECT d, (1 - (u - ci)) * (1 - (v - cj)) * a.area + (u - ci) * (1 - (v - cj)) * b.area + (1 - (u - ci)) * (v - cj) * c.area + (u - ci) * (v - cj) * e.area AS shared FROM placed
    JOIN areas a ON a.i = ci AND a.j = cj JOIN areas b ON b.i = ci + 1 AND b.j = cj JOIN areas c ON c.i = ci AND c.j = cj + 1 JOIN areas e ON e.i = ci + 1 AND e.j = cj + 1),
  weighed AS (SELECT d, CASE WHEN shared > 0 THEN least(100.0::DOUBLE, area / shared) ELSE 100.0::DOUBLE END AS w FROM mixed, size),
  grid AS (SELECT CAST(i AS INTEGER) AS i, 2.0::DOUBLE * i AS d FROM range(1, 6) g(i)),
  curve AS (SELECT g.i, g.d, CAST(count(*) AS BIGINT) AS pairs, sum(w) AS sigma FROM grid g JOIN weighed p ON p.d <= g.d GROUP BY g.i, g.d)
  SELECT i, d, pairs, {_LPOLY} AS l FROM curve, size"""
SQL["polygon_l_border"] = f"""WITH {_box(EVENTS)}, {_BORDER},
  ins AS (SELECT pid, x, y FROM pts, edges WHERE {_CROSSES("x", "y")} GROUP BY pid, x, y HAVING count(*) % 2 = 1),
  sites AS (SELECT pid, x, y, min(sqrt((x - px - {_ALONG} * gx) ** 2 + (y - py - {_ALONG} * gy) ** 2)) AS edge FROM ins, edges GROUP BY pid, x, y),
  size AS (SELECT (SELECT count(*) FROM ins) AS n, {_AREA} * {_SHARE}::DOUBLE AS area FROM box),
  grid AS (SELECT CAST(i AS INTEGER) AS i, 1.0::DOUBLE * i AS d FROM range(1, 6) g(i)),
  c AS (SELECT i, count(*) AS centres FROM grid g JOIN sites e ON e.edge >= g.d GROUP BY i),
  p AS (SELECT i, count(*) AS pairs FROM grid g JOIN (SELECT a.edge, sqrt({_SQUARE}) AS dist FROM sites a JOIN sites b ON {_near(5.0)}) e ON e.edge >= g.d AND e.dist <= g.d GROUP BY i),
  k AS (SELECT g.i, g.d, coalesce(pairs, 0) AS pairs, coalesce(centres, 0) AS centres, (pairs - centres) / (centres * (n / area)) AS k FROM size, grid g LEFT JOIN c ON g.i = c.i LEFT JOIN p ON g.i = p.i)
  SELECT i, d, pairs, centres, round(CASE WHEN k >= 0 THEN sqrt(k / {_PI}) - d END, 5) AS l FROM k"""
_DISTRICTS = f"""{_box(EVENTS)}, edges AS (SELECT region, px, py, qx - px AS gx, qy - py AS gy FROM (
    SELECT r_regionkey AS region, bx0 + (r_regionkey + u) * ((bx1 - bx0) / 5) AS px, by0 + v * (by1 - by0) AS py, bx0 + (r_regionkey + u2) * ((bx1 - bx0) / 5) AS qx, by0 + v2 * (by1 - by0) AS qy
    FROM box, region, (VALUES {_SIDES}) e(u, v, u2, v2))),
  members AS (SELECT pid, CAST(region AS BIGINT) AS region FROM pts, edges WHERE {_CROSSES("x", "y")} GROUP BY pid, region HAVING count(*) % 2 = 1)"""
SQL["polygon_members"] = f"WITH {_DISTRICTS} SELECT pid, region FROM members"
SQL["polygon_counts"] = f"WITH {_DISTRICTS} SELECT region, count(*) AS n FROM members GROUP BY region"
SQL["multipolygon_filter"] = f"WITH {_DISTRICTS} SELECT pid FROM members WHERE region <> 2"
SQL["result_merge"] = f"""WITH cells AS (SELECT mark, CAST(floor(x / 100) AS INTEGER) AS i, CAST(floor(y / 5) AS INTEGER) AS j, CAST(count(*) AS DOUBLE) AS k, min(x) AS lo, max(x) AS hi FROM ({EVENTS}) GROUP BY 1, 2, 3)
  SELECT i, j, arg_max(k, mark) AS kest, min(lo) AS kmin, max(hi) AS kmax FROM cells GROUP BY i, j"""

# -- cube --------------------------------------------------------------------------------------

_WHEN = "t >= TIMESTAMP '2024-01-05' AND t < TIMESTAMP '2024-01-15'"
SQL["cube_category_filter"] = f"SELECT pid, mark FROM ({EVENTS}) WHERE mark IN ('click', 'view')"
SQL["cube_category_counts"] = f"SELECT mark, count(*) AS n FROM ({EVENTS}) GROUP BY mark"
SQL["cube_time_interval"] = f"SELECT pid, t FROM ({EVENTS}) WHERE {_WHEN}"
_BUCKET = "CAST(floor((epoch(t) - 1704067200) / {}) AS BIGINT)"
SQL["cube_time_series"] = f"SELECT {_BUCKET.format(14400)} AS bucket, count(*) AS n FROM ({EVENTS}) GROUP BY 1 HAVING bucket BETWEEN 0 AND 299"
SQL["cube_rect_count"] = f"SELECT count(*) AS n FROM ({EVENTS}) WHERE {_INBOX}"
SQL["cube_tile_counts"] = f"SELECT tile_x, tile_y, count(*) AS n FROM ({_tiles(ZOOM + 2)}) GROUP BY 1, 2"
SQL["cube_tile_stats"] = f"SELECT min(n) AS min_n, max(n) AS max_n, count(*) AS tiles FROM ({SQL['cube_tile_counts']})"
SQL["cube_topk"] = f"SELECT mark || CAST(pid % 17 AS VARCHAR) AS mark, count(*) AS n FROM ({EVENTS}) GROUP BY 1 ORDER BY n DESC, 1 LIMIT 25"
SQL["cube_total"] = f"SELECT count(*) AS n FROM ({EVENTS}) WHERE {_INBOX} AND {_WHEN} AND mark IN ('click', 'view')"
SQL["cube_crossfilter"] = f"""SELECT 'category' AS chart, mark AS key, count(*) AS n FROM ({EVENTS}) WHERE {_INBOX} AND {_WHEN} GROUP BY mark
  UNION ALL SELECT 'series', CAST({_BUCKET.format(86400)} AS VARCHAR), count(*) FROM ({EVENTS}) WHERE {_INBOX} AND mark = 'click' AND {_BUCKET.format(86400)} BETWEEN 0 AND 39 GROUP BY 2
  UNION ALL SELECT 'total', '', count(*) FROM ({EVENTS}) WHERE {_INBOX} AND {_WHEN} AND mark = 'click'"""
_zoom = lambda z: f"SELECT {z} AS zoom, CAST(tile_x AS BIGINT) AS tile_x, CAST(tile_y AS BIGINT) AS tile_y, mark FROM ({_tiles(z)})"
SQL["cube_pyramid"] = "SELECT zoom, tile_x, tile_y, mark, count(*) AS n FROM (" + " UNION ALL ".join(map(_zoom, range(8))) + ") GROUP BY ALL"
SQL["cube_merge"] = f"SELECT zoom, tile_x, tile_y, count(*) AS n FROM ({_zoom(5)}) WHERE tile_x BETWEEN 8 AND 15 AND tile_y BETWEEN 16 AND 23 GROUP BY ALL"
SQL["cube_time_bounds"] = f"SELECT min(t) AS first, max(t) AS last FROM ({EVENTS})"
SQL["cube_bbox"] = f"SELECT min(lat) AS min_x, max(lat) AS max_x, min(lon) AS min_y, max(lon) AS max_y FROM ({LATLON})"
SQL["cube_pivot_grid"] = "SELECT *, round(sqrt(total), 5) AS height FROM (SELECT tile_x, tile_y, " + ", ".join(f"count(*) FILTER (mark = '{m}') AS {m}" for m in ("click", "error", "purchase", "signup", "view")) + f", count(*) AS total FROM ({_tiles(ZOOM)}) GROUP BY 1, 2)"
