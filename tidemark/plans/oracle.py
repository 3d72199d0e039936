"""SQL (DuckDB) for the queries of the catalogue, written apart from it: tiles by BETWEEN, neighbours by offset joins,
components by recursion."""

from __future__ import annotations

SQL: dict[str, str] = {}

_FX = {
    "orders": (
        "SELECT 'orders' AS s, o_orderkey // 128 AS r, o_orderkey % 128 AS c, o_totalprice AS v FROM orders",
        "SELECT 'orders' AS s, CAST(max(r) + 1 AS BIGINT) AS h, CAST(128 AS BIGINT) AS w FROM fx",
    ),
    "embeddings": (
        "SELECT 'embeddings' AS s, vec_id AS r, CAST(generate_subscripts(embedding, 1) - 1 AS BIGINT) AS c, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings",
        "SELECT 'embeddings' AS s, CAST(max(r) + 1 AS BIGINT) AS h, CAST(max(c) + 1 AS BIGINT) AS w FROM fx",
    ),
    "events": (
        "SELECT s, r, c, round(avg(value), 6) AS v FROM (SELECT event_type AS s, user_id AS r, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS BIGINT) AS c, value FROM events) WHERE r IS NOT NULL AND c BETWEEN 0 AND 29 GROUP BY s, r, c",
        "SELECT s, CAST(max(r) + 1 AS BIGINT) AS h, CAST(30 AS BIGINT) AS w FROM fx GROUP BY s",
    ),
    "lineitem": (
        "SELECT 'lineitem' AS s, l_orderkey % 200 AS r, l_partkey % 200 AS c, round(avg(l_extendedprice), 6) AS v FROM lineitem GROUP BY ALL",
        "SELECT 'lineitem' AS s, CAST(200 AS BIGINT) AS h, CAST(200 AS BIGINT) AS w",
    ),
}


def _with(raster: str, *ctes: str) -> str:
    """The raster's cells ``fx(s, r, c, v)`` and sizes ``dims(s, h, w)``, and more table expressions."""
    cells, dims = _FX[raster]
    return ",\n".join((f"WITH RECURSIVE fx AS MATERIALIZED ({cells})", f"dims AS MATERIALIZED ({dims})", *ctes)) + "\n"


_STATS = "st AS (SELECT s, round(quantile_cont(v, 0.02), 6) AS lo, round(quantile_cont(v, 0.98), 6) AS hi FROM fx GROUP BY s)"


def _scaled(v: str, lo: str = "lo", hi: str = "hi") -> str:
    return f"CASE WHEN {hi} > {lo} THEN CAST(greatest(CAST(0 AS FLOAT), least(CAST(1 AS FLOAT), (CAST({v} AS FLOAT) - CAST({lo} AS FLOAT)) / CAST({hi} - {lo} AS FLOAT))) AS FLOAT) ELSE CAST(0 AS FLOAT) END"


_NORM = f"nm AS MATERIALIZED (SELECT s, r, c, v, {_scaled('v')} AS norm FROM fx JOIN st USING (s))"
_DARK = "m AS MATERIALIZED (SELECT s, r, c FROM nm WHERE norm < CAST(0.3 AS FLOAT))"
_CELL = "s AS scene_id, r AS row, c AS col"
_AXES = """ys AS (SELECT s, h, w, unnest(list_sort(list_distinct(list_append(range(0, greatest(h - 16, 0) + 1, 14), greatest(h - 16, 0))))) AS y FROM dims),
xs AS (SELECT s, unnest(list_sort(list_distinct(list_append(range(0, greatest(w - 16, 0) + 1, 14), greatest(w - 16, 0))))) AS x FROM dims),
tiles AS MATERIALIZED (SELECT s, dense_rank() OVER (PARTITION BY s ORDER BY y) - 1 AS gi, dense_rank() OVER (PARTITION BY s ORDER BY x) - 1 AS gj, y, x, h, w FROM ys JOIN xs USING (s))"""
_ON = "{a}.s = t.s AND {a}.r BETWEEN t.y AND t.y + 15 AND {a}.c BETWEEN t.x AND t.x + 15"


def _shape(name: str, radius: int, square: bool = False) -> str:
    test = "TRUE" if square else f"a.i * a.i + b.i * b.i <= {radius * radius}"
    return f"{name} AS (SELECT a.i AS dr, b.i AS dc FROM range({-radius}, {radius + 1}) a(i) CROSS JOIN range({-radius}, {radius + 1}) b(i) WHERE {test})"


def _erode(out: str, mask: str, shape: str, dims: str = "dims") -> str:
    return f"""{out} AS MATERIALIZED (SELECT m.s, m.r, m.c FROM {mask} m JOIN {dims} d ON d.s = m.s CROSS JOIN {shape} o LEFT JOIN {mask} n ON n.s = m.s AND n.r = m.r + o.dr AND n.c = m.c + o.dc
WHERE m.r + o.dr BETWEEN 0 AND d.h - 1 AND m.c + o.dc BETWEEN 0 AND d.w - 1 GROUP BY m.s, m.r, m.c HAVING count(*) = count(n.s))"""


def _dilate(out: str, mask: str, shape: str, dims: str = "dims") -> str:
    return f"""{out} AS MATERIALIZED (SELECT DISTINCT m.s, m.r + o.dr AS r, m.c + o.dc AS c FROM {mask} m JOIN {dims} d ON d.s = m.s CROSS JOIN {shape} o
WHERE m.r + o.dr BETWEEN 0 AND d.h - 1 AND m.c + o.dc BETWEEN 0 AND d.w - 1)"""


def _components(p: str, mask: str, reach: int = 1) -> str:
    """``{p}cc(id, l)``: for each cell of one scene (id: row * 100000 + column) the least id of its component."""
    near = "abs(a.i) + abs(b.i) = 1" if reach == 0 else "a.i <> 0 OR b.i <> 0"
    return f"""{p}f AS MATERIALIZED (SELECT r * 100000 + c AS id, r, c FROM {mask}),
{p}e AS MATERIALIZED (SELECT x.id AS s, z.id AS d FROM {p}f x CROSS JOIN (SELECT a.i AS dr, b.i AS dc FROM range(-1, 2) a(i) CROSS JOIN range(-1, 2) b(i) WHERE {near}) o JOIN {p}f z ON z.r = x.r + o.dr AND z.c = x.c + o.dc),
{p}cc(id, l) USING KEY (id) AS (SELECT id, id FROM {p}f UNION SELECT e.d, min(cc.l) FROM {p}cc AS cc JOIN {p}e e ON e.s = cc.id JOIN recurring.{p}cc k ON k.id = e.d WHERE cc.l < k.l GROUP BY e.d)"""


def _large(out: str, p: str, mask: str, least: int) -> str:
    return f"{out} AS MATERIALIZED (SELECT '{mask}' AS s, id // 100000 AS r, id % 100000 AS c, l FROM {p}cc WHERE l IN (SELECT l FROM {p}cc GROUP BY l HAVING count(*) >= {least}))"


# --- statistics and scaling
SQL["scene_percentiles"] = f"""WITH a AS (SELECT * FROM ({_FX['orders'][0]}) UNION ALL SELECT * FROM ({_FX['events'][0]}))
SELECT s AS scene_id, round(quantile_cont(v, 0.02), 6) AS lo, round(quantile_cont(v, 0.98), 6) AS hi FROM a GROUP BY s"""
SQL["scene_percentiles_strided"] = _with("orders") + "SELECT s AS scene_id, round(quantile_cont(v, 0.02), 6) AS lo, round(quantile_cont(v, 0.98), 6) AS hi FROM fx WHERE (r * 128 + c) % 7 = 0 GROUP BY s"
_MEDIAN = "md AS (SELECT s, round(quantile_cont(CAST(CAST(v AS FLOAT) AS DOUBLE), 0.5), 6) AS median FROM fx GROUP BY s)"
SQL["scene_median"] = _with("events", _MEDIAN) + "SELECT s AS scene_id, median FROM md"
SQL["normalize_scene"] = _with("orders", _STATS, _NORM) + f"SELECT {_CELL}, round(CAST(norm AS DOUBLE), 6) AS norm FROM nm"
_TILE_NORM = f"""tv AS MATERIALIZED (SELECT t.s, t.y, t.x, f.r, f.c, f.v FROM tiles t JOIN fx f ON {_ON.format(a='f')}),
ts AS (SELECT s, y, x, round(quantile_cont(v, 0.02), 6) AS lo, round(quantile_cont(v, 0.98), 6) AS hi FROM tv GROUP BY s, y, x),
tn AS (SELECT s, y, x, r, c, {_scaled('v')} AS norm FROM tv JOIN ts USING (s, y, x))"""
SQL["normalize_tile_scope"] = _with("embeddings", _AXES, _TILE_NORM) + "SELECT s AS scene_id, y, x, r AS row, c AS col, round(CAST(norm AS DOUBLE), 6) AS norm FROM tn"
SQL["normalize_fixed_db"] = _with("lineitem") + f"SELECT {_CELL}, round(CAST({_scaled('v', '20000.0::DOUBLE', '60000.0::DOUBLE')} AS DOUBLE), 6) AS norm FROM fx"
_FULL = "full_grid AS MATERIALIZED (SELECT s, r, c FROM (SELECT s, w, unnest(range(0, h)) AS r FROM dims) CROSS JOIN LATERAL (SELECT unnest(range(0, w)) AS c))"
SQL["valid_pixels"] = _with("events", _FULL) + """SELECT s AS scene_id, count(*) FILTER (f.v IS NULL) AS n_invalid, min(g.r) FILTER (f.v IS NULL) AS first_row, count(f.v) AS n_valid
FROM full_grid g LEFT JOIN fx f USING (s, r, c) GROUP BY s"""
_INFILL = "inf AS MATERIALIZED (SELECT s, r, c, coalesce(f.v, md.median) AS v, f.v IS NOT NULL AS ok FROM full_grid g LEFT JOIN fx f USING (s, r, c) JOIN md USING (s))"
SQL["infill_median"] = _with("lineitem", _MEDIAN, _FULL, _INFILL) + f"SELECT {_CELL}, v AS value, ok AS valid FROM inf"

# --- tiles
SQL["tile_starts"] = _with("orders", _AXES) + "SELECT 'y' AS axis, y AS start FROM ys UNION ALL SELECT 'x', x FROM xs"
SQL["tile_grid"] = _with("orders", _AXES) + "SELECT s AS scene_id, gi, gj, y, x, h AS height, w AS width FROM tiles"
SQL["pad_edge"] = _with("embeddings") + """SELECT 'embeddings' AS scene_id, p.r AS row, q.c AS col, v AS value FROM (SELECT unnest(range(0, h)) AS r FROM dims) p CROSS JOIN range(0, 96) q(c) JOIN fx ON fx.r = p.r AND fx.c = least(q.c, 63)"""
_INVALID = f"tf AS MATERIALIZED (SELECT t.*, 256 - count(f.v) AS n_invalid, (256 - count(f.v)) / 256.0::DOUBLE AS frac FROM tiles t LEFT JOIN fx f ON {_ON.format(a='f')} GROUP BY ALL)"
SQL["tile_invalid_fraction"] = _with("lineitem", _AXES, _INVALID) + "SELECT s AS scene_id, y, x, n_invalid, round(frac, 6) AS invalid_fraction FROM tf"
_TOUCH = "(y = 0 OR x = 0 OR y + 16 >= h OR x + 16 >= w)"
_WHY = "'invalid_pixel_fraction_above_threshold'"
SQL["tile_partition"] = _with("lineitem", _AXES, _INVALID) + f"SELECT s AS scene_id, y, x, gi, gj, frac <= 0.2 AS eligible, {_TOUCH} AS touches_scene_boundary, CASE WHEN frac > 0.2 THEN {_WHY} END AS reason FROM tf"
SQL["boundary_rejects"] = _with(
    "lineitem", _AXES, _INVALID, _FULL, "bad AS MATERIALIZED (SELECT s, r, c FROM full_grid ANTI JOIN fx USING (s, r, c))", _shape("o", 1, True), _dilate("near", "bad", "o"),
    f"nt AS (SELECT DISTINCT t.s, t.y, t.x FROM tiles t JOIN near n ON {_ON.format(a='n')})",
) + f"""SELECT tf.s AS scene_id, tf.y, tf.x, nt.s IS NOT NULL AS adjacent_to_nodata, frac <= 0.2 AND NOT {_TOUCH.replace('y ', 'tf.y ').replace('x ', 'tf.x ')} AND nt.s IS NULL AS eligible,
CASE WHEN frac > 0.2 THEN {_WHY} WHEN {_TOUCH.replace('y ', 'tf.y ').replace('x ', 'tf.x ')} OR nt.s IS NOT NULL THEN 'boundary_or_nodata_adjacent' END AS reason
FROM tf LEFT JOIN nt ON nt.s = tf.s AND nt.y = tf.y AND nt.x = tf.x"""  # fmt: skip
SQL["overlap_average"] = _with("embeddings", _AXES, _TILE_NORM) + f"SELECT {_CELL}, round(CAST(CAST(round(avg(CAST(norm AS DOUBLE)), 6) AS FLOAT) AS DOUBLE), 5) AS prob, count(*) AS n_tiles FROM tn GROUP BY s, r, c"
SQL["classical_union"] = _with("orders", _STATS, _NORM) + """SELECT s AS scene_id, r AS row, count_if(norm < CAST(0.1 AS FLOAT)) AS n_seg, count_if(norm < CAST(0.3 AS FLOAT)) AS n_classical,
count_if(norm < CAST(0.1 AS FLOAT) OR norm < CAST(0.3 AS FLOAT)) AS n_union FROM nm GROUP BY s, r"""
SQL["tile_coverage_count"] = _with("orders", _AXES) + f"SELECT f.s AS scene_id, f.r AS row, f.c AS col, count(*) AS n_tiles FROM fx f JOIN tiles t ON {_ON.format(a='f')} GROUP BY f.s, f.r, f.c"
SQL["identity_stitch"] = _with("embeddings", _STATS, _NORM) + f"SELECT {_CELL}, round(CAST(CAST(round(CAST(norm AS DOUBLE), 6) AS FLOAT) AS DOUBLE), 5) AS prob, TRUE AS same FROM nm"

# --- morphology
_BRIGHT = "m AS MATERIALIZED (SELECT s, r, c FROM nm WHERE norm < CAST(0.75 AS FLOAT))"
SQL["erode_disk2"] = _with("embeddings", _STATS, _NORM, _BRIGHT, _shape("o", 2), _erode("er", "m", "o")) + f"SELECT {_CELL} FROM er"
SQL["open_disk2"] = _with("embeddings", _STATS, _NORM, _BRIGHT, _shape("o", 2), _erode("er", "m", "o"), _dilate("op", "er", "o")) + f"SELECT {_CELL} FROM op"
SQL["mask_boundary"] = _with("orders", _STATS, _NORM, _DARK) + f"""SELECT {_CELL} FROM m WHERE NOT (EXISTS (SELECT 1 FROM m n WHERE n.r = m.r - 1 AND n.c = m.c) AND EXISTS (SELECT 1 FROM m n WHERE n.r = m.r + 1 AND n.c = m.c)
AND EXISTS (SELECT 1 FROM m n WHERE n.r = m.r AND n.c = m.c - 1) AND EXISTS (SELECT 1 FROM m n WHERE n.r = m.r AND n.c = m.c + 1))"""

# --- screening of the grid of line items
_SCREEN = [
    _AXES, _INVALID, _STATS, _MEDIAN, _FULL, _INFILL,
    f"mi AS MATERIALIZED (SELECT t.s, t.y, t.x, f.r, f.c, f.ok, {_scaled('f.v')} AS norm FROM tf t JOIN inf f ON {_ON.format(a='f')} JOIN st ON st.s = t.s WHERE t.frac <= 0.2)",
    "sc AS (SELECT s, y, x, avg(CASE WHEN norm < CAST(0.3 AS FLOAT) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS p FROM mi GROUP BY s, y, x)",
    "gt AS MATERIALIZED (SELECT tf.*, sc.p, coalesce(sc.p >= 0.21, FALSE) AS passed FROM tf LEFT JOIN sc USING (s, y, x))",
    "gd AS MATERIALIZED (SELECT s, max(gi) + 1 AS h, max(gj) + 1 AS w FROM gt GROUP BY s)",
    "gm AS MATERIALIZED (SELECT s, gi AS r, gj AS c FROM gt WHERE passed)", _shape("q", 1, True), _dilate("g1", "gm", "q", "gd"),
    "g2 AS MATERIALIZED (SELECT a.s, a.r, a.c FROM g1 a CROSS JOIN q o JOIN g1 b ON b.s = a.s AND b.r = a.r + o.dr AND b.c = a.c + o.dc GROUP BY a.s, a.r, a.c HAVING count(*) = 9)",
]


def _fill(out: str, mask: str) -> list[str]:
    """Hole filling on the tile grid by recursion over the background from its edge."""
    return [
        f"{out}g AS MATERIALIZED (SELECT gt.s, gt.gi AS r, gt.gj AS c FROM gt WHERE NOT EXISTS (SELECT 1 FROM {mask} k WHERE k.s = gt.s AND k.r = gt.gi AND k.c = gt.gj))",
        f"""{out}b AS (SELECT g.s, g.r, g.c FROM {out}g g JOIN gd ON gd.s = g.s WHERE g.r = 0 OR g.c = 0 OR g.r = gd.h - 1 OR g.c = gd.w - 1
UNION SELECT g.s, g.r, g.c FROM {out}b b JOIN {out}g g ON g.s = b.s AND abs(g.r - b.r) + abs(g.c - b.c) = 1)""",
        f"{out} AS MATERIALIZED (SELECT s, r, c FROM {mask} UNION SELECT s, r, c FROM (SELECT s, r, c FROM {out}g EXCEPT SELECT s, r, c FROM {out}b))",
    ]


_FINAL = [*_SCREEN, *_fill("g3", "g2"), "fi AS MATERIALIZED (SELECT gt.*, gt.frac <= 0.2 AND (gt.passed OR EXISTS (SELECT 1 FROM g3 WHERE g3.s = gt.s AND g3.r = gt.gi AND g3.c = gt.gj)) AS final FROM gt)"]
_TILE = "s AS scene_id, y, x"
SQL["tile_screening"] = _with("lineitem", *_SCREEN) + f"SELECT {_TILE}, frac <= 0.2 AS eligible, round(p, 6) AS p_oil, passed FROM gt"
SQL["close_grid"] = _with("lineitem", *_SCREEN) + f"SELECT {_CELL} FROM g2"
SQL["fill_holes_grid"] = _with("lineitem", *_SCREEN, *_fill("g3", "gm")) + f"SELECT {_CELL} FROM g3"
SQL["expand_pass_grid"] = _with("lineitem", *_FINAL) + "SELECT s AS scene_id, gi, gj FROM fi WHERE final"
SQL["tile_counters"] = _with("lineitem", *_FINAL) + "SELECT s AS scene_id, count(*) FILTER (passed) AS base, count(*) FILTER (final AND NOT passed) AS closing_added, count(*) FILTER (final) AS final FROM fi GROUP BY s"
SQL["screened_semi"] = _with("lineitem", *_FINAL) + f"SELECT {_TILE} FROM fi WHERE frac <= 0.2 AND final"
SQL["screened_anti"] = _with("lineitem", *_FINAL) + f"SELECT {_TILE} FROM fi WHERE frac <= 0.2 AND NOT final"
SQL["rejected_tiles"] = _with("lineitem", *_FINAL) + f"""SELECT s AS scene_id, x, y, CASE WHEN frac > 0.2 THEN {_WHY} ELSE 'oil_probability_below_threshold' END AS reason, round(frac, 6) AS invalid_pixel_fraction,
CASE WHEN frac > 0.2 THEN 0.2::DOUBLE END AS max_invalid_fraction, {_TOUCH} AS touches_scene_boundary, CASE WHEN frac <= 0.2 THEN round(p, 6) END AS oil_probability, CASE WHEN frac <= 0.2 THEN 0.21::DOUBLE END AS screener_threshold,
CASE WHEN frac <= 0.2 THEN 1 ELSE 0 END AS reason_rank FROM fi WHERE NOT final"""
SQL["rejected_coverage"] = _with("lineitem", *_FINAL, _FULL.replace("full_grid", "fg")) + f"SELECT {_CELL} FROM fg WHERE EXISTS (SELECT 1 FROM fi t WHERE NOT t.final AND {_ON.format(a='fg')})"
SQL["rejection_summary"] = _with("lineitem", *_FINAL) + """SELECT s AS scene_id, count(*) AS n_rejected, count(*) FILTER (frac > 0.2) AS invalid_tiles_excluded, count(*) FILTER (frac <= 0.2) AS tiles_screened_out, CAST(0 AS BIGINT) AS at_boundary
FROM fi WHERE NOT final GROUP BY s HAVING count(*) > 0"""


def _cleaned(p: str, mask: str, least: int) -> list[str]:
    """Opening by the disk of radius 1 (``o1``), then components of at least so many cells: ``{p}k(s, r, c)``."""
    return [_erode(f"{p}1", mask, "o1"), _dilate(f"{p}2", f"{p}1", "o1"), _components(p, f"{p}2"), _large(f"{p}k", p, "lineitem", least)]


_LEARNED = [
    *_FINAL, _NORM, _DARK, _shape("o1", 1),
    "mo AS MATERIALIZED (SELECT i.s, i.r, i.c, CAST(round(avg(CAST(CAST(1.0::DOUBLE - CAST(i.norm AS DOUBLE) AS FLOAT) AS DOUBLE)), 6) AS FLOAT) AS prob FROM mi i JOIN fi ON fi.s = i.s AND fi.y = i.y AND fi.x = i.x AND fi.final WHERE i.ok GROUP BY i.s, i.r, i.c)",
    "raw AS MATERIALIZED (SELECT s, r, c FROM mo WHERE prob >= CAST(0.6 AS FLOAT) UNION SELECT mo.s, mo.r, mo.c FROM mo JOIN m USING (s, r, c))", *_cleaned("d", "raw", 5),
]
SQL["learned_detection"] = _with("lineitem", *_LEARNED) + f"SELECT {_CELL} FROM dk"
SQL["deterministic_detection"] = _with(
    "lineitem", *_SCREEN, _shape("o1", 1),
    "raw AS MATERIALIZED (SELECT s, r, c FROM mi GROUP BY s, r, c HAVING CAST(round(avg(CASE WHEN norm < CAST(0.3 AS FLOAT) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS FLOAT) >= CAST(0.4 AS FLOAT))", *_cleaned("d", "raw", 5),
) + f"SELECT {_CELL} FROM dk"
_UNDETECTED = [
    *_LEARNED, "un AS MATERIALIZED (SELECT s, r, c FROM m WHERE NOT EXISTS (SELECT 1 FROM dk WHERE dk.r = m.r AND dk.c = m.c))", *_cleaned("u", "un", 4),
    f"ud AS MATERIALIZED (SELECT s, r, c, EXISTS (SELECT 1 FROM fi t WHERE NOT t.final AND t.frac <= 0.2 AND {_ON.format(a='uk')}) AND NOT EXISTS (SELECT 1 FROM mo WHERE mo.prob > 0 AND mo.r = uk.r AND mo.c = uk.c) AS rejected FROM uk)",
]
SQL["undetected_dark"] = _with("lineitem", *_UNDETECTED) + f"SELECT {_CELL}, rejected AS rejected_by_screener FROM ud"
SQL["undetected_attribution"] = _with("lineitem", *_UNDETECTED) + """SELECT d.s AS scene_id, round(count(ud.r) * 100.0::DOUBLE / 1e6, 6) AS total_area_km2, count(ud.r) AS total_pixels, round(count(*) FILTER (ud.rejected) * 100.0::DOUBLE / 1e6, 6) AS rejected_area_km2,
count(*) FILTER (ud.rejected) AS rejected_pixels, CASE WHEN count(ud.r) > 0 THEN round(100.0::DOUBLE * count(*) FILTER (ud.rejected) / count(ud.r), 6) ELSE 0.0::DOUBLE END AS percentage FROM dims d LEFT JOIN ud ON ud.s = d.s GROUP BY d.s"""
_IN = "EXISTS (SELECT 1 FROM {t} WHERE {t}.r = {a}.r AND {t}.c = {a}.c)"
SQL["attribution_invariants"] = _with(
    "lineitem", *_UNDETECTED, "er AS (SELECT DISTINCT uk.r, uk.c FROM uk JOIN fi t ON NOT t.final AND t.frac <= 0.2 AND " + _ON.format(a="uk") + ")", "by_tile AS (SELECT r, c FROM er ANTI JOIN (SELECT r, c FROM mo WHERE prob > 0) USING (r, c))",
) + f"""SELECT
(SELECT count(*) FROM ud JOIN dk USING (r, c)) AS overlap, (SELECT count(*) FROM uk a WHERE NOT {_IN.format(t='ud', a='a')}) AS missing, (SELECT count(*) FROM ud b WHERE NOT {_IN.format(t='uk', a='b')}) AS extra,
(SELECT count(*) FROM (SELECT r, c FROM ud GROUP BY r, c HAVING count(*) > 1)) AS repeated, (SELECT count(*) FROM ud WHERE rejected <> {_IN.format(t='by_tile', a='ud')}) AS misattributed"""  # fmt: skip

# --- components and regions
_CC = [_STATS, _NORM, _DARK, _components("a", "m")]
_REGIONS = [*_CC, _large("k", "a", "orders", 20), "rg AS MATERIALIZED (SELECT s, r, c, dense_rank() OVER (ORDER BY l) AS id FROM k)"]
SQL["connected_components"] = _with("orders", *_CC) + "SELECT 'orders' AS scene_id, id // 100000 AS row, id % 100000 AS col, dense_rank() OVER (ORDER BY l) AS region_id FROM acc"
SQL["components_four"] = _with("orders", _STATS, _NORM, _DARK, _components("a", "m", 0)) + "SELECT 'orders' AS scene_id, l // 100000 AS first_row, l % 100000 AS first_col, count(*) AS n_pixels FROM acc GROUP BY l"
SQL["remove_small"] = _with("orders", *_REGIONS) + f"SELECT {_CELL} FROM k"
_TABLE = [
    *_REGIONS,
    """rt AS MATERIALIZED (SELECT s, id, count(*) AS n, round(count(*) * 100.0::DOUBLE / 1e6, 6) AS area, round(avg(r), 6) AS cr, round(avg(c), 6) AS ccol, round(avg(1.0::DOUBLE - CAST(norm AS DOUBLE)), 6) AS p, min(r) AS r0, max(r) AS r1, min(c) AS c0, max(c) AS c1
FROM rg JOIN nm USING (s, r, c) GROUP BY s, id)""",
]
SQL["region_measurements"] = _with("orders", *_TABLE) + """SELECT s AS scene_id, id AS region_id, n AS n_pixels, area AS area_km2, cr AS centroid_row, ccol AS centroid_col, p AS mean_probability, r0 AS min_row, r1 AS max_row, c0 AS min_col, c1 AS max_col,
round(10.0::DOUBLE * (ccol + 0.5), 6) AS centroid_x, round(-10.0::DOUBLE * (cr + 0.5), 6) AS centroid_y FROM rt"""
SQL["region_shapes"] = _with("orders", *_REGIONS) + """SELECT s AS scene_id, id AS region_id, round(4 * sqrt(mid + half), 4) AS axis_major_length_px, round(4 * sqrt(greatest(mid - half, 0)), 4) AS axis_minor_length_px, round(degrees(0.5 * atan2(2 * rc, rr - cc)), 4) AS orientation_deg
FROM (SELECT *, (rr + cc) / 2 AS mid, sqrt(((rr - cc) / 2) ** 2 + rc ** 2) AS half FROM (SELECT s, id, round(var_pop(r), 9) AS rr, round(var_pop(c), 9) AS cc, round(covar_pop(r, c), 9) AS rc FROM rg GROUP BY s, id))"""
_COAST = "co AS MATERIALIZED (SELECT s_suppkey AS k, s_suppkey * 10.0::DOUBLE AS x1, s_acctbal AS y1, lead(s_suppkey * 10.0::DOUBLE) OVER (ORDER BY s_suppkey) AS x2, lead(s_acctbal) OVER (ORDER BY s_suppkey) AS y2 FROM supplier QUALIFY y2 IS NOT NULL)"


def _distance(px: str, py: str) -> str:
    t = f"greatest(0, least(1, (({px} - x1) * (x2 - x1) + ({py} - y1) * (y2 - y1)) / ((x2 - x1) ** 2 + (y2 - y1) ** 2)))"
    return f"sqrt(({px} - (x1 + {t} * (x2 - x1))) ** 2 + ({py} - (y1 + {t} * (y2 - y1))) ** 2)"


_ALERT = "CASE WHEN {a} > 5 AND {d} < 15 THEN 'Critical' WHEN {a} > 5 AND {d} < 30 THEN 'High' WHEN {a} > 1 OR {d} < 10 THEN 'Moderate' ELSE 'Low' END"
_SURE = "CASE WHEN {p} >= 0.7 THEN 'High' WHEN {p} >= 0.26 THEN 'Medium' ELSE 'Low' END"
_MEASURED = [
    *_TABLE, _COAST,
    f"ds AS MATERIALIZED (SELECT id, round(min({_distance('(10.0::DOUBLE * (ccol + 0.5))', '(-10.0::DOUBLE * (cr + 0.5))')}) / 1000, 6) AS d FROM rt CROSS JOIN co GROUP BY id)",
    f"ms AS MATERIALIZED (SELECT rt.*, d, {_ALERT.format(a='area', d='d')} AS alert, {_SURE.format(p='p')} AS sure FROM rt JOIN ds USING (id))",
]
SQL["region_alert"] = _with("orders", *_MEASURED) + "SELECT s AS scene_id, id AS region_id, d AS distance_to_coast_km, alert AS severity, sure AS confidence FROM ms"
_RANK = "CASE {x} WHEN 'Low' THEN 0 WHEN 'Moderate' THEN 1 WHEN 'Medium' THEN 1 WHEN 'High' THEN 2 ELSE 3 END"
SQL["scene_alert"] = _with("orders", *_MEASURED) + f"""SELECT d.s AS scene_id, coalesce(arg_max(alert, {_RANK.format(x='alert')}), 'Low') AS alert, coalesce(arg_max(sure, {_RANK.format(x='sure')}), 'Low') AS confidence, count(ms.id) AS n_regions
FROM dims d LEFT JOIN ms ON ms.s = d.s GROUP BY d.s"""
SQL["coast_distance"] = _with("orders", _COAST) + f"SELECT r * 128 + c AS region_id, round(min({_distance('(c * 10.0::DOUBLE + 5)', '(r * -10.0::DOUBLE - 5)')}) / 1000, 6) AS distance_km FROM fx CROSS JOIN co GROUP BY r, c"
SQL["coast_bbox_clip"] = f"""WITH {_COAST}, t AS (SELECT *, x2 - x1 AS dx, y2 - y1 AS dy FROM co), u AS (
SELECT *, greatest(0, least((15 - x1) / dx, (905 - x1) / dx), CASE WHEN dy <> 0 THEN least((-500 - y1) / dy, (6000 - y1) / dy) ELSE 0 END) AS a,
least(1, greatest((15 - x1) / dx, (905 - x1) / dx), CASE WHEN dy <> 0 THEN greatest((-500 - y1) / dy, (6000 - y1) / dy) ELSE 1 END) AS b FROM t WHERE dy <> 0 OR y1 BETWEEN -500 AND 6000)
SELECT k, round(x1 + a * dx, 6) AS x1, round(y1 + a * dy, 6) AS y1, round(x1 + b * dx, 6) AS x2, round(y1 + b * dy, 6) AS y2 FROM u WHERE a < b"""
SQL["place_labels"] = """WITH c AS (SELECT c_custkey, CAST(30 + c_custkey % 30 AS DOUBLE) AS lon, round(10 + (c_acctbal + 1000) / 500, 6) AS lat FROM customer),
l AS (SELECT *, CASE WHEN lon BETWEEN 47 AND 57 AND lat BETWEEN 22 AND 31 THEN 'Arabian Gulf' WHEN lon BETWEEN 32 AND 44 AND lat BETWEEN 12 AND 30 THEN 'Red Sea' ELSE 'Outside all named areas' END AS label FROM c)
SELECT c_custkey, label, (label = 'Arabian Gulf' AND lon BETWEEN 48 AND 55 AND lat BETWEEN 24 AND 30) OR (label = 'Red Sea' AND lon BETWEEN 37 AND 42 AND lat BETWEEN 18 AND 28) AS validated FROM l"""
_E2 = "(1 / 298.257223563::DOUBLE * (2 - 1 / 298.257223563::DOUBLE))"
SQL["row_geodesic_area"] = _with(
    "orders", "rw AS (SELECT s, unnest(range(0, h)) AS row FROM dims)", "la AS (SELECT s, row, 27.0::DOUBLE + row * -0.0001::DOUBLE AS top FROM rw)",
    f"ge AS (SELECT s, row, top, 6378137.0::DOUBLE / sqrt(1 - {_E2} * sin(radians(top - 0.00005::DOUBLE)) ** 2) AS n FROM la)",
) + f"""SELECT s AS scene_id, row, round(2 * n * asin(cos(radians(top - 0.00005::DOUBLE)) * sin(radians(0.0001::DOUBLE) / 2)) * radians(0.0001::DOUBLE)
* (m1 + 4 * m2 + m3) / 6, 5) AS area_m2 FROM (SELECT *, 6378137.0::DOUBLE * (1 - {_E2}) / (1 - {_E2} * sin(radians(top)) ** 2) ** 1.5 AS m1,
6378137.0::DOUBLE * (1 - {_E2}) / (1 - {_E2} * sin(radians(top - 0.00005::DOUBLE)) ** 2) ** 1.5 AS m2, 6378137.0::DOUBLE * (1 - {_E2}) / (1 - {_E2} * sin(radians(top - 0.0001::DOUBLE)) ** 2) ** 1.5 AS m3 FROM ge)"""  # fmt: skip
SQL["mask_area"] = _with("orders", _STATS, _NORM, _DARK) + "SELECT s AS scene_id, round(count(*) * 100.0::DOUBLE / 1e6, 6) AS area_km2, count(*) AS n_pixels FROM m GROUP BY s"

# --- sets, quality, display
_BOTH = [_STATS, _NORM, _DARK, "tr AS MATERIALIZED (SELECT 'orders' AS s, o_orderkey // 128 AS r, o_orderkey % 128 AS c FROM orders WHERE o_orderstatus = 'F')"]
SQL["mask_set_ops"] = _with("orders", *_BOTH) + """SELECT kind, r AS row, count(*) AS n, min(c) AS first_col FROM (
SELECT 'union' AS kind, r, c FROM (SELECT r, c FROM m UNION SELECT r, c FROM tr) UNION ALL SELECT 'intersect', r, c FROM (SELECT r, c FROM m INTERSECT SELECT r, c FROM tr)
UNION ALL SELECT 'missing', r, c FROM (SELECT r, c FROM tr EXCEPT SELECT r, c FROM m) UNION ALL SELECT 'extra', r, c FROM (SELECT r, c FROM m EXCEPT SELECT r, c FROM tr)) GROUP BY kind, r"""
SQL["mask_quality"] = _with("orders", *_BOTH) + """SELECT 'orders' AS scene_id, tp AS true_positive, round(tp / (p + t - tp), 6) AS iou, round(tp / p, 6) AS "precision", round(tp / t, 6) AS recall
FROM (SELECT (SELECT count(*) FROM m) AS p, (SELECT count(*) FROM tr) AS t, (SELECT count(*) FROM m JOIN tr USING (r, c)) AS tp)"""
SQL["display_uint8"] = _with("orders", _STATS, _NORM, _FULL) + "SELECT g.s AS scene_id, g.r AS row, g.c AS col, CAST(coalesce(round_even(CAST(norm AS DOUBLE) * 255, 0), 0) AS BIGINT) AS grey FROM full_grid g LEFT JOIN nm USING (s, r, c)"
SQL["blend_layer"] = _with("orders", _STATS, _NORM, "g AS (SELECT *, round_even(CAST(norm AS DOUBLE) * 255, 0) AS x, norm < CAST(0.3 AS FLOAT) AS b FROM nm)") + f"SELECT {_CELL}, " + ", ".join(
    f"CAST(CASE WHEN b THEN round_even(x * (1.0::DOUBLE - 0.42::DOUBLE) + {v} * 0.42::DOUBLE, 0) ELSE x END AS BIGINT) AS {n}" for n, v in (("red", 255), ("green", 140), ("blue", 26))
) + " FROM g"
SQL["content_id"] = "SELECT doc_id, 'upload-' || substr(sha256(text), 1, 20) AS content_id FROM documents"
SQL["lru_eviction"] = """WITH l AS (SELECT user_id AS key, max(event_id) AS last_used, arg_max(CAST(length(props) * 1000 AS BIGINT), event_id) AS bytes FROM events GROUP BY user_id),
r AS (SELECT *, row_number() OVER (ORDER BY last_used DESC, key) AS position FROM l QUALIFY position <= 8), s AS (SELECT *, CAST(sum(bytes) OVER (ORDER BY last_used DESC, key) AS BIGINT) AS running_bytes FROM r)
SELECT * FROM s WHERE running_bytes <= 250000 OR position = 1"""
SQL["region_export"] = _with("orders", *_MEASURED) + "SELECT id AS region_id, area AS area_km2, p AS mean_probability, alert AS severity, sure AS confidence, round(100 * area / max(area) OVER (), 4) AS bar_width FROM ms"
SQL["analysis_response"] = _with("orders", *_MEASURED) + f"""SELECT d.s AS scene_id, round(coalesce(sum(area), 0), 6) AS total_area_km2, count(ms.id) AS region_count, coalesce(max(area), 0.0::DOUBLE) AS largest_region_km2, min(ms.d) AS nearest_coast_km,
coalesce(arg_max(alert, {_RANK.format(x='alert')}), 'Low') AS alert_level, coalesce(arg_max(sure, {_RANK.format(x='sure')}), 'Low') AS confidence, 10.0::DOUBLE AS pixel_x, 10.0::DOUBLE AS pixel_y, any_value(w) AS width_px, any_value(h) AS height_px,
'Outside all named areas' AS region_label, FALSE AS inside_validated_bounds, 'screener 0.45, mask 0.10, opening 2, minimum 1000 px' AS status FROM dims d LEFT JOIN ms ON ms.s = d.s GROUP BY d.s"""
SQL["confidence_classes"] = f"""WITH x AS (SELECT l_quantity / 8 AS a, CASE WHEN l_linenumber % 5 > 0 THEN round(l_discount * 400, 6) ELSE 'infinity'::DOUBLE END AS d, round(l_tax * 10, 6) AS p FROM lineitem),
y AS (SELECT {_ALERT.format(a='a', d='d')} AS alert, {_SURE.format(p='p')} AS confidence FROM x)
SELECT alert, confidence, count(*) AS n, CAST(max({_RANK.format(x='alert')}) AS BIGINT) AS rank FROM y GROUP BY alert, confidence"""

# --- projections
_N = "(1 / 298.257223563::DOUBLE / (2 - 1 / 298.257223563::DOUBLE))"
SQL["projected_centres"] = f"""WITH s AS (SELECT s_suppkey, CAST(48 + s_suppkey % 7 AS DOUBLE) AS lon, 24 + s_acctbal / 2000 AS lat, s_acctbal FROM supplier),
p AS (SELECT *, radians(lat) AS p, radians(26.0::DOUBLE) AS p0, radians(lon - 51.0::DOUBLE) AS dl, 6378137.0::DOUBLE * sqrt(1 - {_E2}) / (1 - {_E2} * sin(radians(26.0::DOUBLE)) ** 2) AS radius FROM s),
c AS (SELECT *, acos(least(1.0::DOUBLE, greatest(-1.0::DOUBLE, sin(p0) * sin(p) + cos(p0) * cos(p) * cos(dl)))) AS c FROM p),
k AS (SELECT *, CASE WHEN abs(c) < 1e-12 THEN 1.0::DOUBLE ELSE c / sin(c) END AS k, {_N} AS n FROM c),
u AS (SELECT *, (2900000.0::DOUBLE + s_acctbal) / z AS xi, (s_suppkey * 10 - 200000.0::DOUBLE) / z AS eta, n / 2 - 2 * n ** 2 / 3 + 37 * n ** 3 / 96 AS b1, n ** 2 / 48 + n ** 3 / 15 AS b2, 17 * n ** 3 / 480 AS b3
  FROM (SELECT *, 0.9996::DOUBLE * 6378137.0::DOUBLE / (1 + n) * (1 + n ** 2 / 4 + n ** 4 / 64) AS z FROM k)),
v AS (SELECT *, xi - b1 * sin(2 * xi) * cosh(2 * eta) - b2 * sin(4 * xi) * cosh(4 * eta) - b3 * sin(6 * xi) * cosh(6 * eta) AS xi1,
  eta - b1 * cos(2 * xi) * sinh(2 * eta) - b2 * cos(4 * xi) * sinh(4 * eta) - b3 * cos(6 * xi) * sinh(6 * eta) AS eta1 FROM u),
w AS (SELECT *, asin(sin(xi1) / cosh(eta1)) AS chi FROM v)
SELECT s_suppkey, round(radius * k * cos(p) * sin(dl), 3) AS x_m, round(radius * k * (cos(p0) * sin(p) - sin(p0) * cos(p) * cos(dl)), 3) AS y_m, round(51.0::DOUBLE + degrees(atan2(sinh(eta1), cos(xi1))), 7) AS utm_lon,
round(degrees(chi + (2 * n - 2 * n ** 2 / 3 - 2 * n ** 3) * sin(2 * chi) + (7 * n ** 2 / 3 - 8 * n ** 3 / 5) * sin(4 * chi) + 56 * n ** 3 / 15 * sin(6 * chi)), 7) AS utm_lat,
round(s_acctbal / -10.0::DOUBLE - 0.5, 6) AS row, round(CAST(s_suppkey AS DOUBLE) - 0.5, 6) AS col FROM w"""
SQL["tile_scope_inputs"] = _with(
    "lineitem", _AXES, _MEDIAN, _FULL, _INFILL, f"tv AS MATERIALIZED (SELECT t.s, t.y, t.x, f.r, f.c, f.v FROM tiles t JOIN inf f ON {_ON.format(a='f')})",
    "tb AS (SELECT s, y, x, round(quantile_cont(v, 0.02), 6) AS lo, round(quantile_cont(v, 0.98), 6) AS hi FROM tv GROUP BY s, y, x)",
) + f"SELECT s AS scene_id, y, x, r AS row, c AS col, round(CAST({_scaled('v')} AS DOUBLE), 6) AS norm FROM tv JOIN tb USING (s, y, x)"


# --- scenes in degrees
_FL = "(1 / 298.257223563::DOUBLE)"
_CO_DEG = """cp AS (SELECT s_suppkey AS k, 48 + (s_suppkey % 50) / 10.0::DOUBLE AS x, round(24 + s_acctbal / 2000, 6) AS y FROM supplier),
co AS MATERIALIZED (SELECT a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2, b.x - a.x AS dx, b.y - a.y AS dy FROM cp a JOIN cp b ON b.k = a.k + 1)"""


def _plane(source: str, *points: tuple[str, str, str, str, str]) -> str:
    """``source`` with ``{p}x, {p}y`` for each point (p, lon, lat, lon0, lat0): metres from (lon0, lat0), by three rounds of Vincenty's
    inverse. Each step is a subquery, as aliases within one SELECT are written out again."""
    steps = [["atan((1 - {f}) * tan(radians({lat0}))) AS {p}u", "atan((1 - {f}) * tan(radians({lat}))) AS {p}v", "radians({lon} - {lon0}) AS {p}l", "radians({lon} - {lon0}) AS {p}m0"]]
    for i in range(3):
        rounds = [
            ["cos({p}v) * sin({p}m#) AS {p}e#", "cos({p}u) * sin({p}v) - sin({p}u) * cos({p}v) * cos({p}m#) AS {p}n#", "sin({p}u) * sin({p}v) + cos({p}u) * cos({p}v) * cos({p}m#) AS {p}cs#"],
            ["sqrt({p}e# * {p}e# + {p}n# * {p}n#) AS {p}ss#"],
            ["atan2({p}ss#, {p}cs#) AS {p}sg#", "CASE WHEN {p}ss# > 0 THEN cos({p}u) * {p}e# / {p}ss# ELSE 0 END AS {p}sa#"],
            ["1 - {p}sa# * {p}sa# AS {p}ca#"],
            ["CASE WHEN {p}ca# > 1e-15 THEN {p}cs# - 2 * sin({p}u) * sin({p}v) / {p}ca# ELSE 0 END AS {p}mm#", "{f} / 16 * {p}ca# * (4 + {f} * (4 - 3 * {p}ca#)) AS {p}k#"],
            ["{p}l + (1 - {p}k#) * {f} * {p}sa# * ({p}sg# + {p}k# * {p}ss# * ({p}mm# + {p}k# * {p}cs# * (2 * {p}mm# ** 2 - 1))) AS {p}m+"],
        ]
        steps += [[x.replace("#", str(i)).replace("m+", f"m{i + 1}") for x in items] for items in rounds]
    steps += [
        ["{p}ca2 * (1 / (1 - {f}) ** 2 - 1) AS {p}q"],
        ["1 + {p}q / 16384 * (4096 + {p}q * (-768 + {p}q * (320 - 175 * {p}q))) AS {p}a", "{p}q / 1024 * (256 + {p}q * (-128 + {p}q * (74 - 47 * {p}q))) AS {p}b"],
        ["{p}b * {p}ss2 * ({p}mm2 + {p}b / 4 * ({p}cs2 * (2 * {p}mm2 ** 2 - 1) - {p}b / 6 * {p}mm2 * (4 * {p}ss2 ** 2 - 3) * (4 * {p}mm2 ** 2 - 3))) AS {p}less"],
        ["CASE WHEN {p}ss2 > 0 THEN 6378137.0::DOUBLE * (1 - {f}) * {p}a * ({p}sg2 - {p}less) / {p}ss2 ELSE 0 END AS {p}ratio"],
        ["{p}ratio * {p}e2 AS {p}x", "{p}ratio * {p}n2 AS {p}y"],
    ]
    sql = source
    for items in steps:
        cols = [x.format(p=p, lon=lon, lat=lat, lon0=lon0, lat0=lat0, f=_FL) for p, lon, lat, lon0, lat0 in points for x in items]
        sql = f"(SELECT *, {', '.join(cols)} FROM {sql})"
    return sql


def _searched(boxes: str) -> str:
    """``sc(s, deg, x1, y1, x2, y2, lon0, lat0, px, py, qx, qy)``: the coast within 2, else 5 degrees of the boxes (s, w0, s0, e0, n0)."""
    enter = "greatest(0, least(({w} - x1) / dx, ({e} - x1) / dx), CASE WHEN dy <> 0 THEN least(({s} - y1) / dy, ({n} - y1) / dy) ELSE 0 END)"
    leave = "least(1, greatest(({w} - x1) / dx, ({e} - x1) / dx), CASE WHEN dy <> 0 THEN greatest(({s} - y1) / dy, ({n} - y1) / dy) ELSE 1 END)"
    edge = {"w": "(w0 - deg)", "e": "(e0 + deg)", "s": "(s0 - deg)", "n": "(n0 + deg)"}
    return f"""{_CO_DEG},
sb AS MATERIALIZED ({boxes}),
cl AS (SELECT *, {enter.format(**edge)} AS t0, {leave.format(**edge)} AS t1 FROM sb CROSS JOIN co CROSS JOIN (VALUES (2.0::DOUBLE), (5.0::DOUBLE)) v(deg) WHERE dy <> 0 OR y1 BETWEEN s0 - deg AND n0 + deg),
ct AS MATERIALIZED (SELECT s, deg, (w0 + e0) / 2 AS lon0, (s0 + n0) / 2 AS lat0, x1 + t0 * dx AS ax, y1 + t0 * dy AS ay, x1 + t1 * dx AS bx, y1 + t1 * dy AS byy FROM cl WHERE t0 < t1),
cn AS (SELECT * FROM ct QUALIFY deg = min(deg) OVER (PARTITION BY s)),
sc AS MATERIALIZED {_plane("cn", ("p_", "ax", "ay", "lon0", "lat0"), ("q_", "bx", "byy", "lon0", "lat0"))}"""


def _row_area(top: str, px: str) -> str:
    m = lambda lat: f"6378137.0::DOUBLE * (1 - {_E2}) / (1 - {_E2} * sin(radians({lat})) ** 2) ** 1.5"
    mid, n = f"({top} - {px} / 2)", f"6378137.0::DOUBLE / sqrt(1 - {_E2} * sin(radians({top} - {px} / 2)) ** 2)"
    return f"(2 * ({n}) * asin(cos(radians({mid})) * sin(radians({px}) / 2)) * radians({px}) * ({m(top)} + 4 * {m(mid)} + {m(f'({top} - {px})')}) / 6)"


_ROW = _row_area("(27.0::DOUBLE - r * 0.0005::DOUBLE)", "0.0005::DOUBLE")
SQL["geographic_area"] = _with("orders", _STATS, _NORM, _DARK) + f"SELECT s AS scene_id, round(sum({_ROW}) / 1e6, 6) AS area_km2, count(*) AS n_pixels FROM m GROUP BY s"
SQL["geographic_regions"] = _with(
    "orders", *_TABLE, _searched("SELECT s, 50.0::DOUBLE AS w0, 27.0::DOUBLE - h * 0.0005::DOUBLE AS s0, 50.0::DOUBLE + w * 0.0005::DOUBLE AS e0, 27.0::DOUBLE AS n0 FROM dims"),
    f"ar AS (SELECT s, id, round(sum({_ROW}) / 1e6, 6) AS a FROM rg GROUP BY s, id)",
    "ce AS (SELECT rt.s, id, a, 0.0005::DOUBLE * (ccol + 0.5) + 50.0::DOUBLE AS lon, -0.0005::DOUBLE * (cr + 0.5) + 27.0::DOUBLE AS lat, (w0 + e0) / 2 AS mlon, (s0 + n0) / 2 AS mlat FROM rt JOIN ar USING (s, id) JOIN sb ON sb.s = rt.s)",
    f"cx AS MATERIALIZED {_plane('ce', ('r_', 'lon', 'lat', 'mlon', 'mlat'))}",
    "dd AS (SELECT cx.id, cx.r_x AS px, cx.r_y AS py, sc.p_x AS x1, sc.p_y AS y1, sc.q_x AS x2, sc.q_y AS y2 FROM cx JOIN sc ON sc.s = cx.s)",
    f"dm AS (SELECT id, round(min({_distance('px', 'py')}) / 1000, 6) AS d FROM dd GROUP BY id)",
) + f"SELECT id AS region_id, a AS area_km2, round(lon, 8) AS centroid_lon, round(lat, 8) AS centroid_lat, d AS distance_to_coast_km, {_ALERT.format(a='a', d='d')} AS severity FROM cx LEFT JOIN dm USING (id)"
SQL["coast_search"] = "WITH " + _searched(
    "SELECT CAST(s_suppkey AS VARCHAR) AS s, CAST(30 + s_suppkey % 30 AS DOUBLE) AS w0, round(10 + (s_acctbal + 1000) / 500, 6) - 1 AS s0, CAST(31 + s_suppkey % 30 AS DOUBLE) AS e0, round(10 + (s_acctbal + 1000) / 500, 6) AS n0 FROM supplier"
) + " SELECT s AS scene_id, max(deg) AS search_deg, count(*) AS n_segments, round(sum(sqrt((q_x - p_x) ** 2 + (q_y - p_y) ** 2)) / 1000, 4) AS length_km FROM sc GROUP BY s"
SQL["scene_bounds"] = _with(
    "orders", "i AS (SELECT s, w, h, unnest(range(0, 23)) / 22.0::DOUBLE AS p FROM dims)",
    "e AS (SELECT s, p * w AS u, 0.0::DOUBLE AS v FROM i UNION ALL SELECT s, p * w, h FROM i UNION ALL SELECT s, 0, p * h FROM i UNION ALL SELECT s, w, p * h FROM i)",
    f"z AS (SELECT s, u, v, {_N} AS n, 0.9996::DOUBLE * 6378137.0::DOUBLE / (1 + n) * (1 + n ** 2 / 4 + n ** 4 / 64) AS z, (2900000.0::DOUBLE - 10 * v) / z AS xi, (10 * u - 200000.0::DOUBLE) / z AS eta FROM e)",
    "k AS (SELECT *, n / 2 - 2 * n ** 2 / 3 + 37 * n ** 3 / 96 AS b1, n ** 2 / 48 + n ** 3 / 15 AS b2, 17 * n ** 3 / 480 AS b3 FROM z)",
    """g AS (SELECT *, xi - b1 * sin(2 * xi) * cosh(2 * eta) - b2 * sin(4 * xi) * cosh(4 * eta) - b3 * sin(6 * xi) * cosh(6 * eta) AS xi1,
  eta - b1 * cos(2 * xi) * sinh(2 * eta) - b2 * cos(4 * xi) * sinh(4 * eta) - b3 * cos(6 * xi) * sinh(6 * eta) AS eta1, asin(sin(xi1) / cosh(eta1)) AS chi FROM k)""",
    """o AS (SELECT s, 51.0::DOUBLE + degrees(atan2(sinh(eta1), cos(xi1))) AS lon,
  degrees(chi + (2 * n - 2 * n ** 2 / 3 - 2 * n ** 3) * sin(2 * chi) + (7 * n ** 2 / 3 - 8 * n ** 3 / 5) * sin(4 * chi) + 56 * n ** 3 / 15 * sin(6 * chi)) AS lat FROM g)""",
) + "SELECT s AS scene_id, round(min(lon), 8) AS west, round(min(lat), 8) AS south, round(max(lon), 8) AS east, round(max(lat), 8) AS north FROM o GROUP BY s"

# --- outlines: squares of four cells by cases, rings by walking
_EDGE = "CASE {e} WHEN 'T' THEN [2 * i, 2 * j + 1] WHEN 'R' THEN [2 * i + 1, 2 * j + 2] WHEN 'B' THEN [2 * i + 2, 2 * j + 1] ELSE [2 * i + 1, 2 * j] END"
_OUTLINE = [
    _STATS, _NORM, _DARK,
    "sq AS (SELECT s, r - dr AS i, c - dc AS j, sum(bit) AS code FROM m CROSS JOIN (VALUES (0, 0, 1), (0, 1, 2), (1, 1, 4), (1, 0, 8)) AS k(dr, dc, bit) GROUP BY s, r - dr, c - dc)",
    """cs(code, f, t) AS (VALUES (1, 'T', 'L'), (2, 'R', 'T'), (4, 'B', 'R'), (8, 'L', 'B'), (3, 'R', 'L'), (6, 'B', 'T'), (12, 'L', 'R'), (9, 'T', 'B'), (7, 'B', 'L'), (14, 'L', 'T'), (13, 'T', 'R'), (11, 'R', 'B'),
  (5, 'T', 'L'), (5, 'B', 'R'), (10, 'R', 'T'), (10, 'L', 'B'))""",
    f"nx AS MATERIALIZED (SELECT s, {_EDGE.format(e='f')} AS p, {_EDGE.format(e='t')} AS q FROM sq JOIN cs USING (code))",
    "wk AS (SELECT s, p AS p0, q AS p, 1 AS n FROM nx UNION ALL SELECT w.s, w.p0, nx.q, w.n + 1 FROM wk w JOIN nx ON nx.s = w.s AND nx.p = w.p WHERE w.p > w.p0)",
    "rn AS (SELECT s, p0, n AS len FROM wk WHERE p = p0)",
    "pt AS MATERIALIZED (SELECT s, p0[1] / 2.0::DOUBLE AS ring_row, p0[2] / 2.0::DOUBLE AS ring_col, CAST(n % len AS BIGINT) AS pos, p[1] / 2.0::DOUBLE AS y, p[2] / 2.0::DOUBLE AS x, len FROM wk JOIN rn USING (s, p0))",
]
SQL["contours"] = _with("orders", *_OUTLINE) + "SELECT s AS scene_id, ring_row, ring_col, pos AS position, y AS row, x AS col FROM pt"
SQL["visible_contours"] = _with(
    "orders", *_OUTLINE, "tr AS MATERIALIZED (SELECT DISTINCT o_orderkey // 128 AS r, o_orderkey % 128 AS c FROM orders WHERE o_orderstatus = 'F')",
    "nr AS (SELECT pt.*, least(greatest(CAST(round_even(y, 0) AS BIGINT), 0), h - 1) AS r, least(greatest(CAST(round_even(x, 0) AS BIGINT), 0), w - 1) AS c FROM pt JOIN dims USING (s))",
    "hd AS (SELECT nr.*, CAST(tr.r IS NOT NULL AS INT) AS hidden FROM nr LEFT JOIN tr ON tr.r = nr.r AND tr.c = nr.c)",
    "ct AS (SELECT *, sum(hidden) OVER (PARTITION BY s, ring_row, ring_col ORDER BY pos) AS gone, sum(hidden) OVER (PARTITION BY s, ring_row, ring_col) AS all_gone FROM hd)",
    "ps AS (SELECT *, CASE WHEN all_gone > 0 AND gone = all_gone THEN 0 ELSE gone END AS part, CASE WHEN all_gone > 0 AND gone = all_gone THEN pos - len ELSE pos END AS place FROM ct WHERE hidden = 0)",
) + """SELECT s AS scene_id, ring_row, ring_col, CAST(part AS BIGINT) AS part, CAST(place AS BIGINT) AS position, y AS row, x AS col FROM ps
QUALIFY count(*) OVER (PARTITION BY s, ring_row, ring_col, part) > 1"""  # fmt: skip

# --- files
_CENTRE = "(west + east) / 2 BETWEEN {} AND {} AND (south + north) / 2 BETWEEN {} AND {}"
SQL["scene_catalog"] = _with(
    "events", "b AS (SELECT s, h, w, round(6.0::DOUBLE * length(s), 6) AS west, round(22.0::DOUBLE + length(s) - 0.001::DOUBLE * h, 6) AS south, round(6.0::DOUBLE * length(s) + 0.01::DOUBLE * w, 6) AS east, 22.0::DOUBLE + length(s) AS north FROM dims)",
    f"l AS (SELECT *, CASE WHEN {_CENTRE.format(47, 57, 22, 31)} THEN 'Arabian Gulf' WHEN {_CENTRE.format(32, 44, 12, 30)} THEN 'Red Sea' ELSE 'Outside all named areas' END AS region_label FROM b)",
) + f"""SELECT s AS scene_id, CASE WHEN length(s) % 2 = 0 THEN 'Scene ' || s ELSE replace(s, '_', ' ') END AS title, h AS height, w AS width, 'EPSG:4326' AS crs, west, south, east, north, region_label,
(region_label = 'Arabian Gulf' AND {_CENTRE.format(48, 55, 24, 30)}) OR (region_label = 'Red Sea' AND {_CENTRE.format(37, 42, 18, 28)}) AS inside_validated_bounds FROM l"""  # fmt: skip
SQL["geotiff_pixels"] = _with("events") + f"SELECT {_CELL}, round(CAST(CAST(v AS FLOAT) AS DOUBLE), 4) AS value FROM fx"

# --- dark categories, layers, intervals, the stored coast
SQL["dark_categories"] = _with("lineitem", *_UNDETECTED, "rj AS MATERIALIZED (SELECT s, r, c FROM ud WHERE rejected)", _components("ta", "uk"), _components("rb", "rj")) + """, n AS (SELECT (SELECT count(*) FROM uk) AS a, (SELECT count(*) FROM rj) AS b)
SELECT 'lineitem' AS scene_id, 'total' AS category, round(a * 100.0::DOUBLE / 1e6, 6) AS area_km2, a AS n_pixels, CASE WHEN a > 0 THEN 100.0::DOUBLE ELSE 0.0::DOUBLE END AS percentage, (SELECT count(DISTINCT l) FROM tacc) AS region_count FROM n
UNION ALL SELECT 'lineitem', 'rejected_by_screener', round(b * 100.0::DOUBLE / 1e6, 6), b, CASE WHEN a > 0 THEN round(100.0::DOUBLE * b / a, 6) ELSE 0.0::DOUBLE END, (SELECT count(DISTINCT l) FROM rbcc) FROM n"""
_PAINT = "CASE WHEN {on} THEN round_even({v} * (1.0::DOUBLE - {a}::DOUBLE) + {c} * {a}::DOUBLE, 0) ELSE {v} END"
SQL["footprint_layer"] = _with(
    "lineitem", *_LEARNED, "px AS (SELECT f.s, f.r, f.c, coalesce(round_even(CAST(nm.norm AS DOUBLE) * 255, 0), 0.0::DOUBLE) AS grey, mo.prob > 0 AND mo.prob IS NOT NULL AS foot, "
    f"EXISTS (SELECT 1 FROM fi t WHERE NOT t.final AND {_ON.format(a='f')}) AS gone FROM full_grid f LEFT JOIN nm ON nm.r = f.r AND nm.c = f.c LEFT JOIN mo ON mo.r = f.r AND mo.c = f.c)",
) + f"SELECT {_CELL}, " + ", ".join(
    f"CAST({_PAINT.format(on='foot', v='(' + _PAINT.format(on='gone', v='grey', a='0.24', c=low) + ')', a='0.3', c=high)} AS BIGINT) AS {n}" for n, low, high in (("red", 229, 39), ("green", 196, 182), ("blue", 83, 165))
) + " FROM px"
_UNITS = "un AS (SELECT coalesce(m.r, tr.r) AS r, count(*) FILTER (m.r IS NOT NULL AND tr.r IS NOT NULL) AS tp, count(*) FILTER (tr.r IS NULL) AS fp, count(*) FILTER (m.r IS NULL) AS fn FROM m FULL JOIN tr ON tr.r = m.r AND tr.c = m.c GROUP BY coalesce(m.r, tr.r))"
_AT_MOST = (0.3678794, 0.7357589, 0.9196986, 0.9810118, 0.9963402, 0.9994058, 0.9999168, 0.9999898)
SQL["quality_intervals"] = _with(
    "orders", *_BOTH, _UNITS,
    "h0 AS (SELECT un.*, rep, (CAST(un.r AS BIGINT) % 2147483647 * 48271 + rep * 69621 + 42) % 2147483647 AS h FROM un, range(1, 201) AS g(rep))", "h1 AS (SELECT * REPLACE ((h * h + 12345 + rep) % 2147483647 AS h) FROM h0)",
    "h2 AS (SELECT * REPLACE ((h * h + 678901 + rep) % 2147483647 AS h) FROM h1)",
    "wt AS (SELECT *, CASE " + " ".join(f"WHEN h / 2147483647.0::DOUBLE < {p}::DOUBLE THEN {k}" for k, p in enumerate(_AT_MOST)) + " ELSE 8 END AS w FROM h2)",
    "rs AS (SELECT sum(w * tp) AS tp, sum(w * fp) AS fp, sum(w * fn) AS fn FROM wt GROUP BY rep)", "al AS (SELECT sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM un)",
    "ms(measure) AS (VALUES ('iou'), ('precision'), ('recall'))",
    "vl AS (SELECT measure, w, CAST(tp AS DOUBLE) / nullif(CASE measure WHEN 'iou' THEN tp + fp + fn WHEN 'precision' THEN tp + fp ELSE tp + fn END, 0) AS v FROM (SELECT *, 1 AS w FROM rs UNION ALL SELECT *, 0 FROM al) CROSS JOIN ms)",
) + "SELECT measure, round(max(v) FILTER (w = 0), 6) AS value, round(quantile_cont(v, 0.025) FILTER (w = 1), 6) AS low, round(quantile_cont(v, 0.975) FILTER (w = 1), 6) AS high FROM vl GROUP BY measure"
SQL["quality_ranks"] = _with(
    "orders", *_BOTH, _UNITS, "v AS (SELECT tp + fp AS x, tp AS y FROM un)", "rk AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0::DOUBLE AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0::DOUBLE AS ry FROM v)",
) + "SELECT count(*) AS n, round(corr(rx, ry), 6) AS rank_correlation FROM rk"
SQL["coast_box_scan"] = """WITH p AS (SELECT s_suppkey AS k, 48 + (s_suppkey % 50) / 10.0::DOUBLE AS x, round(24 + s_acctbal / 2000, 6) AS y FROM supplier), g AS (SELECT a.k, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM p a JOIN p b ON b.k = a.k + 1)
SELECT k, round(x1, 6) AS x1, round(y1, 6) AS y1, round(x2, 6) AS x2, round(y2, 6) AS y2 FROM g WHERE greatest(x1, x2) >= 49 AND least(x1, x2) <= 50.5 AND greatest(y1, y2) >= 24 AND least(y1, y2) <= 27"""
