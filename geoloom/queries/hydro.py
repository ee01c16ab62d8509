"""Queries of flow and stream networks."""

from __future__ import annotations

from pyspark.sql import functions as F

from geoloom.functions.grids import AROUND
from geoloom.operators import hydro as op
from geoloom.operators import streams as st
from geoloom.queries.base import local, neighbours_sql, raster, register, tidy, tidy_sql, with_inputs
from geoloom.queries.terrain import _near, AT, DIST

RC = '"row", "col"'
_ID = "(CAST({r} AS BIGINT) * 4294967296 + {c})"

_drops = ", ".join(f"{{'s': -(z - n[{i}]) / {d!r}, 'i': {j}}}" for j, (i, d) in enumerate(zip(AT, DIST, strict=True)))
D8 = f"coalesce(power(2.0, list_min(list_filter([{_drops}], lambda x: x.s < 0)).i), 0.0)"
_near("d8_pointer", op.d8_pointer, D8, kind="hydro", digits=0)
_near("d8_pointer_gappy", op.d8_pointer, D8, source="dem_gappy", kind="hydro", digits=0)
_near("fd8_pointer", op.fd8_pointer, " + ".join(f"CASE WHEN n[{i}] < z THEN {float(1 << j)} ELSE 0.0 END" for j, i in enumerate(AT)), kind="hydro", digits=0)


def _facet(i: int, e1: int, e2: int, a: int, s: int) -> str:
    z1, z2 = f"n[{e1 + 1}]", f"n[{e2 + 1}]"
    r = f"atan2({z1} - {z2}, z - {z1})"
    angle = f"CASE WHEN {r} < 0 THEN 0.0 WHEN {r} > pi() / 4 THEN pi() / 4 ELSE {r} END"
    drop = f"CASE WHEN z = {z1} AND {z1} = {z2} THEN 0.0 WHEN {r} < 0 THEN z - {z1} WHEN {r} > pi() / 4 THEN (z - {z2}) / sqrt(2.0) ELSE sqrt(power(z - {z1}, 2) + power({z1} - {z2}, 2)) END"
    return f"CASE WHEN {z1} IS NOT NULL AND {z2} IS NOT NULL THEN {{'s': -({drop}), 'i': {i}, 'angle': {s} * ({angle}) + {a} * pi() / 2}} END"


_FACETS = ", ".join(_facet(i, *f) for i, f in enumerate(op.FACETS))
_near("dinf_pointer", op.dinf_pointer, f"coalesce((450 - degrees(list_min(list_filter([{_FACETS}], lambda f: f.s < 0)).angle)) % 360, -1.0)", kind="hydro")

_DR = "[" + ", ".join(str(a[0]) for a in AROUND) + "]"
_DC = "[" + ", ".join(str(a[1]) for a in AROUND) + "]"
#: f: the forest of the D8 pointer; path: every cell with each cell its flow passes, itself first.
FOREST = (
    neighbours_sql("dem", 1)
    + f""", ptr AS (SELECT {RC}, z, CAST(log2(nullif({D8}, 0)) AS INT) AS k FROM nb WHERE z IS NOT NULL),
    f0 AS (SELECT {RC}, z, {_ID.format(r='"row"', c='"col"')} AS id, {_ID.format(r=f'("row" + {_DR}[k + 1])', c=f'("col" + {_DC}[k + 1])')} AS nx, CASE WHEN k % 2 = 0 THEN sqrt(2.0) ELSE 1.0 END AS step FROM ptr),
    f AS (SELECT a.*, b.id AS next FROM f0 a LEFT JOIN f0 b ON b.id = a.nx),
    path AS (SELECT id, id AS cur, CAST(0 AS DOUBLE) AS len, 0 AS depth FROM f UNION ALL SELECT p.id, f.next, p.len + f.step, p.depth + 1 FROM path p JOIN f ON f.id = p.cur WHERE f.next IS NOT NULL)"""
)


def _flow(name: str, fn, sql: str, *values: str, kind: str = "hydro", more: str = "") -> None:
    register(f"{kind}_{name}", lambda s, d: tidy(fn(s, d), *values), with_inputs(tidy_sql(sql, *values), "dem", "zones", more=FOREST + more))


def _dem(s, d):
    return raster(s, d, "dem")


def _ptr(s, d):
    return op.d8_pointer(_dem(s, d))


def _marks(s, d):
    """Pour points: some cells, by zone."""
    return raster(s, d, "zones").select("row", "col", F.when((F.col("row") % 7 == 3) & (F.col("col") % 5 == 2), F.col("z") + 1).alias("z"))


_MARKS = f", marks AS (SELECT {_ID.format(r='\"row\"', c='\"col\"')} AS id, z + 1 AS mark FROM zones WHERE \"row\" % 7 = 3 AND \"col\" % 5 = 2), first_mark AS (SELECT p.id, arg_min(m.mark, p.depth) AS mark, arg_min(p.len, p.depth) AS len, arg_min(p.cur, p.depth) AS at FROM path p JOIN marks m ON m.id = p.cur GROUP BY 1)"
_BY = 'f."row", f."col"'
_flow("d8_flow_accumulation", lambda s, d: op.d8_flow_accumulation(_ptr(s, d)), f"SELECT {_BY}, CAST(count(*) AS DOUBLE) AS z FROM path p JOIN f ON f.id = p.cur GROUP BY 1, 2")
_flow("num_inflowing_neighbours", lambda s, d: op.num_inflowing_neighbours(_dem(s, d)), f"SELECT {_BY}, CAST(count(g.id) AS DOUBLE) AS z FROM f LEFT JOIN f g ON g.next = f.id GROUP BY 1, 2")
_ENDS = ", ends AS (SELECT id, arg_max(cur, depth) AS last, max(len) AS len FROM path GROUP BY 1)"
_flow("basins", lambda s, d: op.basins(_ptr(s, d)), f"SELECT {_BY}, CAST(dense_rank() OVER (ORDER BY last) AS DOUBLE) AS z FROM ends JOIN f USING (id)", more=_ENDS)
_flow("downslope_flowpath_length", lambda s, d: op.downslope_flowpath_length(_ptr(s, d)), f"SELECT {_BY}, len AS z FROM ends JOIN f USING (id)", more=_ENDS)
_flow("elev_above_pit", lambda s, d: op.elev_above_pit(_dem(s, d)), f"SELECT {_BY}, f.z - g.z AS z FROM ends JOIN f USING (id) JOIN f g ON g.id = last", more=_ENDS, kind="terrain")
_flow(
    "flow_length_diff",
    lambda s, d: op.flow_length_diff(_ptr(s, d)),
    'SELECT a."row", a."col", max(abs(b.len - a.len)) AS z FROM (SELECT f."row", f."col", len FROM ends JOIN f USING (id)) a JOIN (SELECT f."row", f."col", len FROM ends JOIN f USING (id)) b ON abs(a."row" - b."row") <= 1 AND abs(a."col" - b."col") <= 1 GROUP BY 1, 2',
    more=_ENDS,
)
_flow("max_upslope_flowpath_length", lambda s, d: op.max_upslope_flowpath_length(_dem(s, d)), f"SELECT {_BY}, q.len AS z FROM (SELECT cur, max(len) AS len FROM path GROUP BY 1) q JOIN f ON f.id = q.cur")
_flow("max_upslope_value", lambda s, d: op.max_upslope_value(_dem(s, d), raster(s, d, "zones")), f"SELECT {_BY}, max(v.z) AS z FROM path p JOIN f ON f.id = p.cur JOIN (SELECT {_ID.format(r='\"row\"', c='\"col\"')} AS id, z FROM zones) v ON v.id = p.id GROUP BY 1, 2", kind="plugin")
_flow("watershed", lambda s, d: op.watershed(_ptr(s, d), _marks(s, d)), f"SELECT {_BY}, mark AS z FROM first_mark JOIN f USING (id)", more=_MARKS)
_flow("downslope_distance_to_stream", lambda s, d: op.downslope_distance_to_stream(_ptr(s, d), _marks(s, d)), f"SELECT {_BY}, len AS z FROM first_mark JOIN f USING (id)", more=_MARKS)
_flow("elevation_above_stream", lambda s, d: op.elevation_above_stream(_dem(s, d), _marks(s, d)), f"SELECT {_BY}, f.z - g.z AS z FROM first_mark JOIN f USING (id) JOIN f g ON g.id = first_mark.at", more=_MARKS)
_flow("trace_downslope_flowpaths", lambda s, d: op.trace_downslope_flowpaths(_ptr(s, d), _marks(s, d)), f"SELECT {_BY}, CAST(count(*) AS DOUBLE) AS z FROM path p JOIN marks m ON m.id = p.id JOIN f ON f.id = p.cur GROUP BY 1, 2", more=_MARKS)


def _pour(s):
    return s.range(0, 50, 6).selectExpr("id AS fid", "CAST(id AS INT) AS row", "CAST((id * 3) % 50 AS INT) AS col")


_POUR = "SELECT i AS fid, i AS r, (i * 3) % 50 AS c FROM range(0, 50, 6) x(i)"
_ACC = f"SELECT {_BY}, CAST(count(*) AS DOUBLE) AS z FROM path p JOIN f ON f.id = p.cur GROUP BY 1, 2"
register(
    "hydro_snap_pour_points",
    lambda s, d: op.snap_pour_points(_pour(s), op.d8_flow_accumulation(_ptr(s, d)), 2),
    with_inputs(f'SELECT fid, CAST(arg_min("row", k) AS INT) AS "row", CAST(arg_min("col", k) AS INT) AS "col" FROM (SELECT *, {{\'a\': -z, \'d\': power("row" - r, 2) + power("col" - c, 2), \'r\': "row", \'c\': "col"}} AS k FROM ({_POUR}) p JOIN ({_ACC}) a ON abs("row" - r) <= 2 AND abs("col" - c) <= 2) q GROUP BY fid', "dem", more=FOREST),
)
register(
    "hydro_jenson_snap_pour_points",
    lambda s, d: op.jenson_snap_pour_points(_pour(s), _dem(s, d).select("row", "col", F.when(F.col("z") > 102000, 1.0).alias("z")), 3),
    with_inputs(f'SELECT p.fid, CAST(coalesce(q."row", p.r) AS INT) AS "row", CAST(coalesce(q."col", p.c) AS INT) AS "col" FROM ({_POUR}) p LEFT JOIN (SELECT fid, arg_min("row", k) AS "row", arg_min("col", k) AS "col" FROM (SELECT *, {{\'d\': power("row" - r, 2) + power("col" - c, 2), \'r\': "row", \'c\': "col"}} AS k FROM ({_POUR}) p JOIN (SELECT * FROM dem WHERE z > 102000) a ON abs("row" - r) <= 3 AND abs("col" - c) <= 3) x GROUP BY fid) q ON q.fid = p.fid', "dem"),
)

# stream networks: cells that three or more drain through

LIMIT = 3


def _streams(s, d):
    return op.d8_flow_accumulation(_ptr(s, d)).select("row", "col", F.when(F.col("z") >= LIMIT, 1.0).alias("z"))


NETWORK = f""", acc AS (SELECT cur AS id, count(*) AS n FROM path GROUP BY 1),
    sc AS (SELECT f.* EXCLUDE (next), CASE WHEN b.n >= {LIMIT} THEN f.next END AS next FROM f JOIN acc a USING (id) LEFT JOIN acc b ON b.id = f.next WHERE a.n >= {LIMIT}),
    sp AS (SELECT id, id AS cur, CAST(0 AS DOUBLE) AS len, 0 AS depth FROM sc UNION ALL SELECT p.id, c.next, p.len + c.step, p.depth + 1 FROM sp p JOIN sc c ON c.id = p.cur WHERE c.next IS NOT NULL),
    far AS (SELECT cur AS id, max(len) AS far FROM sp GROUP BY 1),
    nin AS (SELECT next AS id, count(*) AS n_in, arg_min(sc.id, {{'a': -(far + step), 'b': sc.id}}) AS best FROM sc JOIN far USING (id) WHERE next IS NOT NULL GROUP BY 1),
    net AS (SELECT sc.*, far, coalesce(nin.n_in, 0) AS n_in, EXISTS (SELECT 1 FROM nin m WHERE m.best = sc.id) AS main FROM sc JOIN far USING (id) LEFT JOIN nin USING (id)),
    lk AS (SELECT id, id AS link FROM net WHERE n_in <> 1 UNION ALL SELECT c.id, lk.link FROM lk JOIN net u ON u.id = lk.id JOIN net c ON c.id = u.next WHERE c.n_in = 1),
    stem AS (SELECT id, id AS last FROM net WHERE NOT main UNION ALL SELECT u.id, s.last FROM stem s JOIN net u ON u.next = s.id WHERE u.main),
    ends AS (SELECT id, max(len) AS len FROM sp GROUP BY 1)"""


def _net(name: str, fn, sql: str, *values: str) -> None:
    register(f"stream_{name}", lambda s, d: tidy(fn(_ptr(s, d), _streams(s, d), _dem(s, d)), *values), None if not sql else with_inputs(tidy_sql(sql, *values), "dem", more=FOREST + NETWORK))


_net("junction_identifier", lambda p, t, z: st.stream_junctions(p, t), f"SELECT {RC}, CAST(n_in AS DOUBLE) AS z FROM net")
_net("distance_to_outlet", lambda p, t, z: st.distance_to_outlet(p, t), f"SELECT {RC}, len AS z FROM ends JOIN net USING (id)")
_net("farthest_channel_head", lambda p, t, z: st.farthest_channel_head(p, t), f"SELECT {RC}, far AS z FROM net")
_net("length_of_upstream_channels", lambda p, t, z: st.length_of_upstream_channels(p, t), 'SELECT n."row", n."col", sum(CASE WHEN u.id <> n.id THEN u.step ELSE 0 END) AS z FROM sp JOIN net n ON n.id = sp.cur JOIN net u ON u.id = sp.id GROUP BY 1, 2')
_net("shreve_magnitude", lambda p, t, z: st.shreve_magnitude(p, t), 'SELECT n."row", n."col", CAST(count(*) FILTER (u.n_in = 0) AS DOUBLE) AS z FROM sp JOIN net n ON n.id = sp.cur JOIN net u ON u.id = sp.id GROUP BY 1, 2')
_net("link_identifier", lambda p, t, z: st.stream_link_identifier(p, t), f"SELECT {RC}, CAST(dense_rank() OVER (ORDER BY link) AS DOUBLE) AS z FROM lk JOIN net USING (id)")
_net("link_class", lambda p, t, z: st.stream_link_class(p, t), 'SELECT n."row", n."col", CAST(CASE WHEN n.next IS NULL THEN 5 WHEN n.n_in = 0 THEN 3 WHEN n.n_in > 1 THEN 4 WHEN h.n_in = 0 THEN 1 ELSE 2 END AS DOUBLE) AS z FROM lk JOIN net n USING (id) JOIN net h ON h.id = lk.link')
_net("link_length", lambda p, t, z: st.stream_link_length(p, t), f"SELECT {RC}, sum(CASE WHEN next IS NULL THEN 0 ELSE step END) OVER (PARTITION BY link) AS z FROM lk JOIN net USING (id)")
_net("link_slope", lambda p, t, z: st.stream_link_slope(p, t, z), f"SELECT {RC}, coalesce((max(z) OVER g - min(z) OVER g) / nullif(sum(CASE WHEN next IS NULL THEN 0 ELSE step END) OVER g, 0) * 100, 0) AS z FROM lk JOIN net USING (id) WINDOW g AS (PARTITION BY link)")
_net("slope_continuous", lambda p, t, z: st.stream_slope_continuous(p, t, z), 'SELECT n."row", n."col", coalesce((n.z - m.z) / n.step * 100, 0) AS z FROM net n LEFT JOIN net m ON m.id = n.next')
_net("hack_order", lambda p, t, z: st.hack_order(p, t), 'SELECT n."row", n."col", CAST(1 + count(*) FILTER (c.next IS NOT NULL AND NOT c.main) AS DOUBLE) AS z FROM sp JOIN net n ON n.id = sp.id JOIN net c ON c.id = sp.cur GROUP BY 1, 2')
_net("find_main_stem", lambda p, t, z: st.main_stem(p, t), 'SELECT n."row", n."col", CASE WHEN count(*) FILTER (c.next IS NOT NULL AND NOT c.main) = 0 THEN 1.0 END AS z FROM sp JOIN net n ON n.id = sp.id JOIN net c ON c.id = sp.cur GROUP BY 1, 2')
_net("tributary_identifier", lambda p, t, z: st.tributary_identifier(p, t), f"SELECT {RC}, CAST(dense_rank() OVER (ORDER BY last) AS DOUBLE) AS z FROM stem JOIN net USING (id)")
_net("topological_order", lambda p, t, z: st.topological_order(p, t), 'SELECT n."row", n."col", CAST(1 + count(*) FILTER (m.n_in > 1) AS DOUBLE) AS z FROM sp JOIN net n ON n.id = sp.id JOIN net c ON c.id = sp.cur LEFT JOIN net m ON m.id = c.next GROUP BY 1, 2')
_net("remove_short_streams", lambda p, t, z: st.remove_short_streams(p, t, 1.2), f"SELECT {RC}, 1.0 AS z FROM (SELECT net.*, h.n_in AS at_head, sum(CASE WHEN net.next IS NULL THEN 0 ELSE net.step END) OVER g AS length, max(CASE WHEN net.next IS NULL THEN 1 ELSE 0 END) OVER g AS ending FROM lk JOIN net USING (id) JOIN net h ON h.id = lk.link WINDOW g AS (PARTITION BY link)) q WHERE NOT (at_head = 0 AND length < 1.2 AND ending = 0)")
#: Strahler order by its other definition: k is reached where two branches of order k - 1 meet.
_LEVELS = ", s1 AS (SELECT id, 1 AS o FROM net)"
for _k in range(2, 6):
    _LEVELS += f", m{_k} AS (SELECT b.cur AS id FROM (SELECT c.next AS cur, c.id FROM net c JOIN s{_k - 1} USING (id) WHERE c.next IS NOT NULL) b GROUP BY 1 HAVING count(*) > 1), s{_k} AS (SELECT DISTINCT sp.cur AS id, {_k} AS o FROM sp JOIN m{_k} ON m{_k}.id = sp.id)"
_STRAHLER = _LEVELS + ", so AS (SELECT id, max(o) AS o FROM (" + " UNION ALL ".join(f"SELECT * FROM s{k}" for k in range(1, 6)) + ") u GROUP BY 1)"
for _name, _fn, _sql in (
    ("strahler_order", lambda p, t, z: st.strahler_order(p, t), f"SELECT {RC}, CAST(o AS DOUBLE) AS z FROM so JOIN net USING (id)"),
    ("horton_order", lambda p, t, z: st.horton_order(p, t), f"SELECT {RC}, CAST(o AS DOUBLE) AS z FROM stem JOIN net USING (id) JOIN so ON so.id = stem.last"),
):
    register(f"stream_{_name}", lambda s, d, f=_fn: tidy(f(_ptr(s, d), _streams(s, d), _dem(s, d))), with_inputs(tidy_sql(_sql), "dem", more=FOREST + NETWORK + _STRAHLER))
_SUB = ", sub AS (SELECT p.id, arg_min(n.id, p.depth) AS at FROM path p JOIN net n ON n.id = p.cur GROUP BY 1)"
register("hydro_subbasins", lambda s, d: tidy(st.hillslopes_to_links(_ptr(s, d), _streams(s, d))), with_inputs(tidy_sql(f'SELECT {_BY}, r.k AS z FROM sub JOIN f USING (id) JOIN (SELECT id, CAST(dense_rank() OVER (ORDER BY link) AS DOUBLE) AS k FROM lk) r ON r.id = sub.at'), "dem", more=FOREST + NETWORK + _SUB))
register("hydro_strahler_order_basins", lambda s, d: tidy(st.strahler_order_basins(_ptr(s, d), _streams(s, d))), with_inputs(tidy_sql(f'SELECT {_BY}, CAST(so.o AS DOUBLE) AS z FROM sub JOIN f USING (id) JOIN so ON so.id = sub.at'), "dem", more=FOREST + NETWORK + _STRAHLER + _SUB))
register("stream_long_profile", lambda s, d: tidy(st.long_profile(_ptr(s, d), _streams(s, d), _dem(s, d)), "distance", "elevation"), with_inputs(tidy_sql(f"SELECT {RC}, len AS distance, z AS elevation FROM ends JOIN net USING (id)", "distance", "elevation"), "dem", more=FOREST + NETWORK))

# several receivers and floods: beyond plain SQL
local("hydro_fd8_flow_accumulation", "dem", op.fd8_flow_accumulation, None)
local("plugin_quinn_flow_accumulation", "dem", op.quinn_flow_accumulation, None)
local("plugin_qin_flow_accumulation", "dem", op.qin_flow_accumulation, None)
local("hydro_dinf_flow_accumulation", "dem", op.dinf_flow_accumulation, None)
local("hydro_rho8_pointer", "dem", op.rho8_pointer, None)
local("plugin_rho8_flow_accumulation", "dem", op.rho8_flow_accumulation, None)
local("hydro_fill_depressions", "dem", op.fill_depressions, None)
local("hydro_depth_in_sink", "dem", op.depth_in_sink, None)
local("hydro_sink", "dem", op.sink, None)
register("hydro_d8_mass_flux", lambda s, d: tidy(op.d8_mass_flux(_ptr(s, d), raster(s, d, "dem2"), raster(s, d, "unit"), raster(s, d, "flags"))), None)

_CELLS = f"cells AS (SELECT {_ID.format(r='\"row\"', c='\"col\"')} AS id, {RC}, z FROM zones)"
_CC = _CELLS + ', link AS (SELECT a.id, b.id AS near FROM cells a JOIN cells b ON abs(a."row" - b."row") <= 1 AND abs(a."col" - b."col") <= 1 AND a.z = b.z), reach AS (SELECT id, near FROM link UNION SELECT r.id, l.near FROM reach r JOIN link l ON l.id = r.near)'
register("gis_clump", lambda s, d: tidy(op.clump(raster(s, d, "zones"))), with_inputs(tidy_sql(f"SELECT {RC}, CAST(dense_rank() OVER (ORDER BY root) AS DOUBLE) AS z FROM (SELECT id, min(near) AS root FROM reach GROUP BY 1) q JOIN cells USING (id)"), "zones", more=_CC))
