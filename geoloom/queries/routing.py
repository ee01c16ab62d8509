"""Queries of flow paths, basins, breaching and edits of a DEM."""

from __future__ import annotations

from pyspark.sql import functions as F

from geoloom.operators import breach, hydro, routing
from geoloom.operators import streams as st
from geoloom.queries.base import local, local2, neighbours_sql, raster, register, tidy, tidy_sql, window_sql, with_inputs
from geoloom.queries.hydro import _BY, _ENDS, _MARKS, _flow, _marks, _ptr, _streams, FOREST, LIMIT, NETWORK
from geoloom.queries.stats import _r, rounded

RC = '"row", "col"'


def _dem(s, d):
    return raster(s, d, "dem")


_HEADS = ", head AS (SELECT id, z FROM f WHERE id NOT IN (SELECT next FROM f WHERE next IS NOT NULL))"
_flow("average_upslope_flowpath_length", lambda s, d: routing.average_upslope_flowpath_length(_dem(s, d)), f"SELECT {_BY}, avg(p.len) AS z FROM path p JOIN head h USING (id) JOIN f ON f.id = p.cur GROUP BY 1, 2", more=_HEADS)
_flow("average_flowpath_slope", lambda s, d: routing.average_flowpath_slope(_dem(s, d)), f"SELECT {_BY}, CASE WHEN sum(p.len) > 0 THEN degrees(atan(sum(h.z - f.z) / sum(p.len))) ELSE 0 END AS z FROM path p JOIN head h USING (id) JOIN f ON f.id = p.cur GROUP BY 1, 2", more=_HEADS)
register(
    "hydro_longest_flowpath",
    lambda s, d: rounded(routing.longest_flowpath(_dem(s, d), hydro.basins(_ptr(s, d)))),
    with_inputs(f'SELECT CAST(n AS DOUBLE) AS basin, f."row", f."col", CAST(p.depth AS BIGINT) AS steps, {_r("p.len", "length")} FROM (SELECT dense_rank() OVER (ORDER BY last) AS n, id, row_number() OVER (PARTITION BY last ORDER BY len DESC, id) AS k FROM ends) b JOIN path p ON p.id = b.id JOIN f ON f.id = p.cur WHERE k = 1', "dem", more=FOREST + _ENDS),
)
_DROP = ", hit AS (SELECT p.id, min(p.len) AS len FROM path p JOIN f a ON a.id = p.id JOIN f b ON b.id = p.cur WHERE b.z <= a.z - 9000.0 GROUP BY 1), dn AS (SELECT f.\"row\", f.\"col\", coalesce(h.len, e.len) AS len, f.z - CASE WHEN h.len IS NULL THEN g.z ELSE (SELECT b.z FROM path q JOIN f b ON b.id = q.cur WHERE q.id = f.id AND q.len = h.len) END AS fall FROM f JOIN ends e USING (id) JOIN f g ON g.id = e.last LEFT JOIN hit h ON h.id = f.id)"
_flow("downslope_index", lambda s, d: routing.downslope_index(_dem(s, d), 9000.0), f"SELECT {RC}, CASE WHEN len > 0 THEN fall / len ELSE 0 END AS z FROM dn", more=_ENDS + _DROP, kind="terrain")
_flow("downslope_index_distance", lambda s, d: routing.downslope_index(_dem(s, d), 9000.0, "distance"), f"SELECT {RC}, len AS z FROM dn", more=_ENDS + _DROP, kind="terrain")
_MEET = ", pr AS (SELECT a.id AS a, b.id AS b FROM f a JOIN f b ON abs(a.\"row\" - b.\"row\") <= 1 AND abs(a.\"col\" - b.\"col\") <= 1 AND a.id <> b.id), mt AS (SELECT pr.a, pr.b, min(p.len) AS la, min(q.len) AS lb FROM pr JOIN path p ON p.id = pr.a JOIN path q ON q.id = pr.b AND q.cur = p.cur GROUP BY 1, 2)"
_flow("max_branch_length", lambda s, d: routing.max_branch_length(_dem(s, d)), f"SELECT {_BY}, max(greatest(coalesce(la, ea.len), coalesce(lb, eb.len))) AS z FROM pr LEFT JOIN mt ON mt.a = pr.a AND mt.b = pr.b JOIN ends ea ON ea.id = pr.a JOIN ends eb ON eb.id = pr.b JOIN f ON f.id = pr.a GROUP BY 1, 2", more=_ENDS + _MEET, kind="terrain")
local("hydro_isobasins", "dem", lambda r: routing.isobasins(r, 8), None)
register(
    "hydro_unnest_basins",
    lambda s, d: routing.unnest_basins(_ptr(s, d), _marks(s, d)).select("row", "col", F.col("order").cast("long").alias("nest"), "z"),
    with_inputs(f'SELECT {_BY}, o.nest, m.mark AS z FROM path p JOIN marks m ON m.id = p.cur JOIN (SELECT p.id, count(*) AS nest FROM path p JOIN marks m ON m.id = p.cur GROUP BY 1) o ON o.id = m.id JOIN f ON f.id = p.id', "dem", "zones", more=FOREST + _MARKS),
)
register("hydro_hillslopes", lambda s, d: tidy(routing.hillslopes(_ptr(s, d), _streams(s, d))), None)
register("hydro_hillslopes_topaz", lambda s, d: routing.hillslopes_topaz(_dem(s, d), _ptr(s, d), _streams(s, d)).select("topaz", "kind", "cells"), None)
register(
    "hydro_find_outlet",
    lambda s, d: routing.find_outlet(_ptr(s, d), _streams(s, d), _dem(s, d).select("row", "col", F.when(F.col("row") < 25, 1.0).otherwise(0.0).alias("z"))),
    with_inputs(
        f'SELECT g."row", g."col", k AS cells FROM (SELECT last, count(*) AS k FROM (SELECT id, arg_max(cur, depth) AS last FROM mp GROUP BY 1) e GROUP BY 1) q JOIN f g ON g.id = last JOIN acc a ON a.id = last AND a.n >= {LIMIT} ORDER BY k DESC, last LIMIT 1', "dem",
        more=FOREST + ', acc AS (SELECT cur AS id, count(*) AS n FROM path GROUP BY 1), mf AS (SELECT a.id, b.id AS next FROM f a LEFT JOIN f b ON b.id = a.next AND b."row" < 25 WHERE a."row" < 25), mp AS (SELECT id, id AS cur, 0 AS depth FROM mf UNION ALL SELECT p.id, m.next, p.depth + 1 FROM mp p JOIN mf m ON m.id = p.cur WHERE m.next IS NOT NULL)',
    ),
)
local("hydro_flood_order", "dem", routing.flood_order, None)
local("hydro_upslope_depression_storage", "dem", routing.upslope_depression_storage, None)
_EDGE = ", eg AS (SELECT CAST(\"row\" AS BIGINT) * 4294967296 + \"col\" AS id FROM nb WHERE z IS NOT NULL AND len(list_filter(n, lambda x: x IS NULL)) > 0)"
_flow("edge_contamination", lambda s, d: routing.edge_contamination(_dem(s, d)), f"SELECT {_BY}, max(CASE WHEN e.id IS NULL THEN 0.0 ELSE 1.0 END) AS z FROM path p LEFT JOIN eg e ON e.id = p.id JOIN f ON f.id = p.cur GROUP BY 1, 2", more=_EDGE, kind="plugin")
local("plugin_edge_contamination_mfd", "dem", lambda r: routing.edge_contamination(r, "mfd"), None)
local("hydro_mdinf_flow_accumulation", "dem", routing.mdinf_flow_accumulation, None)
register("hydro_dinf_mass_flux", lambda s, d: tidy(hydro.dinf_mass_flux(_dem(s, d), raster(s, d, "dem2"), raster(s, d, "unit"), raster(s, d, "flags"))), None)

# streams
_flow("extract_streams", lambda s, d: st.extract_streams(hydro.d8_flow_accumulation(_ptr(s, d)), 4.0), f"SELECT {_BY}, 1.0 AS z FROM path p JOIN f ON f.id = p.cur GROUP BY 1, 2 HAVING count(*) > 4", kind="stream")
local("stream_prune_strahler_order", "zones", lambda r: st.prune_strahler_order(r, 3), f"SELECT {RC}, CASE WHEN z >= 3 THEN z - 2 END AS z FROM zones")
register("stream_extract_valleys", lambda s, d: tidy(st.extract_valleys(_dem(s, d))), with_inputs(tidy_sql(f"SELECT {RC}, CASE WHEN z <= list_sort(list(v))[CAST(floor((count(v) - 1) * 0.25) AS INT) + 1] THEN 1.0 ELSE 0.0 END AS z FROM w GROUP BY {RC}, z HAVING z IS NOT NULL"), "dem", more=window_sql("dem", 2, 2)))
local("stream_extract_valleys_johnston_rosenfeld", "dem", lambda r: st.extract_valleys(r, "johnston rosenfeld"), None)
register(
    "stream_long_profile_from_points",
    lambda s, d: rounded(st.long_profile_from_points(_ptr(s, d), _dem(s, d), s.range(0, 50, 7).selectExpr("id AS fid", "CAST(id AS INT) AS row", "CAST((id * 3) % 50 AS INT) AS col"))),
    with_inputs(f'SELECT i AS fid, {_r("p.len", "distance")}, {_r("g.z", "elevation")} FROM range(0, 50, 7) r(i) JOIN f ON f."row" = i AND f."col" = (i * 3) % 50 JOIN path p ON p.id = f.id JOIN f g ON g.id = p.cur', "dem", more=FOREST),
)
register(
    "stream_raster_streams_to_vector",
    lambda s, d: st.streams_to_vector(_ptr(s, d), _streams(s, d)).select(F.size(F.col("parts")[0]).cast("long").alias("vertices")).groupBy("vertices").agg(F.count(F.lit(1)).alias("n")),
    with_inputs("SELECT vertices, count(*) AS n FROM (SELECT link, count(*) + max(CASE WHEN u.next IS NOT NULL AND o.link <> lk.link THEN 1 ELSE 0 END) AS vertices FROM lk JOIN net u USING (id) LEFT JOIN lk o ON o.id = u.next GROUP BY lk.link) q WHERE vertices > 1 GROUP BY 1".replace("(SELECT link,", "(SELECT lk.link,"), "dem", more=FOREST + NETWORK),
)
register("stream_rasterize_streams", lambda s, d: tidy(st.rasterize_streams(st.streams_to_vector(_ptr(s, d), _streams(s, d)), _dem(s, d))), None)

# breaching
_PIT = ", pit AS (SELECT * FROM nb WHERE z IS NOT NULL AND len(list_filter([n[7], n[8], n[9], n[12], n[14], n[17], n[18], n[19]], lambda x: x < z)) = 0)"
_FAR = [(a, b) for a in (-2, -1, 0, 1, 2) for b in (-2, -1, 0, 1, 2) if max(abs(a), abs(b)) == 2]
_CUTS = _PIT + ", cut AS (" + " UNION ALL ".join(f'SELECT "row" + {int(a / 2)} AS r, "col" + {int(b / 2)} AS c, (z + n[{(a + 2) * 5 + b + 3}]) / 2 AS cut FROM pit WHERE n[{(a + 2) * 5 + b + 3}] < z' for a, b in _FAR) + ")"
local_sql = f'SELECT d."row", d."col", least(d.z, (SELECT min(cut) FROM cut WHERE r = d."row" AND c = d."col")) AS z FROM dem d'
register("hydro_breach_single_cell_pits", lambda s, d: tidy(breach.breach_single_cell_pits(_dem(s, d))), with_inputs(tidy_sql(local_sql), "dem", more=neighbours_sql("dem", 2) + _CUTS))
local("hydro_breach_depressions", "dem", breach.breach_depressions, None)
local("hydro_breach_depressions_least_cost", "dem", lambda r: breach.breach_depressions_least_cost(r, 5), None)
local("hydro_fill_depressions_wang_and_liu", "dem", breach.fill_depressions_wang_liu, None)
local("hydro_fill_depressions_planchon_and_darboux", "dem", breach.fill_depressions_planchon_darboux, None)
local("hydro_flow_accumulation_full_workflow", "dem", lambda r: breach.flow_accumulation_full_workflow(r)["accumulation"], None)
local("hydro_stochastic_depression_analysis", "dem", lambda r: breach.stochastic_depression_analysis(r, 5000.0, 2, 3), None)
_OUTER = " AND ".join(f"n[{i}] IS NOT DISTINCT FROM z" for i in range(1, 10))
register(
    "hydro_flatten_lakes",
    lambda s, d: tidy(breach.flatten_lakes(_dem(s, d), raster(s, d, "zones").select("row", "col", F.when(F.col("z") > 4, F.col("z")).otherwise(0.0).alias("z")))),
    with_inputs(tidy_sql(f'SELECT d."row", d."col", coalesce(l.level, d.z) AS z FROM dem d JOIN lake k USING ({RC}) LEFT JOIN (SELECT lk.z AS lake, min(d.z) AS level FROM nb lk JOIN dem d USING ({RC}) WHERE lk.z > 0 AND NOT ({_OUTER.replace("z", "lk.z").replace("n[", "lk.n[")}) GROUP BY 1) l ON l.lake = k.z AND k.z > 0'), "dem", "zones", more=f"lake AS (SELECT {RC}, CASE WHEN z > 4 THEN z ELSE 0.0 END AS z FROM zones), " + neighbours_sql("lake", 1)),
)
register(
    "hydro_raise_walls",
    lambda s, d: tidy(breach.raise_walls(_dem(s, d), raster(s, d, "flags"), 100.0, raster(s, d, "flags2"))),
    with_inputs(tidy_sql(f'SELECT d."row", d."col", d.z + CASE WHEN a.z > 0 AND b.z <= 0 THEN 100 ELSE 0 END AS z FROM dem d JOIN flags a USING ({RC}) JOIN flags2 b USING ({RC})'), "dem", "flags", "flags2"),
)
local2("hydro_fill_burn", "dem", "flags", breach.fill_burn, None)
_NEAR = f", st AS (SELECT {RC}, dem.z FROM dem JOIN flags USING ({RC}) WHERE flags.z > 0), cr AS (SELECT {RC} FROM st JOIN flags2 USING ({RC}) WHERE flags2.z > 0), ct AS (SELECT s.\"row\", s.\"col\", min(m.m) AS cut FROM st s JOIN (SELECT c.\"row\", c.\"col\", min(s.z) AS m FROM cr c JOIN st s ON abs(s.\"row\" - c.\"row\") <= 1 AND abs(s.\"col\" - c.\"col\") <= 1 GROUP BY 1, 2) m ON abs(s.\"row\" - m.\"row\") <= 1 AND abs(s.\"col\" - m.\"col\") <= 1 GROUP BY 1, 2)"
register(
    "hydro_burn_streams_at_roads",
    lambda s, d: tidy(breach.burn_streams_at_roads(_dem(s, d), raster(s, d, "flags"), raster(s, d, "flags2"), 1)),
    with_inputs(tidy_sql(f"SELECT dem.\"row\", dem.\"col\", least(z, cut) AS z FROM dem LEFT JOIN ct USING ({RC})"), "dem", "flags", "flags2", more=_NEAR[2:]),
)
register("hydro_impoundment_size_index", lambda s, d: tidy(breach.impoundment_size_index(_dem(s, d), 5), "height", "area", "volume", "mean", digits=3), None)
register("hydro_insert_dams", lambda s, d: tidy(breach.insert_dams(_dem(s, d), s.range(2, 48, 9).selectExpr("CAST(id AS INT) AS row", "CAST(id AS INT) AS col"), 5)), None)
