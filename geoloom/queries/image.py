"""Queries of the other image operators."""

from __future__ import annotations

from geoloom.functions.calculator import to_sql
from geoloom.operators import hydro
from geoloom.operators import image as op
from geoloom.queries.base import bands, local, neighbours_sql, raster, register, tidy, tidy_sql, with_inputs
from geoloom.queries.hydro import AT
from geoloom.queries.stats import _CDF, _HIST, _r, rounded

RC = '"row", "col"'
_EXPR = "('a' - 'b' * 2 + 1) / max('b', 10) % 7 + ('a' > 50000 && 'b' < 5) * 100 ^ 0.5"
register(
    "plugin_raster_calculator",
    lambda s, d: tidy(op.raster_calculator(_EXPR, {"a": raster(s, d, "dem"), "b": raster(s, d, "dem2")})),
    with_inputs(tidy_sql(f'SELECT a."row", a."col", {to_sql(_EXPR, {"a": "a.z", "b": "b.z"})} AS z FROM dem a JOIN dem2 b ON a."row" = b."row" AND a."col" = b."col"'), "dem", "dem2"),
)
_EVERY = 'g AS (SELECT CAST(r.i AS INT) AS "row", CAST(c.i AS INT) AS "col" FROM (SELECT unnest(range((SELECT min("row") FROM dem2), (SELECT max("row") FROM dem2) + 1)) AS i) r, (SELECT unnest(range((SELECT min("col") FROM dem2), (SELECT max("col") FROM dem2) + 1)) AS i) c)'
# NoData counts as 0, and every cell of the extent has its sum
register("image_integral_image", lambda s, d: tidy(op.integral_image(raster(s, d, "dem2"))), with_inputs(tidy_sql('SELECT g."row", g."col", coalesce((SELECT sum(e.z) FROM dem2 e WHERE e."row" <= g."row" AND e."col" <= g."col"), 0) AS z FROM g'), "dem2", more=_EVERY))
register(
    "image_change_vector_analysis",
    lambda s, d: tidy(op.change_vector_analysis([raster(s, d, "dem"), raster(s, d, "dem2")], [raster(s, d, "dem_gappy"), raster(s, d, "zones")]), "magnitude", "direction"),
    with_inputs(tidy_sql('SELECT a."row", a."col", sqrt(power(g.z - a.z, 2) + power(y.z - b.z, 2)) AS magnitude, CASE WHEN g.z > a.z THEN 1.0 ELSE 0.0 END + CASE WHEN y.z > b.z THEN 2.0 ELSE 0.0 END AS direction FROM dem a JOIN dem2 b ON a."row" = b."row" AND a."col" = b."col" JOIN dem_gappy g ON a."row" = g."row" AND a."col" = g."col" JOIN zones y ON a."row" = y."row" AND a."col" = y."col"', "magnitude", "direction"), "dem", "dem2", "dem_gappy", "zones"),
)
_H2 = ", " + _HIST.format(1024).replace("h AS", "h2 AS").replace("FROM dem", "FROM dem2") + ", c2 AS (SELECT bin, sum(count(*)) OVER (ORDER BY bin) / sum(count(*)) OVER () AS c, min(z) AS v FROM h2 GROUP BY bin)"
register("image_histogram_matching_two_images", lambda s, d: tidy(op.histogram_matching(raster(s, d, "dem"), raster(s, d, "dem2"))), with_inputs(tidy_sql(f'SELECT h."row", h."col", (SELECT arg_min(v, c2.c) FROM c2 WHERE c2.c >= c.cdf - 1e-12) AS z FROM h JOIN c USING (bin)'), "dem", "dem2", more=_HIST.format(1024) + _CDF + _H2))
register("image_stack_profile", lambda s, d: rounded(op.image_stack_profile(bands(s, d), s.range(0, 50, 5).selectExpr("id AS fid", "CAST(id AS INT) AS row", "CAST(id AS INT) AS col"))), with_inputs(f'SELECT i AS fid, band, {_r("z", "z")} FROM range(0, 50, 5) r(i) JOIN bands ON "row" = i AND "col" = i', "bands"))
_EDGE = "(" + " OR ".join(f"n[{i}] IS NULL OR n[{i}] <> z" for i in AT) + ")"
register("gis_find_patch_or_class_edge_cells", lambda s, d: tidy(op.find_patch_edge_cells(raster(s, d, "flags"))), with_inputs(tidy_sql(f"SELECT {RC}, CASE WHEN {_EDGE} THEN z ELSE 0.0 END AS z FROM nb"), "flags", more=neighbours_sql("flags", 1)))
register("gis_edge_proportion", lambda s, d: rounded(op.edge_proportion(raster(s, d, "flags"))), with_inputs(f"SELECT z AS class, {_r(f'avg(CASE WHEN {_EDGE} THEN 1.0 ELSE 0.0 END)', 'proportion')} FROM nb WHERE z > 0 GROUP BY 1", "flags", more=neighbours_sql("flags", 1)))
register("data_raster_to_vector_points", lambda s, d: tidy(op.raster_to_points(raster(s, d, "zones")), "x", "y", "z"), with_inputs(tidy_sql(f'SELECT {RC}, "col" + 0.5 AS x, "row" + 0.5 AS y, z FROM zones WHERE z <> 0', "x", "y", "z"), "zones"))
_BOX = 'b AS (SELECT min("row") AS r0, max("row") AS r1, min("col") AS c0, max("col") AS c1 FROM dem), fine AS (SELECT CAST(r.i AS INT) AS "row", CAST(c.i AS INT) AS "col", (r.i + 0.5) / 2 - 0.5 AS y, (c.i + 0.5) / 2 - 0.5 AS x FROM (SELECT unnest(range(CAST(r0 * 2 AS BIGINT), CAST((r1 + 1) * 2 AS BIGINT))) AS i FROM b) r, (SELECT unnest(range(CAST(c0 * 2 AS BIGINT), CAST((c1 + 1) * 2 AS BIGINT))) AS i FROM b) c)'
register("image_resample_nearest", lambda s, d: tidy(op.resample(raster(s, d, "dem"), 2.0)), with_inputs(tidy_sql('SELECT f."row", f."col", z FROM fine f JOIN dem ON dem."row" = floor(y + 0.5) AND dem."col" = floor(x + 0.5)'), "dem", more=_BOX))
register("image_resample_bilinear", lambda s, d: tidy(op.resample(raster(s, d, "dem"), 2.0, "bilinear"), digits=4), with_inputs(tidy_sql('SELECT f."row", f."col", sum(z * (1 - abs(y - dem."row")) * (1 - abs(x - dem."col"))) / sum((1 - abs(y - dem."row")) * (1 - abs(x - dem."col"))) AS z FROM fine f JOIN dem ON abs(dem."row" - y) < 1 AND abs(dem."col" - x) < 1 GROUP BY 1, 2', digits=4), "dem", more=_BOX))
register("image_mosaic", lambda s, d: tidy(op.mosaic([raster(s, d, "dem"), raster(s, d, "dem_gappy"), raster(s, d, "dem2").filter("row < 9")])), with_inputs(tidy_sql('SELECT a."row", a."col", CASE WHEN a."row" < 9 THEN c.z ELSE coalesce(b.z, a.z) END AS z FROM dem a JOIN dem_gappy b ON a."row" = b."row" AND a."col" = b."col" JOIN dem2 c ON a."row" = c."row" AND a."col" = c."col"'), "dem", "dem_gappy", "dem2"))
local("image_correct_vignetting", "dem2", lambda r: op.vignetting(r, 25.0, 25.0, 60.0), f'SELECT {RC}, z / power(cos(atan(sqrt(power("row" - 25, 2) + power("col" - 25, 2)) / 60)), 4) AS z FROM dem2')
register("hydro_find_parallel_flow", lambda s, d: tidy(op.find_parallel_flow(hydro.d8_pointer(raster(s, d, "dem")), raster(s, d, "flags"))), None)
