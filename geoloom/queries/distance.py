"""Queries of distances."""

from __future__ import annotations

from pyspark.sql import functions as F

from geoloom.functions.grids import horizon
from geoloom.operators import distance as op
from geoloom.plans.tiles import by_tile
from geoloom.queries.base import raster, register, tidy, tidy_sql, with_inputs

RC = '"row", "col"'


def _targets(s, d):
    return raster(s, d, "dem").select("row", "col", F.when((F.col("row") * 7 + F.col("col") * 3) % 41 == 5, F.col("row") * 1.0 + F.col("col") * 100 + 1).otherwise(F.lit(0.0)).alias("z"))


_T = ", ".join(
    [
        'box AS (SELECT min("row") AS r0, max("row") AS r1, min("col") AS c0, max("col") AS c1 FROM dem)',
        'cells AS (SELECT CAST(r.i AS INT) AS "row", CAST(c.i AS INT) AS "col" FROM (SELECT unnest(range(CAST(r0 AS BIGINT), CAST(r1 AS BIGINT) + 1)) AS i FROM box) r, (SELECT unnest(range(CAST(c0 AS BIGINT), CAST(c1 AS BIGINT) + 1)) AS i FROM box) c)',
        't AS (SELECT "row" AS r, "col" AS c, "row" * 1.0 + "col" * 100 + 1 AS v FROM cells WHERE ("row" * 7 + "col" * 3) % 41 = 5)',
        'near AS (SELECT "row", "col", min({\'d\': power("row" - r, 2) + power("col" - c, 2), \'r\': r, \'c\': c, \'v\': v}) AS m FROM cells, t GROUP BY 1, 2)',
    ]
)
register("gis_euclidean_distance", lambda s, d: tidy(op.euclidean_distance(_targets(s, d))), with_inputs(tidy_sql(f"SELECT {RC}, sqrt(m.d) AS z FROM near"), "dem", more=_T))
register("gis_euclidean_allocation", lambda s, d: tidy(op.euclidean_allocation(_targets(s, d))), with_inputs(tidy_sql(f"SELECT {RC}, m.v AS z FROM near"), "dem", more=_T))
register("gis_buffer_raster", lambda s, d: tidy(op.buffer_raster(_targets(s, d), 2.5)), with_inputs(tidy_sql(f"SELECT {RC}, CASE WHEN sqrt(m.d) <= 2.5 THEN 1.0 ELSE 0.0 END AS z FROM near"), "dem", more=_T))
register("hydro_elevation_above_stream_euclidean", lambda s, d: tidy(op.elevation_above_stream_euclidean(raster(s, d, "dem"), _targets(s, d))), with_inputs(tidy_sql('SELECT e."row", e."col", e.z - l.z AS z FROM near n JOIN dem e ON e."row" = n."row" AND e."col" = n."col" JOIN dem l ON l."row" = n.m.r AND l."col" = n.m.c'), "dem", more=_T))
register("gis_cost_distance", lambda s, d: tidy(op.cost_distance(_targets(s, d), raster(s, d, "dem2"))), None)
register("terrain_horizon_angle", lambda s, d: tidy(by_tile(raster(s, d, "dem"), 10, lambda z, at: {"z": horizon(z, 315.0, 10)}, "row int, col int, z double")), None)
