"""Queries of points and point clouds."""

from __future__ import annotations

from pyspark.sql import functions as F

from geoloom.operators import points as op
from geoloom.queries.base import lidar, points, raster, register, tidy, tidy_sql, with_inputs
from geoloom.queries.stats import _r, rounded

_C = 'CAST(floor(y / {0}) AS INT) AS "row", CAST(floor(x / {0}) AS INT) AS "col"'


def _grid(name: str, source, table: str, fn, sql: str, *values: str, size: float = 20.0, digits: int = 4) -> None:
    register(name, lambda s, d: tidy(fn(source(s, d)), *values, digits=digits), with_inputs(tidy_sql(f"SELECT {_C.format(size)}, {sql} FROM {table} GROUP BY 1, 2", *values, digits=digits), table))


for _k, _sql in (("maximum", "max"), ("minimum", "min")):
    _grid(f"gis_block_{_k}_gridding", points, "points", lambda p, k=_sql: op.block_gridding(p, 20.0, k), f"{_sql}(z) AS z")
    _grid(f"lidar_block_{_k}", lidar, "lidar", lambda p, k=_sql: op.block_gridding(p, 20.0, k), f"{_sql}(z) AS z")
for _k, _sql in (("last", "arg_max(z, fid)"), ("first", "arg_min(z, fid)"), ("sum", "sum(z)"), ("mean", "avg(z)"), ("number", "CAST(count(z) AS DOUBLE)")):
    _grid(f"data_vector_points_to_raster_{_k}", points, "points", lambda p, k=_k: op.points_to_raster(p, 20.0, k), f"{_sql} AS z", digits=3)
_grid("lidar_flightline_overlap", lidar, "lidar", lambda p: op.flightline_overlap(p, 20.0), "CAST(count(DISTINCT point_source_id) AS DOUBLE) AS z")
register(
    "lidar_point_stats",
    lambda s, d: rounded(op.point_stats(lidar(s, d), 20.0)),
    with_inputs(f'SELECT "row", "col", CAST(sum(n) AS BIGINT) AS n, {_r("max(z1) - min(z0)", "z_range")}, max(i1) - min(i0) AS intensity_range, arg_min(classification, {{\'a\': -n, \'b\': classification}}) AS predominant FROM (SELECT {_C.format(20.0)}, classification, count(*) AS n, min(z) AS z0, max(z) AS z1, min(intensity) AS i0, max(intensity) AS i1 FROM lidar GROUP BY 1, 2, 3) q GROUP BY 1, 2', "lidar"),
)
_HEX = "SELECT CAST(CASE WHEN da > db AND da > dc THEN -b - c ELSE a END AS BIGINT) AS q, CAST(CASE WHEN da > db AND da > dc THEN b WHEN db > dc THEN -a - c ELSE b END AS BIGINT) AS r, count(*) AS n FROM (SELECT round(q) AS a, round(r) AS b, round(-q - r) AS c, abs(round(q) - q) AS da, abs(round(r) - r) AS db, abs(round(-q - r) + q + r) AS dc FROM (SELECT (sqrt(3.0) / 3 * x - y / 3) / (25.0 / sqrt(3.0)) AS q, y * (2.0 / 3) / (25.0 / sqrt(3.0)) AS r FROM {0}) h) g GROUP BY 1, 2"
register("gis_vector_hex_binning", lambda s, d: op.hex_bins(points(s, d), 25.0), with_inputs(_HEX.format("points"), "points"))
register("lidar_hex_binning", lambda s, d: op.hex_bins(lidar(s, d), 25.0), with_inputs(_HEX.format("lidar"), "lidar"))

#: n: cell centres (every 40) of the extent with the points within 30.
_NEAR = 'ext AS (SELECT min(floor(y / 40)) AS r0, max(floor(y / 40)) AS r1, min(floor(x / 40)) AS c0, max(floor(x / 40)) AS c1 FROM points), cen AS (SELECT CAST(r.i AS INT) AS "row", CAST(c.i AS INT) AS "col", (c.i + 0.5) * 40 AS cx, (r.i + 0.5) * 40 AS cy FROM (SELECT unnest(range(CAST(r0 AS BIGINT), CAST(r1 AS BIGINT) + 1)) AS i FROM ext) r, (SELECT unnest(range(CAST(c0 AS BIGINT), CAST(c1 AS BIGINT) + 1)) AS i FROM ext) c), n AS (SELECT "row", "col", z AS v, sqrt(power(x - cx, 2) + power(y - cy, 2)) AS d FROM cen JOIN points ON x BETWEEN cx - 30 AND cx + 30 AND y BETWEEN cy - 30 AND cy + 30 WHERE sqrt(power(x - cx, 2) + power(y - cy, 2)) <= 30)'


def _near(name: str, fn, sql: str, digits: int = 4) -> None:
    register(name, lambda s, d: tidy(fn(points(s, d)), digits=digits), with_inputs(tidy_sql(f'SELECT "row", "col", {sql} AS z FROM n GROUP BY 1, 2', digits=digits), "points", more=_NEAR))


_near("gis_idw_interpolation", lambda p: op.idw_interpolation(p, 40.0, 30.0), "coalesce(avg(CASE WHEN d = 0 THEN v END), sum(CASE WHEN d > 0 THEN v / (d * d) END) / sum(CASE WHEN d > 0 THEN 1 / (d * d) END))", 2)
_near("gis_nearest_neighbour_gridding", lambda p: op.nearest_gridding(p, 40.0, 30.0), "min({'d': d, 'v': v}).v")
_near("lidar_point_density", lambda p: op.point_density(p, 40.0, 30.0), "count(*) / (pi() * 900)", 6)
for _k, _sql in op.KERNELS.items():
    register(f"plugin_heat_map_{_k}", lambda s, d, k=_k: tidy(op.heat_map(points(s, d), 40.0, 30.0, k), digits=5), with_inputs(tidy_sql(f'SELECT "row", "col", sum({_sql}) AS z FROM (SELECT *, d / 30.0 AS t FROM n) q GROUP BY 1, 2', digits=5), "points", more=_NEAR))


def _cloud(name: str, fn, sql: str, digits: int = 4) -> None:
    register(f"lidar_{name}", lambda s, d: rounded(fn(lidar(s, d)), digits), with_inputs(sql, "lidar") if sql else None)


_ALL = "x, y, z, intensity, return_no, classification, point_source_id"
_cloud("elevation_slice", lambda p: op.elevation_slice(p, 20000.0, 25000.0), f"SELECT {_ALL.replace('z,', 'round(z + 1e-7, 4) AS z,')} FROM lidar WHERE z BETWEEN 20000 AND 25000")
_cloud("info", op.info, f"SELECT classification, return_no, count(*) AS n, {_r('min(z)', 'z0', 4)}, {_r('max(z)', 'z1', 4)}, {_r('avg(intensity)', 'intensity', 4)} FROM lidar GROUP BY 1, 2")
_cloud("shift", lambda p: op.shift(p, 1.5, -2.0, 10.0).groupBy("return_no").agg(F.min("x").alias("x"), F.max("y").alias("y"), F.max("z").alias("z")), f"SELECT return_no, {_r('min(x) + 1.5', 'x', 4)}, {_r('max(y) - 2', 'y', 4)}, {_r('max(z) + 10', 'z', 4)} FROM lidar GROUP BY 1")
for _m, _o in (("lowest", "z, x, y, intensity"), ("highest", "z DESC, x, y, z, intensity"), ("nearest", "power(x - (c + 0.5) * 20, 2) + power(y - (r + 0.5) * 20, 2), x, y, z, intensity")):
    _cloud(f"thin_{_m}", lambda p, m=_m: op.thin(p, 20.0, m, ["x", "y", "z", "intensity"]).select("x", "y", "z", "intensity"), f"SELECT x, y, {_r('z', 'z', 4)}, intensity FROM (SELECT *, floor(x / 20) AS c, floor(y / 20) AS r FROM lidar) q QUALIFY row_number() OVER (PARTITION BY r, c ORDER BY {_o}) = 1")
_cloud("thin_high_density", lambda p: op.thin_high_density(p, 20.0, 3, ["x", "y", "z", "intensity"]).select("x", "y", "z", "intensity"), f"SELECT x, y, {_r('z', 'z', 4)}, intensity FROM lidar QUALIFY row_number() OVER (PARTITION BY floor(y / 20), floor(x / 20) ORDER BY x, y, z, intensity) <= 3")
_cloud("remove_duplicates", lambda p: op.remove_duplicates(p).select("x", "y", "z"), f"SELECT x, y, {_r('min(z)', 'z', 4)} FROM lidar GROUP BY 1, 2")
_cloud("tile_footprint", lambda p: op.to_cells(p, 100.0).groupBy("row", "col").agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1")), f"SELECT {_C.format(100.0)}, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM lidar GROUP BY 1, 2")
_DIST = "x BETWEEN t.x - 3 AND t.x + 3 AND y BETWEEN t.y - 3 AND t.y + 3 AND sqrt(power(t.x - p.x, 2) + power(t.y - p.y, 2)) <= 3".replace("x BETWEEN", "p.x BETWEEN").replace("AND y BETWEEN", "AND p.y BETWEEN")
_cloud("height_above_ground", lambda p: op.height_above_ground(p, 3.0).select("x", "y", "z", "height"), f"SELECT l.x, l.y, {_r('l.z', 'z', 4)}, {_r('l.z - m.g', 'height', 4)} FROM lidar l LEFT JOIN (SELECT t.x, t.y, min({{'d': sqrt(power(t.x - p.x, 2) + power(t.y - p.y, 2)), 'z': p.z}}).z AS g FROM (SELECT DISTINCT x, y FROM lidar) t JOIN lidar p ON p.classification = 2 AND {_DIST} GROUP BY 1, 2) m ON m.x = l.x AND m.y = l.y")
_cloud("remove_outliers", lambda p: op.remove_outliers(p, 3.0, 30000.0).select("x", "y", "z"), f"SELECT l.x, l.y, {_r('l.z', 'z', 4)} FROM lidar l JOIN (SELECT t.x, t.y, sum(p.z) AS s, count(*) AS n FROM (SELECT DISTINCT x, y FROM lidar) t JOIN lidar p ON {_DIST} GROUP BY 1, 2) m ON m.x = l.x AND m.y = l.y WHERE n < 2 OR abs(l.z - (s - l.z) / (n - 1)) <= 30000")
register(
    "lidar_tophat_transform",
    lambda s, d: rounded(op.tophat(lidar(s, d), 3.0), 4),
    with_inputs(f"SELECT l.x, l.y, {_r('l.z', 'z', 4)}, {_r('l.z - o.z', 'height', 4)} FROM lidar l JOIN o ON o.x = l.x AND o.y = l.y", "lidar", more=f"q AS (SELECT x, y, min(z) AS z FROM lidar GROUP BY 1, 2), e AS (SELECT t.x, t.y, min(p.z) AS z FROM q t JOIN q p ON {_DIST} GROUP BY 1, 2), o AS (SELECT t.x, t.y, max(p.z) AS z FROM e t JOIN e p ON {_DIST} GROUP BY 1, 2)"),
)
register("plugin_normalize_lidar", lambda s, d: rounded(op.normalize(lidar(s, d), raster(s, d, "dem2"), 40.0).select("x", "y", "z"), 4), with_inputs(f'SELECT x, y, {_r("l.z - t.z", "z", 4)} FROM lidar l LEFT JOIN dem2 t ON t."row" = floor(l.y / 40) AND t."col" = floor(l.x / 40)', "lidar", "dem2"))
register("gis_eliminate_coincident_points", lambda s, d: op.coincident(points(s, d), 2.0).select("fid"), with_inputs("SELECT fid FROM points t WHERE NOT EXISTS (SELECT 1 FROM points p WHERE p.fid < t.fid AND p.x BETWEEN t.x - 2 AND t.x + 2 AND p.y BETWEEN t.y - 2 AND t.y + 2 AND sqrt(power(t.x - p.x, 2) + power(t.y - p.y, 2)) <= 2)", "points"))
