"""Further queries on clouds and surfaces."""

from __future__ import annotations

from pyspark.sql import functions as F

from geoloom.operators import points as po
from geoloom.queries.base import lidar, points, raster, register, tidy, tidy_sql, with_inputs
from geoloom.queries.points import _NEAR
from geoloom.queries.stats import _r, rounded

RC = '"row", "col"'
_L = _NEAR.replace("FROM points", "FROM lidar").replace("JOIN points", "JOIN lidar")
for _name, _fn, _sql, _d in (
    ("lidar_idw_interpolation", lambda p: po.idw_interpolation(p, 40.0, 30.0, 1.0), "coalesce(avg(CASE WHEN d = 0 THEN v END), sum(CASE WHEN d > 0 THEN v / d END) / sum(CASE WHEN d > 0 THEN 1 / d END))", 2),
    ("lidar_nearest_neighbour_gridding", lambda p: po.nearest_gridding(p, 40.0, 30.0), "min({'d': d, 'v': v}).v", 4),
):
    register(_name, lambda s, d, f=_fn, k=_d: tidy(f(lidar(s, d)), digits=k), with_inputs(tidy_sql(f'SELECT "row", "col", {_sql} AS z FROM n GROUP BY 1, 2', digits=_d), "lidar", more=_L))
register("data_export_table_to_csv", lambda s, d: points(s, d).select("fid", "cls"), with_inputs("SELECT fid, cls FROM points", "points"))
register("stats_attribute_correlation", lambda s, d: rounded(points(s, d).agg(F.corr("x", "z").alias("xz"), F.corr("x", "y").alias("xy"))), with_inputs(f"SELECT {_r('corr(x, z)', 'xz')}, {_r('corr(x, y)', 'xy')} FROM points", "points"))
register("stats_attribute_scattergram", lambda s, d: rounded(points(s, d).agg(F.count(F.lit(1)).alias("n"), F.regr_slope("z", "x").alias("slope"), F.regr_intercept("z", "x").alias("intercept"), F.regr_r2("z", "x").alias("r2")), 3), with_inputs(f"SELECT count(*) AS n, {_r('regr_slope(z, x)', 'slope', 3)}, {_r('regr_intercept(z, x)', 'intercept', 3)}, {_r('regr_r2(z, x)', 'r2', 3)} FROM points", "points"))
