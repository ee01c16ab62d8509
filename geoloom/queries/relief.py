"""Queries of terrain at many scales and along rays."""

from __future__ import annotations

from pyspark.sql import functions as F

from geoloom.operators import multiscale as op
from geoloom.queries.base import raster, register, tidy

SCALES = [1, 2, 4]


def _sites(s):
    return s.range(0, 50, 9).selectExpr("id AS site", "CAST(id AS INT) AS row", "CAST(49 - id AS INT) AS col")


def _low(s, d):
    return raster(s, d, "dem").select("row", "col", (F.col("z") / 10000).alias("z"))


for _name, _measure in (("multiscale_roughness", "roughness"), ("multiscale_std_dev_normals", "std_dev_normals"), ("multiscale_elevation_percentile", "percentile"), ("max_anisotropy_dev", "anisotropy")):
    register(f"terrain_{_name}", lambda s, d, m=_measure: tidy(op.strongest(_low(s, d), SCALES, m, 16), "z", "scale"))
for _name, _measure in (("multiscale_roughness_signature", "roughness"), ("multiscale_std_dev_normals_signature", "std_dev_normals"), ("max_anisotropy_dev_signature", "anisotropy")):
    register(f"terrain_{_name}", lambda s, d, m=_measure: op.signature(_low(s, d), _sites(s), SCALES, m, 16).select("site", "scale", F.round("z", 6).alias("z")))
for _name, _fn in (
    ("terrain_average_normal_vector_angular_deviation", op.normal_vector_deviation),
    ("terrain_edge_density", lambda r: op.edge_density(r, 5, 20.0)),
    ("terrain_feature_preserving_smoothing", lambda r: op.feature_preserving_smoothing(r, 5, 30.0, tile=16)),
    ("terrain_drainage_preserving_smoothing", lambda r: op.drainage_preserving_smoothing(r, 5, 30.0, tile=16)),
    ("terrain_remove_off_terrain_objects", lambda r: op.remove_off_terrain_objects(r, 5, 45.0, 16)),
    ("terrain_directional_relief", lambda r: op.directional_relief(r, 45.0, 10, 16)),
    ("terrain_fetch_analysis", lambda r: op.fetch_analysis(r, 45.0, 0.05, 20, 16)),
    ("plugin_exposure_towards_wind_flux", lambda r: op.exposure_towards_wind_flux(r, 45.0, 10, 16)),
    ("terrain_geomorphons", lambda r: op.geomorphons(r, 8, 1.0, tile=16)),
    ("terrain_time_in_daylight", lambda r: op.time_in_daylight(r, 43.0, 30.0, 10, (80, 172), (9.0, 12.0, 16.0), 16)),
    ("terrain_visibility_index", lambda r: op.visibility_index(r, 0.2, 3, 9, 16)),
):
    register(_name, lambda s, d, f=_fn: tidy(f(_low(s, d))))
register("terrain_fill_missing_data", lambda s, d: tidy(op.fill_missing_data(raster(s, d, "dem_gappy"), 7, tile=16)))
register("plugin_local_quadratic_regression", lambda s, d: tidy(op.local_quadratic_regression(_low(s, d), 5, 16), "slope", "aspect", "profile", "plan", "mean"))
register("plugin_gaussian_scale_space", lambda s, d: tidy(op.gaussian_scale_space(_low(s, d), steps=4, tile=16), "z", "zscore", "scale"))
register("terrain_viewshed", lambda s, d: tidy(op.viewshed(_low(s, d), _sites(s), 0.5, 15, 16)))
