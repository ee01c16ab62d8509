"""Terrain at many scales and along rays, on tiles with a halo as wide as the reach.

All scales are computed in one pass over a tile: window sums come from integral images, so a scale costs
the same whatever its size, and the raster is exchanged once, not once for each scale.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.functions import relief
from geoloom.plans.stencil import TILE
from geoloom.plans.tiles import by_tile

Raster = DataFrame
Measure = Callable[[np.ndarray, int], np.ndarray]

#: Measures of one scale r, over windows of 2·r + 1 cells.
MEASURES: dict[str, Measure] = {
    "roughness": relief.normal_deviation,
    "std_dev_normals": relief.normal_spread,
    "percentile": lambda z, r: relief.percentile(z, r) - 50.0,
    "anisotropy": relief.anisotropy,
}


def scale_stack(dem: Raster, scales: Sequence[int], measure: str, tile: int = TILE) -> DataFrame:
    """row, col, v0, v1, …: the measure at each scale."""
    fn = MEASURES[measure]
    schema = ", ".join(["row int", "col int", *(f"v{i} double" for i in range(len(scales)))])
    return by_tile(dem, 2 * max(scales) + 2, lambda z, at: {f"v{i}": fn(z, r) for i, r in enumerate(scales)}, schema, tile=tile)


def strongest(dem: Raster, scales: Sequence[int], measure: str, tile: int = TILE) -> DataFrame:
    """row, col, z, scale: the value farthest from 0 over all scales; the first on a tie."""
    s = scale_stack(dem, scales, measure, tile)
    each = F.array(*[F.struct((-F.abs(f"v{i}")).alias("k"), F.lit(float(r)).alias("scale"), F.col(f"v{i}").alias("z")) for i, r in enumerate(scales)])
    best = F.array_min(F.filter(each, lambda x: x["z"].isNotNull()))
    return s.select("row", "col", best.alias("b")).select("row", "col", "b.z", "b.scale")


def signature(dem: Raster, sites: DataFrame, scales: Sequence[int], measure: str, tile: int = TILE) -> DataFrame:
    """site, scale, z: the measure of each site (site, row, col) at each scale."""
    s = scale_stack(dem, scales, measure, tile).join(sites, ["row", "col"])
    each = F.array(*[F.struct(F.lit(r).alias("scale"), F.col(f"v{i}").alias("z")) for i, r in enumerate(scales)])
    return s.select("site", F.explode(each).alias("x")).select("site", "x.scale", "x.z")


def _one(dem: Raster, halo: int, fn: Callable[[np.ndarray], np.ndarray], tile: int = TILE) -> Raster:
    return by_tile(dem, halo, lambda z, at: {"z": fn(z)}, "row int, col int, z double", tile=tile)


def normal_vector_deviation(dem: Raster, size: int = 11) -> Raster:
    """Mean angle (degrees) in a window between the normals of the DEM and of its smoothed form."""
    return _one(dem, 2 * (size // 2) + 2, lambda z: relief.normal_deviation(z, size // 2))


def edge_density(dem: Raster, size: int = 11, norm_diff: float = 5.0) -> Raster:
    """Share of the window's cells with a neighbour whose normal is over ``norm_diff`` degrees off."""
    return _one(dem, size // 2 + 3, lambda z: relief.edge_density(z, size // 2, norm_diff))


def feature_preserving_smoothing(dem: Raster, size: int = 11, norm_diff: float = 15.0, iterations: int = 3, max_diff: float = 0.5, tile: int = TILE) -> Raster:
    """Elevations fitted to normals that were smoothed among cells of like slope; no cell moves over ``max_diff``."""
    return _one(dem, size // 2 + iterations + 3, lambda z: relief.smoothed(z, size // 2, norm_diff, iterations, max_diff), tile)


def drainage_preserving_smoothing(dem: Raster, size: int = 11, norm_diff: float = 15.0, iterations: int = 3, max_diff: float = 0.5, reduction: float = 80.0, dfm: float = 0.15, tile: int = TILE) -> Raster:
    """:func:`feature_preserving_smoothing` whose effect is ``reduction`` percent weaker where a cell is over ``dfm`` below the mean of its window."""

    def run(z: np.ndarray) -> np.ndarray:
        out = relief.smoothed(z, size // 2, norm_diff, iterations, max_diff)
        low = relief.mean(z, size // 2) - z > dfm
        return np.where(low, z + (out - z) * (1 - reduction / 100), out)

    return _one(dem, size // 2 + iterations + 3, run, tile)


def fill_missing_data(raster: Raster, size: int = 11, weight: float = 2.0, no_edges: bool = True, tile: int = TILE) -> Raster:
    """NoData cells from the cells within ``size`` // 2 by inverse distance to the power ``weight``.

    With ``no_edges`` a cell is filled only if there is data on opposite sides of it within reach.
    """
    return _one(raster, size // 2, lambda z: relief.gaps_filled(z, size // 2, weight, no_edges), tile)


def remove_off_terrain_objects(dem: Raster, size: int = 11, slope: float = 15.0, tile: int = TILE) -> Raster:
    """Objects that stand out of an opening of the window and end in slopes over ``slope`` degrees go down to the opening."""
    return _one(dem, 4 * (size // 2) + 2, lambda z: relief.without_objects(z, size // 2, slope), tile)


def local_quadratic_regression(dem: Raster, size: int = 3, tile: int = TILE) -> DataFrame:
    """row, col, slope, aspect (degrees), profile, plan and mean curvature of a quadratic surface fitted to the window."""
    return by_tile(dem, size // 2, lambda z, at: relief.quadratic(z, size // 2), "row int, col int, slope double, aspect double, profile double, plan double, mean double", tile=tile)


def gaussian_scale_space(dem: Raster, sigma: float = 0.5, step: float = 0.5, steps: int = 10, surface: str = "slope", tile: int = TILE) -> DataFrame:
    """row, col, z, zscore, scale: a surface parameter of the DEM at the Gaussian scale at which it is farthest from its mean."""
    sigmas = [sigma + step * i for i in range(steps)]
    reach = int(np.ceil(3 * sigmas[-1])) + 2
    schema = ", ".join(["row int", "col int", *(f"v{i} double" for i in range(steps))])
    s = by_tile(dem, reach, lambda z, at: {f"v{i}": relief.SURFACES[surface](relief.gaussian(z, g)) for i, g in enumerate(sigmas)}, schema, tile=tile)
    moments = s.agg(*[f(F.col(f"v{i}")).alias(f"{k}{i}") for i in range(steps) for k, f in (("m", F.avg), ("s", F.stddev_pop))])  # one row
    score = lambda i: F.when(F.col(f"s{i}") > 0, (F.col(f"v{i}") - F.col(f"m{i}")) / F.col(f"s{i}")).otherwise(F.col(f"v{i}") * 0)
    each = F.array(*[F.struct((-F.abs(score(i))).alias("k"), F.lit(g).alias("scale"), F.col(f"v{i}").alias("z"), score(i).alias("zscore")) for i, g in enumerate(sigmas)])
    best = F.array_min(F.filter(each, lambda x: x["z"].isNotNull()))
    return s.crossJoin(F.broadcast(moments)).select("row", "col", best.alias("b")).select("row", "col", "b.z", "b.zscore", "b.scale")


# rays


def directional_relief(dem: Raster, azimuth: float = 0.0, max_dist: int = 50, tile: int = TILE) -> Raster:
    """Mean elevation along the ray towards ``azimuth`` less the cell's own."""
    return _one(dem, max_dist, lambda z: relief.ray_relief(z, azimuth, max_dist), tile)


def fetch_analysis(dem: Raster, azimuth: float = 0.0, increment: float = 0.05, max_dist: int = 200, tile: int = TILE) -> Raster:
    """Distance towards ``azimuth`` to the first cell that is higher than the cell by ``increment`` for each unit of distance.

    Negative (the distance looked at) where there is none within ``max_dist`` cells or before the data ends.
    """
    return _one(dem, max_dist, lambda z: relief.fetch(z, azimuth, increment, max_dist), tile)


def exposure_towards_wind_flux(dem: Raster, azimuth: float = 0.0, max_dist: int = 50, tile: int = TILE) -> Raster:
    """cos(slope) · sin(H) + sin(slope) · cos(H) · cos(azimuth - aspect), with H the horizon angle towards the wind below the level."""
    return _one(dem, max_dist, lambda z: relief.wind_exposure(z, azimuth, max_dist), tile)


def geomorphons(dem: Raster, search: int = 50, threshold: float = 0.0, skip: int = 0, forms: bool = True, tile: int = TILE) -> Raster:
    """Landform 1 to 10 by the eight lines of sight, or the number of the ternary pattern."""
    return _one(dem, search, lambda z: relief.geomorphons(z, search, threshold, skip, forms), tile)


def time_in_daylight(dem: Raster, latitude: float, az_step: float = 10.0, max_dist: int = 100, days: Sequence[int] = tuple(range(1, 366, 15)), hours: Sequence[float] = tuple(np.arange(0, 24, 0.5)), tile: int = TILE) -> Raster:
    """Share of the time the sun is up in which a cell is not in the shadow of the relief (solar time)."""
    sun = relief.sun_positions(latitude, days, hours)
    return _one(dem, max_dist, lambda z: relief.daylight(z, sun, az_step, max_dist), tile)


def viewshed(dem: Raster, stations: DataFrame, height: float = 2.0, max_dist: int = 100, tile: int = TILE) -> Raster:
    """How many stations (row, col), each ``height`` above ground, see a cell at most ``max_dist`` cells away.

    The stations are collected; more than MOST are refused, as a table that does not fit the tasks.
    """
    seen = [(r["row"], r["col"]) for r in stations.select("row", "col").distinct().limit(MOST + 1).collect()]
    if len(seen) > MOST:
        raise ValueError(f"more than {MOST} stations")
    return by_tile(dem, max_dist, lambda z, at: {"z": relief.seen_from(z, [(r - at[0], c - at[1]) for r, c in seen], height, max_dist)}, "row int, col int, z double", tile=tile)


MOST = 10_000


def visibility_index(dem: Raster, height: float = 2.0, step: int = 2, max_dist: int = 50, tile: int = TILE) -> Raster:
    """Share of the cells within ``max_dist``, sampled every ``step`` cells, that are visible from ``height`` above each cell."""
    return _one(dem, max_dist, lambda z: relief.visibility(z, height, step, max_dist), tile)
