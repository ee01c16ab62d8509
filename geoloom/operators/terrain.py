"""Land-surface parameters of a digital elevation model (row, col, z)."""

from __future__ import annotations

from math import pi, sqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom.functions.grids import AROUND
from geoloom.functions.kernels import DX, DXX, DXY, DYY, DY
from geoloom.operators.filters import mean, std, stats
from geoloom.plans.stencil import focal, neighbourhood

Raster = DataFrame


def derivatives(dem: Raster, resolution: float = 1.0, z_factor: float = 1.0) -> DataFrame:
    """row, col, z and p, q, r, s, t: derivatives of x, y, xx, xy and yy of a polynomial over 5x5 cells.

    The cell's value stands in for missing neighbours; NoData cells stay, with NULLs.
    """
    n = neighbourhood(dem, 2)
    at = [F.coalesce(F.get("n", F.lit(i)), F.col("z")) * z_factor for i in range(25)]

    def total(kernel: list[int], by: float) -> Column:
        return F.when(F.col("z").isNotNull(), sum((at[i] * float(w) for i, w in enumerate(kernel) if w), F.lit(0.0)) / by)

    g, g2 = resolution, resolution * resolution
    return n.select("row", "col", "z", total(DX, 420 * g).alias("p"), total(DY, 420 * g).alias("q"), total(DXX, 35 * g2).alias("r"), total(DXY, 100 * g2).alias("s"), total(DYY, 35 * g2).alias("t"))


#: name: expression of p, q, r, s and t.
SURFACE = {
    "slope": "degrees(atan(sqrt(p * p + q * q)))",
    "aspect": "CASE WHEN p = 0 AND q = 0 THEN CAST(-1 AS DOUBLE) WHEN p = 0 THEN CASE WHEN q > 0 THEN CAST(180 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END ELSE 180 - degrees(atan(q / p)) + 90 * sign(p) END",
    "plan_curvature": "CASE WHEN p * p + q * q > 0 THEN -(q * q * r - 2 * p * q * s + p * p * t) / sqrt(power(p * p + q * q, 3)) ELSE CAST(0 AS DOUBLE) END",
    "profile_curvature": "CASE WHEN p * p + q * q > 0 THEN -(p * p * r + 2 * p * q * s + q * q * t) / ((p * p + q * q) * sqrt(power(1 + p * p + q * q, 3))) ELSE CAST(0 AS DOUBLE) END",
    "tangential_curvature": "CASE WHEN p * p + q * q > 0 THEN -(q * q * r - 2 * p * q * s + p * p * t) / ((p * p + q * q) * sqrt(1 + p * p + q * q)) ELSE CAST(0 AS DOUBLE) END",
    "total_curvature": "r * r + 2 * s * s + t * t",
    "mean_curvature": "-((1 + q * q) * r - 2 * p * q * s + (1 + p * p) * t) / (2 * sqrt(power(1 + p * p + q * q, 3)))",
    "gaussian_curvature": "(r * t - s * s) / power(1 + p * p + q * q, 2)",
}
SURFACE["minimal_curvature"] = f"({SURFACE['mean_curvature']}) - sqrt(greatest(0.0, power({SURFACE['mean_curvature']}, 2) - {SURFACE['gaussian_curvature']}))"
SURFACE["maximal_curvature"] = f"({SURFACE['mean_curvature']}) + sqrt(greatest(0.0, power({SURFACE['mean_curvature']}, 2) - {SURFACE['gaussian_curvature']}))"
#: Direction that a cell faces, in radians.
FACING = f"CASE WHEN p <> 0 THEN {pi} - atan(q / p) + {pi / 2} * sign(p) ELSE {pi} END"


def _valid(value: Column) -> Column:
    return F.when(F.col("z").isNotNull(), value).alias("z")


def surface(dem: Raster, name: str, resolution: float = 1.0, z_factor: float = 1.0) -> Raster:
    """A parameter of :data:`SURFACE`."""
    return derivatives(dem, resolution, z_factor).select("row", "col", _valid(F.expr(SURFACE[name])))


def slope(dem: Raster, units: str = "degrees", resolution: float = 1.0, z_factor: float = 1.0) -> Raster:
    d = derivatives(dem, resolution, z_factor)
    tan = F.sqrt(F.col("p") * F.col("p") + F.col("q") * F.col("q"))
    return d.select("row", "col", {"degrees": F.degrees(F.atan(tan)), "radians": F.atan(tan), "percent": tan * 100}.get(units, tan).alias("z"))


def light(azimuth: float, altitude: float) -> str:
    """Illumination (0 to 1) as an expression of p and q."""
    from math import cos, radians, sin

    tan = "greatest(sqrt(p * p + q * q), 0.00017)"
    return f"greatest(0.0, ({tan}) / sqrt(1 + power({tan}, 2)) * ({sin(radians(altitude))!r} / ({tan}) - {cos(radians(altitude))!r} * sin({radians(azimuth - 90)!r} - ({FACING}))))"


def hillshade(dem: Raster, azimuth: float = 315.0, altitude: float = 30.0, z_factor: float = 1.0) -> Raster:
    """Illumination of 0 to 32767."""
    return derivatives(dem, z_factor=z_factor).select("row", "col", _valid(F.round(F.expr(light(azimuth, altitude)) * 32767)))


#: Weights of the azimuths of a multidirectional hillshade.
MULTI = {225.0: 0.1, 270.0: 0.4, 315.0: 0.4, 360.0: 0.1}


def multidirectional_hillshade(dem: Raster, altitude: float = 45.0) -> Raster:
    value = sum((F.expr(light(a, altitude)) * w for a, w in MULTI.items()), F.lit(0.0))
    return derivatives(dem).select("row", "col", _valid(F.round(value * 32767)))


def relative_aspect(dem: Raster, azimuth: float = 0.0) -> Raster:
    """Degrees between a cell's aspect and ``azimuth``; -1 where flat."""
    a = surface(dem, "aspect")
    gap = F.abs(F.col("z") - azimuth) % 360
    return a.select("row", "col", F.when(F.col("z") < 0, -1.0).when(gap > 180, 360 - gap).otherwise(gap).alias("z"))


# neighbours


def _around(dem: Raster, value) -> Raster:
    """value(list of (neighbour, distance)) on every cell with a value."""
    n = neighbourhood(dem)
    near = [(F.get("n", F.lit(i)), sqrt(dr * dr + dc * dc)) for dr, dc, i in AROUND]
    return n.select("row", "col", _valid(value(near).cast("double")))


def _count(near, test) -> Column:
    return sum((F.when(test(v), 1).otherwise(0) for v, _ in near), F.lit(0))


def num_downslope_neighbours(dem: Raster) -> Raster:
    return _around(dem, lambda near: _count(near, lambda v: v < F.col("z")))


def num_upslope_neighbours(dem: Raster) -> Raster:
    return _around(dem, lambda near: _count(near, lambda v: v > F.col("z")))


def find_no_flow_cells(dem: Raster) -> Raster:
    """1 where no neighbour is lower."""
    return _around(dem, lambda near: F.when(_count(near, lambda v: v < F.col("z")) == 0, 1.0))


def ruggedness_index(dem: Raster) -> Raster:
    """Root mean square difference to the neighbours."""
    n = lambda near: _count(near, lambda v: v.isNotNull())
    squares = lambda near: sum((F.coalesce((v - F.col("z")) * (v - F.col("z")), F.lit(0.0)) for v, _ in near), F.lit(0.0))
    return _around(dem, lambda near: F.when(n(near) > 0, F.sqrt(squares(near) / n(near))))


def _steepest(near, sign: int, least: bool = False) -> Column:
    """Rise (or drop) to the neighbour with the steepest (or gentlest) slope; the first on a tie."""
    ends = [F.struct(((v - F.col("z")) * sign / d * (1 if least else -1)).alias("k"), F.lit(i).alias("i"), ((v - F.col("z")) * sign).alias("dz")) for i, (v, d) in enumerate(near)]
    ok = F.filter(F.array(*ends), lambda s: (s["dz"] >= 0) if least else (s["dz"] > 0))
    return F.coalesce(F.array_min(ok)["dz"], F.lit(0.0))


def max_downslope_elev_change(dem: Raster) -> Raster:
    return _around(dem, lambda near: _steepest(near, -1))


def min_downslope_elev_change(dem: Raster) -> Raster:
    return _around(dem, lambda near: _steepest(near, -1, True))


def max_upslope_elev_change(dem: Raster) -> Raster:
    return _around(dem, lambda near: _steepest(near, 1))


def fill_single_cell_pits(dem: Raster) -> Raster:
    """Cells below all neighbours rise to the lowest of them."""
    low = lambda near: F.least(*[v for v, _ in near])
    return _around(dem, lambda near: F.when(F.col("z") < low(near), low(near)).otherwise(F.col("z")))


def find_ridges(dem: Raster) -> Raster:
    """1 where the neighbours to either side, along a row or a column, are lower."""
    n = neighbourhood(dem)
    at = lambda i: F.get("n", F.lit(i))
    ridge = ((at(1) < F.col("z")) & (at(7) < F.col("z"))) | ((at(3) < F.col("z")) & (at(5) < F.col("z")))
    return n.filter(F.col("z").isNotNull()).select("row", "col", F.when(ridge, 1.0).otherwise(0.0).alias("z"))


def pennock_landform_class(dem: Raster, slope: float = 3.0, prof: float = 0.1, plan: float = 0.0, resolution: float = 1.0) -> Raster:
    """Seven hillslope classes of slope, profile and plan curvature (3x3, degrees).

    1 convergent footslope, 2 divergent footslope, 3 convergent shoulder, 4 divergent shoulder,
    5 convergent backslope, 6 divergent backslope, 7 level; steep cells that fit none have no class.
    """
    n = neighbourhood(dem).filter(F.col("z").isNotNull())
    ne, e, se, s, sw, w, nw, no = (F.coalesce(F.get("n", F.lit(i)), F.col("z")) for _, _, i in AROUND)
    g = resolution
    n = n.select("row", "col", ((e - w) / (2 * g)).alias("zx"), ((no - s) / (2 * g)).alias("zy"), ((e - 2 * F.col("z") + w) / (g * g)).alias("zxx"), ((no - 2 * F.col("z") + s) / (g * g)).alias("zyy"), ((-nw + ne + sw - se) / (4 * g * g)).alias("zxy"), ((nw - sw + 2 * (no - s) + ne - se) / (8 * g)).alias("fy"), ((se - sw + 2 * (e - w) + ne - nw) / (8 * g)).alias("fx"))
    n = n.withColumn("p", F.expr("zx * zx + zy * zy"))
    n = n.select("row", "col", "p", F.expr("degrees(atan(sqrt(fx * fx + fy * fy)))").alias("sl"), *[F.expr(f"CASE WHEN p > 0 THEN {x} END").alias(k) for k, x in (("pl", PENNOCK_PLAN), ("pr", PENNOCK_PROF))])
    value = F.expr(PENNOCK.format(slope=slope, prof=prof, plan=plan))
    return n.select("row", "col", value.alias("z"))


PENNOCK_PLAN = "-degrees((zxx * zy * zy - 2 * zxy * zx * zy + zyy * zx * zx) / (p * power(p + 1, 1.5)))"
PENNOCK_PROF = "-degrees((zxx * zx * zx + 2 * zxy * zx * zy + zyy * zy * zy) / (p * power(p + 1, 1.5)))"
PENNOCK = (
    "CASE WHEN p <= 0 THEN 7.0 WHEN pr < -{prof} AND pl <= -{plan} AND sl > {slope} THEN 1.0 WHEN pr < -{prof} AND pl > {plan} AND sl > {slope} THEN 2.0 "
    "WHEN pr > {prof} AND pl <= {plan} AND sl > {slope} THEN 3.0 WHEN pr > {prof} AND pl > {plan} AND sl > {slope} THEN 4.0 "
    "WHEN pr >= -{prof} AND pr < {prof} AND sl > {slope} AND pl <= -{plan} THEN 5.0 WHEN pr >= -{prof} AND pr < {prof} AND sl > {slope} AND pl > {plan} THEN 6.0 WHEN sl <= {slope} THEN 7.0 END"
)

#: The eight triangles around a cell by their outer corners (places in the 3x3 array).
TRIANGLES = [(0, 1), (1, 2), (2, 5), (5, 8), (8, 7), (7, 6), (6, 3), (3, 0)]


def surface_area_ratio(dem: Raster, resolution: float = 1.0) -> Raster:
    """Area of the eight facets from a cell half way to its neighbours over their planar area; facets with NoData are left out."""
    n = neighbourhood(dem).filter(F.col("z").isNotNull())
    at = [F.get("n", F.lit(i)) for i in range(9)]
    g = resolution

    def area(i: int, j: int) -> Column:
        side = lambda a, b, d: F.sqrt((a - b) * (a - b) + d * d) / 2
        far = lambda k: g * sqrt(2) if k in (0, 2, 6, 8) else g
        a, b, c = side(F.col("z"), at[i], far(i)), side(F.col("z"), at[j], far(j)), side(at[i], at[j], g)
        h = (a + b + c) / 2
        return F.sqrt(F.greatest(F.lit(0.0), h * (h - a) * (h - b) * (h - c)))

    facets = F.filter(F.array(*[F.when(at[i].isNotNull() & at[j].isNotNull(), area(i, j)) for i, j in TRIANGLES]), lambda x: x.isNotNull())
    return n.select("row", "col", facets.alias("f")).filter("size(f) > 0").select("row", "col", (F.aggregate("f", F.lit(0.0), lambda x, y: x + y) / (g * g * F.size("f") / 8)).alias("z"))


# windows


def _focal(dem: Raster, x: int, y: int, value: Column) -> Raster:
    return stats(dem, x, y).select("row", "col", _valid(value))


def dev_from_mean_elev(dem: Raster, x: int = 11, y: int = 11) -> Raster:
    return _focal(dem, x, y, F.when(std() > 0, (F.col("z") - mean()) / std()).otherwise(0.0))


def diff_from_mean_elev(dem: Raster, x: int = 11, y: int = 11) -> Raster:
    return _focal(dem, x, y, F.col("z") - mean())


def percent_elev_range(dem: Raster, x: int = 3, y: int = 3) -> Raster:
    span = F.col("hi") - F.col("lo")
    return _focal(dem, x, y, F.when(span > 0, (F.col("z") - F.col("lo")) / span * 100).otherwise(0.0))


def relative_topographic_position(dem: Raster, x: int = 11, y: int = 11) -> Raster:
    value = F.when(F.col("z") < mean(), (F.col("z") - mean()) / (mean() - F.col("lo"))).when(F.col("z") > mean(), (F.col("z") - mean()) / (F.col("hi") - mean())).otherwise(0.0)
    return _focal(dem, x, y, value)


def standard_deviation_of_slope(dem: Raster, x: int = 11, y: int = 11) -> Raster:
    return _focal(slope(dem), x, y, std())


def scale_sweep(dem: Raster, scales: list[int], value: Column, by: Column) -> DataFrame:
    """row, col, z, scale: of one value for each window size (2·scale+1) the one with the largest ``by``; the first on a tie."""
    out = None
    for r in scales:
        one = stats(dem, 2 * r + 1, 2 * r + 1).filter(F.col("z").isNotNull()).select("row", "col", value.alias("v"), F.lit(r).alias("scale"))
        out = one if out is None else out.union(one)
    key = F.struct(-by.cast("double"), F.col("scale"), F.col("v"))
    best = out.groupBy("row", "col").agg(F.min(key).alias("k"))
    return best.select("row", "col", F.col("k.v").alias("z"), F.col("k.scale").cast("double").alias("scale"))


def max_elevation_deviation(dem: Raster, scales: list[int]) -> DataFrame:
    return scale_sweep(dem, scales, F.when(std() > 0, (F.col("z") - mean()) / std()).otherwise(0.0), F.abs("v"))


def max_difference_from_mean(dem: Raster, scales: list[int]) -> DataFrame:
    return scale_sweep(dem, scales, F.col("z") - mean(), F.abs("v"))


def max_elev_dev_signature(dem: Raster, sites: DataFrame, scales: list[int]) -> DataFrame:
    """site, scale, z: the deviation of each site (site, row, col) at each scale."""
    out = None
    for r in scales:
        one = dev_from_mean_elev(dem, 2 * r + 1, 2 * r + 1).join(sites, ["row", "col"]).select("site", F.lit(r).alias("scale"), "z")
        out = one if out is None else out.union(one)
    return out


def normals(dem: Raster) -> DataFrame:
    """row, col, z and the unit normal nx, ny, nz of each cell."""
    d = derivatives(dem)
    size = F.sqrt(F.col("p") * F.col("p") + F.col("q") * F.col("q") + 1)
    return d.select("row", "col", "z", (-F.col("p") / size).alias("nx"), (-F.col("q") / size).alias("ny"), (1 / size).alias("nz"))


def _mean_normal(dem: Raster, size: int) -> DataFrame:
    r = max(size, 3) // 2
    return focal(normals(dem), r, r, {k: F.col(c) for k, c in (("sx", "nx"), ("sy", "ny"), ("sz", "nz"))} | {"n": F.when(F.col("z").isNotNull(), 1)}, {}, {})


def spherical_std_dev_of_normals(dem: Raster, size: int = 11) -> Raster:
    """Angular spread of the normals, degrees."""
    mean = F.sqrt(F.col("sx") * F.col("sx") + F.col("sy") * F.col("sy") + F.col("sz") * F.col("sz")) / F.col("n")
    return _mean_normal(dem, size).select("row", "col", _valid(F.degrees(F.sqrt(F.greatest(F.lit(0.0), -2 * F.log(mean))))))


def circular_variance_of_aspect(dem: Raster, size: int = 11) -> Raster:
    """1 less the length of the mean direction of the slopes."""
    d = derivatives(dem)
    flat = F.sqrt(F.col("p") * F.col("p") + F.col("q") * F.col("q"))
    unit = d.select("row", "col", "z", *[F.when(flat > 0, F.col(c) / flat).when(flat == 0, 0.0).alias(k) for c, k in (("p", "ux"), ("q", "uy"))])
    r = max(size, 3) // 2
    f = focal(unit, r, r, {"sx": F.col("ux"), "sy": F.col("uy"), "n": F.when(F.col("z").isNotNull(), 1)}, {}, {})
    return f.select("row", "col", _valid(1 - F.sqrt(F.col("sx") * F.col("sx") + F.col("sy") * F.col("sy")) / F.col("n")))


def elev_relative_to_min_max(dem: Raster) -> Raster:
    span = dem.agg(F.min("z").alias("lo"), F.max("z").alias("hi"))  # one row
    return dem.crossJoin(F.broadcast(span)).select("row", "col", ((F.col("z") - F.col("lo")) / (F.col("hi") - F.col("lo")) * 100).alias("z"))


def elev_relative_to_watershed_min_max(dem: Raster, watersheds: Raster) -> Raster:
    j = dem.join(watersheds.select("row", "col", F.col("z").alias("basin")), ["row", "col"])
    span = j.filter("basin IS NOT NULL").groupBy("basin").agg(F.min("z").alias("lo"), F.max("z").alias("hi"))
    return j.join(span, "basin").select("row", "col", F.when(F.col("hi") > F.col("lo"), (F.col("z") - F.col("lo")) / (F.col("hi") - F.col("lo")) * 100).otherwise(0.0).alias("z"))


def hypsometric_analysis(dem: Raster, bins: int = 100) -> DataFrame:
    """bin, elevation, percent: share of the area at or above each of ``bins`` levels."""
    span = dem.agg(F.min("z").alias("lo"), F.max("z").alias("hi"))
    b = F.least(F.lit(bins - 1), F.floor((F.col("z") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins)).cast("int")
    counts = dem.filter(F.col("z").isNotNull()).crossJoin(F.broadcast(span)).groupBy(b.alias("bin"), "lo", "hi").agg(F.count(F.lit(1)).alias("n"))  # ``bins`` rows
    from pyspark.sql import Window

    above = F.sum("n").over(Window.orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum("n").over(Window.partitionBy())
    return counts.select("bin", (F.col("lo") + F.col("bin") * (F.col("hi") - F.col("lo")) / bins).alias("elevation"), (100.0 * above / total).alias("percent"))


def slope_vs_elevation(dem: Raster, bins: int = 100) -> DataFrame:
    """bin, n, slope: mean slope by elevation."""
    s = slope(dem).select("row", "col", F.col("z").alias("slope"))
    span = dem.agg(F.min("z").alias("lo"), F.max("z").alias("hi"))
    b = F.least(F.lit(bins - 1), F.floor((F.col("z") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins)).cast("int")
    return dem.filter(F.col("z").isNotNull()).join(s, ["row", "col"]).crossJoin(F.broadcast(span)).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("slope").alias("slope"))


def convergence_index(dem: Raster) -> Raster:
    """Mean angle between the neighbours' aspects and their direction to the cell, less 90: -90 where all converge."""
    from math import atan2, degrees

    from geoloom.functions.grids import AROUND

    n = neighbourhood(surface(dem, "aspect"))
    gaps = []
    for dr, dc, at in AROUND:
        towards = degrees(atan2(-dc, dr)) % 360  # compass direction from the neighbour to the cell
        a = F.get("n", F.lit(at))
        gaps.append(F.when(a >= 0, F.abs(F.pmod(a - towards + 180, F.lit(360.0)) - 180)))
    known = F.filter(F.array(*gaps), lambda g: g.isNotNull())
    mean = F.aggregate(known, F.lit(0.0), lambda s, g: s + g) / F.nullif(F.size(known), F.lit(0))
    return n.select("row", "col", F.when(F.col("z").isNotNull(), F.coalesce(mean - 90, F.lit(0.0))).alias("z"))


def profile(lines: DataFrame, dem: Raster, step: float = 1.0) -> DataFrame:
    """fid, distance, z: the cell under each line every ``step`` units (x from col, y from row)."""
    from pyspark.sql import Window

    from geoloom.operators.vector import segments

    w = Window.partitionBy("fid").orderBy("k")
    s = segments(lines).withColumn("d", F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))).filter("d > 0")
    s = s.withColumn("b", F.sum("d").over(w)).withColumn("a", F.col("b") - F.col("d"))
    at = s.withColumn("i", F.explode(F.sequence(F.ceil(F.col("a") / step), F.ceil(F.col("b") / step)))).withColumn("distance", F.col("i") * step).filter("distance >= a AND distance < b")
    t = (F.col("distance") - F.col("a")) / F.col("d")
    cells = at.select("fid", "distance", F.floor(F.col("y1") + t * (F.col("y2") - F.col("y1"))).cast("int").alias("row"), F.floor(F.col("x1") + t * (F.col("x2") - F.col("x1"))).cast("int").alias("col"))
    return cells.join(dem, ["row", "col"]).select("fid", "distance", "z")
