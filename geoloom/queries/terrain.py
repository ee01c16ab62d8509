"""Queries of land-surface parameters."""

from __future__ import annotations

from pyspark.sql import functions as F

from geoloom.functions import kernels as k
from geoloom.operators import terrain as op
from geoloom.operators.filters import percentile_filter
from geoloom.queries.base import local2, neighbours_sql, raster, register, tidy, tidy_sql, window_sql, with_inputs

RC = '"row", "col"'


def _total(kernel, by: float) -> str:
    return "(" + " + ".join(f"coalesce(n[{i + 1}], z) * ({float(w)!r})" for i, w in enumerate(kernel) if w) + f") / {by}"


DERIVED = neighbours_sql("dem", 2) + f', d AS (SELECT {RC}, z, {_total(k.DX, 420.0)} AS p, {_total(k.DY, 420.0)} AS q, {_total(k.DXX, 35.0)} AS r, {_total(k.DXY, 100.0)} AS s, {_total(k.DYY, 35.0)} AS t FROM nb WHERE z IS NOT NULL)'


def _low(s, d):
    """The model at a scale where curvatures are not all nil."""
    return raster(s, d, "dem").withColumn("z", F.col("z") / 10000.0)


LOW = "dem0 AS (SELECT \"row\", \"col\", z / 10000.0 AS z FROM dem), " + DERIVED.replace("FROM dem a", "FROM dem0 a").replace("JOIN dem b", "JOIN dem0 b")


def _derived(name: str, fn, sql: str, digits: int = 4) -> None:
    register(f"terrain_{name}", lambda s, d: tidy(fn(_low(s, d)), digits=digits), with_inputs(tidy_sql(f"SELECT {RC}, {sql} AS z FROM d", digits=digits), "dem", more=LOW))


for _name, _sql in op.SURFACE.items():
    _derived(_name, lambda r, n=_name: op.surface(r, n), _sql)
_derived("slope_percent", lambda r: op.slope(r, "percent"), "100 * sqrt(p * p + q * q)")
_derived("hillshade", op.hillshade, f"round({op.light(315.0, 30.0)} * 32767)", 0)
_derived("multidirectional_hillshade", op.multidirectional_hillshade, "round((" + " + ".join(f"{op.light(a, 45.0)} * {w}" for a, w in op.MULTI.items()) + ") * 32767)", 0)
_ASPECT = op.SURFACE["aspect"]
_derived("relative_aspect", lambda r: op.relative_aspect(r, 30.0), f"CASE WHEN {_ASPECT} < 0 THEN -1 WHEN abs({_ASPECT} - 30) % 360 > 180 THEN 360 - abs({_ASPECT} - 30) % 360 ELSE abs({_ASPECT} - 30) % 360 END")

#: n[1] to n[9] by name, in the order of the operators' neighbours.
AT = [i + 1 for _, _, i in op.AROUND]
DIST = [1.4142135623730951 if i % 2 == 0 else 1.0 for i in range(8)]


def _near(name: str, fn, sql: str, source: str = "dem", kind: str = "terrain", digits: int = 4) -> None:
    register(f"{kind}_{name}", lambda s, d: tidy(fn(raster(s, d, source)), digits=digits), with_inputs(tidy_sql(f"SELECT {RC}, {sql} AS z FROM nb WHERE z IS NOT NULL", digits=digits), source, more=neighbours_sql(source, 1)))


def _any(test: str) -> str:
    return "(" + " + ".join(f"CASE WHEN n[{i}] {test} THEN 1.0 ELSE 0.0 END" for i in AT) + ")"


_near("num_downslope_neighbours", op.num_downslope_neighbours, _any("< z"))
_near("num_upslope_neighbours", op.num_upslope_neighbours, _any("> z"), "dem_gappy")
_near("find_no_flow_cells", op.find_no_flow_cells, f"CASE WHEN {_any('< z')} = 0 THEN 1.0 END", kind="hydro")
_SQ = " + ".join(f"coalesce(power(n[{i}] - z, 2), 0.0)" for i in AT)
_near("ruggedness_index", op.ruggedness_index, f"CASE WHEN {_any('IS NOT NULL')} > 0 THEN sqrt(({_SQ}) / {_any('IS NOT NULL')}) END", "dem_gappy")


def _steep(sign: str, least: bool) -> str:
    parts = ", ".join(f"{{'k': ({sign}) * {'' if least else '-1.0 *'} (n[{i}] - z) / {d}, 'i': {j}, 'dz': ({sign}) * (n[{i}] - z)}}" for j, (i, d) in enumerate(zip(AT, DIST, strict=True)))
    return f"coalesce(list_min(list_filter([{parts}], lambda s: s.dz {'>= 0' if least else '> 0'})).dz, 0.0)"


_near("max_downslope_elev_change", op.max_downslope_elev_change, _steep("-1.0", False))
_near("min_downslope_elev_change", op.min_downslope_elev_change, _steep("-1.0", True))
_near("max_upslope_elev_change", op.max_upslope_elev_change, _steep("1.0", False))
_MIN = f"least({', '.join(f'n[{i}]' for i in AT)})"
_near("fill_single_cell_pits", op.fill_single_cell_pits, f"CASE WHEN z < {_MIN} THEN {_MIN} ELSE z END", kind="hydro")
_near("find_ridges", op.find_ridges, "CASE WHEN (n[2] < z AND n[8] < z) OR (n[4] < z AND n[6] < z) THEN 1.0 ELSE 0.0 END")
_side = lambda a, b, d: f"sqrt(power(({a}) - ({b}), 2) + {d * d!r}) / 2"
_c = lambda i: f"n[{i + 1}]"


def _area(i: int, j: int) -> str:
    far = lambda m: 2**0.5 if m in (0, 2, 6, 8) else 1.0
    a, b, c = _side("z", _c(i), far(i)), _side("z", _c(j), far(j)), _side(_c(i), _c(j), 1.0)
    h = f"(({a} + {b} + {c}) / 2)"
    return f"CASE WHEN {_c(i)} IS NOT NULL AND {_c(j)} IS NOT NULL THEN sqrt(greatest(0.0, {h} * ({h} - {a}) * ({h} - {b}) * ({h} - {c}))) END"


register("terrain_surface_area_ratio", lambda s, d: tidy(op.surface_area_ratio(_low(s, d)), digits=4), with_inputs(tidy_sql(f"SELECT {RC}, list_sum(f) / (count_f / 8.0) AS z FROM (SELECT {RC}, f, len(list_filter(f, lambda x: x IS NOT NULL)) AS count_f FROM (SELECT {RC}, [{', '.join(_area(i, j) for i, j in op.TRIANGLES)}] AS f FROM nb WHERE z IS NOT NULL) g) h WHERE count_f > 0", digits=4), "dem", more="dem0 AS (SELECT \"row\", \"col\", z / 10000.0 AS z FROM dem), " + neighbours_sql("dem0", 1)))
_ne, _e, _se, _s, _sw, _w, _nw, _no = (f"coalesce(n[{i}], z)" for i in AT)
_PEN = (
    f"pen AS (SELECT {RC}, ({_e} - {_w}) / 2 AS zx, ({_no} - {_s}) / 2 AS zy, {_e} - 2 * z + {_w} AS zxx, {_no} - 2 * z + {_s} AS zyy, ({_ne} - {_nw} + {_sw} - {_se}) / 4 AS zxy, "
    f"({_nw} - {_sw} + 2 * ({_no} - {_s}) + {_ne} - {_se}) / 8 AS fy, ({_se} - {_sw} + 2 * ({_e} - {_w}) + {_ne} - {_nw}) / 8 AS fx FROM nb WHERE z IS NOT NULL), "
    f"pen2 AS (SELECT *, zx * zx + zy * zy AS p FROM pen), pen3 AS (SELECT {RC}, p, degrees(atan(sqrt(fx * fx + fy * fy))) AS sl, CASE WHEN p > 0 THEN {op.PENNOCK_PLAN} END AS pl, CASE WHEN p > 0 THEN {op.PENNOCK_PROF} END AS pr FROM pen2)"
)
register("terrain_pennock_landform_class", lambda s, d: tidy(op.pennock_landform_class(_low(s, d))), with_inputs(tidy_sql(f"SELECT {RC}, {op.PENNOCK.format(slope=3.0, prof=0.1, plan=0.0)} AS z FROM pen3"), "dem", more="dem0 AS (SELECT \"row\", \"col\", z / 10000.0 AS z FROM dem), " + neighbours_sql("dem0", 1) + ", " + _PEN))


def _window(name: str, fn, sql: str, size: int = 11, source: str = "dem", digits: int = 4) -> None:
    register(f"terrain_{name}", lambda s, d: tidy(fn(raster(s, d, source)), digits=digits), with_inputs(tidy_sql(f"SELECT {RC}, {sql} AS z FROM w GROUP BY {RC}, w.z HAVING w.z IS NOT NULL", digits=digits), source, more=window_sql(source, size // 2, size // 2)))


_window("dev_from_mean_elev", op.dev_from_mean_elev, "CASE WHEN stddev_pop(v) > 0 THEN (w.z - avg(v)) / stddev_pop(v) ELSE 0 END")
_window("diff_from_mean_elev", op.diff_from_mean_elev, "w.z - avg(v)", source="dem_gappy")
_window("percent_elev_range", op.percent_elev_range, "CASE WHEN max(v) > min(v) THEN (w.z - min(v)) / (max(v) - min(v)) * 100 ELSE 0 END", 3)
_window("relative_topographic_position", op.relative_topographic_position, "CASE WHEN w.z < avg(v) THEN (w.z - avg(v)) / (avg(v) - min(v)) WHEN w.z > avg(v) THEN (w.z - avg(v)) / (max(v) - avg(v)) ELSE 0 END")
_window("elev_percentile", percentile_filter, "100.0 * count(*) FILTER (v < w.z) / count(*)")

_SCALES = [1, 2, 4]
_SWEEP = lambda value: ", ".join(f"w{r} AS (SELECT {RC}, {value} AS v, {r} AS scale FROM w WHERE abs(dr) <= {r} AND abs(dc) <= {r} AND z IS NOT NULL GROUP BY {RC}, z)" for r in _SCALES) + ", sweep AS (" + " UNION ALL ".join(f"SELECT * FROM w{r}" for r in _SCALES) + ")"
for _name, _fn, _v in (("max_elevation_deviation", op.max_elevation_deviation, "CASE WHEN stddev_pop(v) > 0 THEN (z - avg(v)) / stddev_pop(v) ELSE 0 END"), ("max_difference_from_mean", op.max_difference_from_mean, "z - avg(v)")):
    register(
        f"terrain_{_name}",
        lambda s, d, f=_fn: tidy(f(raster(s, d, "dem"), _SCALES), "z", "scale", digits=3),
        with_inputs(tidy_sql(f"SELECT {RC}, arg_max(v, abs(v)) AS z, arg_max(scale, abs(v)) AS scale FROM sweep GROUP BY {RC}", "z", "scale", digits=3), "dem", more=window_sql("dem", 4, 4) + ", " + _SWEEP(_v)),
    )
register(
    "terrain_max_elev_dev_signature",
    lambda s, d: op.max_elev_dev_signature(raster(s, d, "dem"), s.range(0, 50, 9).selectExpr("id AS site", "CAST(id AS INT) AS row", "CAST(49 - id AS INT) AS col"), _SCALES).select("site", "scale", (F.round("z", 4) + 0.0).alias("z")),
    with_inputs(f'SELECT i AS site, scale, round(v, 4) + 0.0 AS z FROM range(0, 50, 9) g(i) JOIN sweep ON "row" = i AND "col" = 49 - i', "dem", more=window_sql("dem", 4, 4) + ", " + _SWEEP("CASE WHEN stddev_pop(v) > 0 THEN (z - avg(v)) / stddev_pop(v) ELSE 0 END")),
)
_NORM = f"u AS (SELECT {RC}, -p / sqrt(p * p + q * q + 1) AS nx, -q / sqrt(p * p + q * q + 1) AS ny, 1 / sqrt(p * p + q * q + 1) AS nz, CASE WHEN p * p + q * q > 0 THEN p / sqrt(p * p + q * q) ELSE 0 END AS ux, CASE WHEN p * p + q * q > 0 THEN q / sqrt(p * p + q * q) ELSE 0 END AS uy, degrees(atan(sqrt(p * p + q * q))) AS sl FROM d), un AS (SELECT a.\"row\", a.\"col\", b.* EXCLUDE (\"row\", \"col\") FROM u a JOIN u b ON abs(a.\"row\" - b.\"row\") <= 5 AND abs(a.\"col\" - b.\"col\") <= 5)"
for _name, _fn, _v in (
    ("spherical_std_dev_of_normals", op.spherical_std_dev_of_normals, "degrees(sqrt(greatest(0.0, -2 * ln(sqrt(power(sum(nx), 2) + power(sum(ny), 2) + power(sum(nz), 2)) / count(*)))))"),
    ("circular_variance_of_aspect", op.circular_variance_of_aspect, "1 - sqrt(power(sum(ux), 2) + power(sum(uy), 2)) / count(*)"),
    ("standard_deviation_of_slope", op.standard_deviation_of_slope, "stddev_pop(sl)"),
):
    register(f"terrain_{_name}", lambda s, d, f=_fn: tidy(f(_low(s, d)), digits=4), with_inputs(tidy_sql(f"SELECT {RC}, {_v} AS z FROM un GROUP BY {RC}", digits=4), "dem", more=LOW + ", " + _NORM))

register("terrain_elev_relative_to_min_max", lambda s, d: tidy(op.elev_relative_to_min_max(raster(s, d, "dem"))), with_inputs(tidy_sql(f"SELECT {RC}, (z - min(z) OVER ()) / (max(z) OVER () - min(z) OVER ()) * 100 AS z FROM dem"), "dem"))
local2("terrain_elev_relative_to_watershed_min_max", "dem", "zones", op.elev_relative_to_watershed_min_max, f"SELECT {RC}, coalesce((a - min(a) OVER g) / nullif(max(a) OVER g - min(a) OVER g, 0) * 100, 0) AS z FROM p WINDOW g AS (PARTITION BY b)")
register(
    "terrain_hypsometric_analysis",
    lambda s, d: op.hypsometric_analysis(raster(s, d, "dem")).select("bin", F.round("elevation", 4).alias("elevation"), F.round("percent", 6).alias("percent")),
    with_inputs("SELECT bin, round(lo + bin * (hi - lo) / 100, 4) AS elevation, round(100.0 * sum(n) OVER (ORDER BY bin DESC) / sum(n) OVER (), 6) AS percent FROM (SELECT CAST(least(99, floor((z - lo) / (hi - lo) * 100)) AS INT) AS bin, lo, hi, count(*) AS n FROM (SELECT z, min(z) OVER () AS lo, max(z) OVER () AS hi FROM dem) x GROUP BY 1, 2, 3) y", "dem"),
)
register(
    "terrain_slope_vs_elevation_plot",
    lambda s, d: op.slope_vs_elevation(_low(s, d)).select("bin", "n", F.round("slope", 4).alias("slope")),
    with_inputs("SELECT CAST(least(99, floor((z - lo) / (hi - lo) * 100)) AS INT) AS bin, count(*) AS n, round(avg(sl), 4) AS slope FROM (SELECT z, min(z) OVER () AS lo, max(z) OVER () AS hi, degrees(atan(sqrt(p * p + q * q))) AS sl FROM d) x GROUP BY 1", "dem", more=LOW),
)
