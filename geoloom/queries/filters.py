"""Queries of moving-window filters."""

from __future__ import annotations

from geoloom.functions import kernels as k
from geoloom.operators import filters as op
from geoloom.queries.base import local, neighbours_sql, raster, register, tidy, tidy_sql, window_sql, with_inputs

RC = '"row", "col"'


def _window(name: str, fn, sql: str, source: str = "dem", x: int = 11, y: int = 11, also: str = "", digits: int = 4) -> None:
    """``sql``: an aggregate over w (row, col, z, v)."""
    register(f"image_{name}", lambda s, d: tidy(fn(raster(s, d, source)), digits=digits), with_inputs(tidy_sql(f"SELECT {RC}, {sql} AS z FROM w GROUP BY {RC}, w.z HAVING w.z IS NOT NULL", digits=digits), source, more=window_sql(source, y // 2, x // 2) + also))


_window("mean_filter", op.mean_filter, "avg(v)", "dem_gappy", 3, 3)
_window("mean_filter_rectangular", lambda r: op.mean_filter(r, 9, 5), "avg(v)", "dem", 9, 5)
_window("total_filter", op.total_filter, "sum(v)")
_window("maximum_filter", op.maximum_filter, "max(v)", "dem_gappy")
_window("minimum_filter", op.minimum_filter, "min(v)", "dem_gappy")
_window("range_filter", op.range_filter, "max(v) - min(v)")
_window("standard_deviation_filter", op.standard_deviation_filter, "stddev_pop(v)", digits=2)
_window("high_pass_filter", op.high_pass_filter, "w.z - avg(v)")
_window("adaptive_filter", op.adaptive_filter, "CASE WHEN stddev_pop(v) > 0 AND abs(w.z - avg(v)) / stddev_pop(v) > 2.0 THEN avg(v) ELSE w.z END")
_window("olympic_filter", op.olympic_filter, "CASE WHEN count(v) > 2 THEN (sum(v) - max(v) - min(v)) / (count(v) - 2) ELSE avg(v) END")
_window("median_filter", op.median_filter, "median(v)", "dem_gappy")
_window("high_pass_median_filter", op.high_pass_median_filter, "w.z - median(v)")
_window("percentile_filter", op.percentile_filter, "100.0 * count(*) FILTER (v < w.z) / count(*)")
_window("diversity_filter", op.diversity_filter, "count(DISTINCT v)::DOUBLE", "zones")
_window("edge_preserving_mean_filter", lambda r: op.edge_preserving_mean_filter(r, 11, 5000.0), "avg(v) FILTER (abs(v - w.z) <= 5000.0)")
_window("lee_sigma_filter", lambda r: op.lee_sigma_filter(r, 11, 11, 2000.0, 5), "CASE WHEN count(*) FILTER (abs(v - w.z) <= 2000.0) > 5 THEN avg(v) FILTER (abs(v - w.z) <= 2000.0) ELSE avg(v) FILTER (abs(dr) <= 1 AND abs(dc) <= 1 AND (dr <> 0 OR dc <> 0)) END")
_window("conservative_smoothing_filter", op.conservative_smoothing_filter, "least(greatest(w.z, min(v) FILTER (dr <> 0 OR dc <> 0)), max(v) FILTER (dr <> 0 OR dc <> 0))", x=3, y=3)
register(
    "image_majority_filter",
    lambda s, d: tidy(op.majority_filter(raster(s, d, "zones"), 7, 7)),
    with_inputs(tidy_sql(f"SELECT {RC}, min(v) AS z FROM (SELECT {RC}, v, rank() OVER (PARTITION BY {RC} ORDER BY count(*) DESC) AS k FROM w WHERE w.z IS NOT NULL GROUP BY {RC}, v) q WHERE k = 1 GROUP BY {RC}"), "zones", more=window_sql("zones", 3, 3)),
)
register(
    "image_k_nearest_mean_filter",
    lambda s, d: tidy(op.k_nearest_mean_filter(raster(s, d, "dem"), 7, 7, 5), digits=4),
    with_inputs(tidy_sql(f"SELECT {RC}, avg(v) AS z FROM (SELECT {RC}, v, row_number() OVER (PARTITION BY {RC} ORDER BY abs(v - z), v) AS k FROM w WHERE z IS NOT NULL) q WHERE k <= 5 GROUP BY {RC}", digits=4), "dem", more=window_sql("dem", 3, 3)),
)


def _stage(first: str, second: str, source: str = "dem", reach: int = 5) -> str:
    near = lambda t: f'b."row" BETWEEN a."row" - {reach} AND a."row" + {reach} AND b."col" BETWEEN a."col" - {reach} AND a."col" + {reach}'
    return (
        f'e AS (SELECT a."row", a."col", {first}(b.z) AS z FROM {source} a JOIN {source} b ON {near(0)} WHERE a.z IS NOT NULL GROUP BY 1, 2), '
        f'f AS (SELECT a."row", a."col", {second}(b.z) AS z FROM e a JOIN e b ON {near(0)} GROUP BY 1, 2)'
    )


register("image_opening", lambda s, d: tidy(op.opening(raster(s, d, "dem"))), with_inputs(tidy_sql("SELECT * FROM f"), "dem", more=_stage("min", "max")))
register("image_closing", lambda s, d: tidy(op.closing(raster(s, d, "dem"))), with_inputs(tidy_sql("SELECT * FROM f"), "dem", more=_stage("max", "min")))
register("image_tophat_transform", lambda s, d: tidy(op.tophat(raster(s, d, "dem"))), with_inputs(tidy_sql('SELECT f."row", f."col", d.z - f.z AS z FROM f JOIN dem d ON d."row" = f."row" AND d."col" = f."col"'), "dem", more=_stage("min", "max")))
register("image_tophat_transform_black", lambda s, d: tidy(op.tophat(raster(s, d, "dem"), white=False)), with_inputs(tidy_sql('SELECT f."row", f."col", f.z - d.z AS z FROM f JOIN dem d ON d."row" = f."row" AND d."col" = f."col"'), "dem", more=_stage("max", "min")))


def _sum(kernel, fill: bool, at: str = "n[{}]") -> str:
    terms = [f"coalesce({at.format(i + 1)}, {'z' if fill else '0.0'}) * ({w!r})" for i, w in enumerate(kernel) if w]
    return "(" + " + ".join(terms) + ")"


def _weights(kernel) -> str:
    return "(" + " + ".join(f"CASE WHEN n[{i + 1}] IS NULL THEN 0.0 ELSE {w!r} END" for i, w in enumerate(kernel) if w) + ")"


def _kernel(name: str, fn, sql: str, reach: int, source: str = "dem", digits: int = 4) -> None:
    register(f"image_{name}", lambda s, d: tidy(fn(raster(s, d, source)), digits=digits), with_inputs(tidy_sql(f"SELECT {RC}, {sql} AS z FROM nb WHERE z IS NOT NULL", digits=digits), source, more=neighbours_sql(source, reach)))


def _mean(kernel) -> str:
    return f"{_sum(kernel, False)} / {_weights(kernel)}"


_G, _L = k.gaussian(0.75), k.laplacian_of_gaussian(0.75)
_kernel("gaussian_filter", op.gaussian_filter, _mean(_G), k.reach(0.75), "dem_gappy")
_kernel("high_sigma_gaussian_filter", lambda r: op.gaussian_filter(r, 1.5), _mean(k.gaussian(1.5)), k.reach(1.5))
_kernel("unsharp_masking", op.unsharp_masking, f"z + (z - {_mean(_G)})", k.reach(0.75))
_kernel("laplacian_of_gaussian_filter", op.laplacian_of_gaussian_filter, _sum(_L, True), k.reach(0.75))
for _v, _w in k.LAPLACIAN.items():
    _kernel(f"laplacian_filter_{_v.replace('(', '_').replace(')', '')}", lambda r, v=_v: op.laplacian_filter(r, v), _sum(_w, True), int(len(_w) ** 0.5) // 2)
for _v, _w in k.EMBOSS.items():
    _kernel(f"emboss_filter_{_v}", lambda r, v=_v: op.emboss_filter(r, v), _sum(_w, True), 1)
for _v, _w in k.LINES.items():
    _kernel(f"line_detection_filter_{_v}", lambda r, v=_v: op.line_detection_filter(r, v), _sum(_w, True), 1)
for _name, _fn, _x, _y in (("sobel", op.sobel_filter, k.SOBEL_X, k.SOBEL_Y), ("prewitt", op.prewitt_filter, k.PREWITT_X, k.PREWITT_Y), ("scharr", op.scharr_filter, k.SCHARR_X, k.SCHARR_Y)):
    _kernel(f"{_name}_filter", _fn, f"sqrt(power({_sum(_x, True)}, 2) + power({_sum(_y, True)}, 2))", 1, "dem_gappy")
_kernel("roberts_cross_filter", op.roberts_cross_filter, "abs(z - coalesce(n[9], z)) + abs(coalesce(n[6], z) - coalesce(n[8], z))", 1)
_kernel("user_defined_weights_filter", lambda r: op.user_defined_weights_filter(r, [1, 2, 1, 2, 4, 2, 1, 2, 1], True), _mean([1, 2, 1, 2, 4, 2, 1, 2, 1]), 1, "dem_gappy")
_SI = 20000.0
_BI = [f"({w!r} * exp(-power(n[{i + 1}] - z, 2) / {2 * _SI * _SI}))" for i, w in enumerate(_G)]
_BILATERAL = "(" + " + ".join(f"coalesce({b} * n[{i + 1}], 0.0)" for i, b in enumerate(_BI)) + ") / (" + " + ".join(f"coalesce({b}, 0.0)" for b in _BI) + ")"
_kernel("bilateral_filter", lambda r: op.bilateral_filter(r, 0.75, _SI), _BILATERAL, k.reach(0.75))
_kernel("high_pass_bilateral_filter", lambda r: op.high_pass_bilateral_filter(r, 0.75, _SI), f"z - {_BILATERAL}", k.reach(0.75))
register(
    "image_diff_of_gaussian_filter",
    lambda s, d: tidy(op.difference_of_gaussian_filter(raster(s, d, "dem"), 0.75, 1.5), digits=4),
    with_inputs(tidy_sql(f'SELECT a."row", a."col", a.z - b.z AS z FROM (SELECT {RC}, {_mean(_G).replace("n[", "n1[")} AS z FROM (SELECT {RC}, z, n AS n1 FROM nb) x) a JOIN (SELECT {RC}, {_mean(k.gaussian(1.5))} AS z FROM nb2) b ON a."row" = b."row" AND a."col" = b."col"', digits=4), "dem", more=neighbours_sql("dem", k.reach(0.75)) + ", " + neighbours_sql("dem", k.reach(1.5)).replace("o AS", "o2 AS").replace("nb AS", "nb2 AS").replace("CROSS JOIN o ", "CROSS JOIN o2 o ")),
)
local("image_fast_almost_gaussian_filter", "dem", op.fast_almost_gaussian_filter, None)
