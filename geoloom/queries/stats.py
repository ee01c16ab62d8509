"""Queries of statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.operators import stats as op
from geoloom.queries.base import bands, local, neighbours_sql, off, points, raster, register, tidy, tidy_sql, with_inputs

RC = '"row", "col"'
_PAIR = "p AS (SELECT a.z AS a, b.z AS b FROM {0} a JOIN {1} b ON a.\"row\" = b.\"row\" AND a.\"col\" = b.\"col\" WHERE a.z IS NOT NULL AND b.z IS NOT NULL)"


def rounded(df: DataFrame, digits: int = 5) -> DataFrame:
    return df.select(*[(F.round(F.col(c) + off(digits), digits) if t == "double" else F.col(c)).alias(c) for c, t in df.dtypes])


def _r(expr: str, name: str, digits: int = 5) -> str:
    return f"round(CAST({expr} AS DOUBLE) + {off(digits)}, {digits}) AS {name}"


def stat(name: str, fn, sql: str, *inputs: str, more: str = "", digits: int = 5) -> None:
    register(f"stats_{name}", lambda s, d: rounded(fn(s, d), digits), with_inputs(sql, *inputs, more=more) if sql else None)


stat("raster_summary_stats", lambda s, d: op.summary(raster(s, d, "dem_gappy")), f"SELECT count(z) AS n, {_r('min(z)', 'minimum', 3)}, {_r('max(z)', 'maximum', 3)}, {_r('avg(z)', 'mean', 3)}, {_r('stddev_pop(z)', 'stdev', 3)}, {_r('sum(z)', 'total', 3)} FROM dem_gappy", "dem_gappy", digits=3)
stat(
    "zonal_statistics",
    lambda s, d: op.zonal_statistics(raster(s, d, "dem"), raster(s, d, "zones")),
    f"SELECT CAST(round(b) AS BIGINT) AS zone, count(*) AS n, {_r('avg(a)', 'mean', 3)}, {_r('median(a)', 'median', 3)}, {_r('min(a)', 'minimum', 3)}, {_r('max(a)', 'maximum', 3)}, {_r('max(a) - min(a)', '\"range\"', 3)}, {_r('coalesce(stddev_samp(a), 0)', 'stdev', 3)}, {_r('sum(a)', 'total', 3)} FROM p GROUP BY 1",
    "dem", "zones", more=_PAIR.format("dem", "zones"), digits=3,
)
local("math_z_scores", "dem", op.z_scores, f"SELECT {RC}, (z - avg(z) OVER ()) / stddev_pop(z) OVER () AS z FROM dem")
_HIST = "h AS (SELECT z, CAST(least({0} - 1, floor((z - lo) / (hi - lo) * {0})) AS INT) AS bin, lo, hi, \"row\", \"col\" FROM (SELECT *, min(z) OVER () AS lo, max(z) OVER () AS hi FROM dem) x)"
stat("raster_histogram", lambda s, d: op.histogram(raster(s, d, "dem"), 40), f"SELECT bin, {_r('lo + bin * (hi - lo) / 40', 'low')}, count(*) AS n FROM h GROUP BY bin, lo, hi", "dem", more=_HIST.format(40))
stat("attribute_histogram", lambda s, d: op.histogram(points(s, d), 25), f"SELECT bin, {_r('lo + bin * (hi - lo) / 25', 'low')}, count(*) AS n FROM h GROUP BY bin, lo, hi", "points", more=_HIST.format(25).replace("FROM dem", "FROM points").replace(', "row", "col"', ""))
_CDF = ", c AS (SELECT bin, sum(count(*)) OVER (ORDER BY bin) / sum(count(*)) OVER () AS cdf FROM h GROUP BY bin)"
for _name, _fn, _bins, _value in (
    ("math_cumulative_distribution", op.cumulative_distribution, 50_000, "cdf"),
    ("math_quantiles", op.quantiles, 10_000, "least(4.0, floor(cdf * 5))"),
    ("image_histogram_equalization", op.histogram_equalization, 1024, "floor(cdf * 255)"),
):
    register(_name, lambda s, d, f=_fn: tidy(f(raster(s, d, "dem"))), with_inputs(tidy_sql(f"SELECT {RC}, {_value} AS z FROM h JOIN c USING (bin)"), "dem", more=_HIST.format(_bins) + _CDF))
_STRETCH = "least(greatest(floor((z - lo) / (hi - lo) * 256), 0), 255)"
for _name, _fn, _lo, _hi in (
    ("min_max", lambda r: op.min_max_contrast_stretch(r, 20000.0, 90000.0), "20000.0", "90000.0"),
    ("standard_deviation", op.stdev_contrast_stretch, "greatest(avg(z) OVER () - 2 * stddev_pop(z) OVER (), min(z) OVER ())", "least(avg(z) OVER () + 2 * stddev_pop(z) OVER (), max(z) OVER ())"),
    ("percentage", lambda r: op.percentage_contrast_stretch(r, 2.0), "quantile_cont(z, 0.02) OVER ()", "quantile_cont(z, 0.98) OVER ()"),
):
    local(f"image_{_name}_contrast_stretch", "dem", _fn, f"SELECT {RC}, {_STRETCH} AS z FROM (SELECT *, {_lo} AS lo, {_hi} AS hi FROM dem) x")
local("image_sigmoidal_contrast_stretch", "dem", lambda r: op.sigmoidal_contrast_stretch(r, 0.3, 2.0), f"SELECT {RC}, floor((1 / (1 + exp(2.0 * (0.3 - p))) - 1 / (1 + exp(0.6))) / (1 / (1 + exp(2.0 * (0.3 - 1))) - 1 / (1 + exp(0.6))) * 255 + 1e-9) AS z FROM (SELECT *, (z - min(z) OVER ()) / (max(z) OVER () - min(z) OVER ()) AS p FROM dem) x")
local("image_gamma_correction", "unit", op.gamma_correction, f"SELECT {RC}, power(z, 0.5) AS z FROM unit")
_OTSU = ", g AS (SELECT bin, count(*) AS n FROM h GROUP BY 1), k AS (SELECT bin, sum(n) OVER (ORDER BY bin) AS w0, sum(n * bin) OVER (ORDER BY bin) AS s0, sum(n) OVER () AS n, sum(n * bin) OVER () AS s FROM g), cut AS (SELECT arg_min(bin, {'a': -(w0 * (n - w0) * power(s0 / w0 - (s - s0) / (n - w0), 2)), 'b': bin}) AS cut FROM k WHERE w0 < n)"
register("plugin_otsu_thresholding", lambda s, d: tidy(op.otsu(raster(s, d, "dem"))), with_inputs(tidy_sql(f"SELECT {RC}, CASE WHEN bin > cut THEN 1.0 ELSE 0.0 END AS z FROM h, cut"), "dem", more=_HIST.format(256) + _OTSU))
stat("list_unique_values_raster", lambda s, d: op.unique_values(raster(s, d, "zones")), "SELECT z AS value, count(*) AS n FROM zones GROUP BY 1", "zones")
stat("list_unique_values", lambda s, d: op.unique_values(points(s, d), "cls"), "SELECT cls AS value, count(*) AS n FROM points GROUP BY 1", "points")
stat("cross_tabulation", lambda s, d: op.cross_tabulation(raster(s, d, "zones"), raster(s, d, "flags2")), "SELECT CAST(a AS BIGINT) AS class1, CAST(b AS BIGINT) AS class2, count(*) AS n FROM p GROUP BY 1, 2", "zones", "flags2", more=_PAIR.format("zones", "flags2"))
stat(
    "kappa_index",
    lambda s, d: op.kappa_index(raster(s, d, "flags"), raster(s, d, "flags2")),
    f"SELECT n, {_r('same / n', 'agreement')}, {_r('(same - e) / (n - e)', 'kappa')} FROM (SELECT count(*) AS n, count(*) FILTER (a = b) AS same, (SELECT sum(r.n * c.n) FROM (SELECT a, count(*) AS n FROM p GROUP BY 1) r JOIN (SELECT b, count(*) AS n FROM p GROUP BY 1) c ON a = b) / count(*) AS e FROM p) x",
    "flags", "flags2", more=_PAIR.format("flags", "flags2"),
)
stat("root_mean_square_error", lambda s, d: op.root_mean_square_error(raster(s, d, "dem_gappy"), raster(s, d, "dem")).drop("le90"), f"SELECT count(*) AS n, {_r('avg(b - a)', 'mean')}, {_r('sqrt(avg(power(b - a, 2)))', 'rmse')}, {_r('sqrt(avg(power(b - a, 2))) * 1.96', 'at95')} FROM p", "dem_gappy", "dem", more=_PAIR.format("dem_gappy", "dem"))
stat("image_correlation", lambda s, d: op.image_correlation([raster(s, d, "dem"), raster(s, d, "dem2"), raster(s, d, "dem_gappy")]), f"SELECT 1 AS i, 0 AS j, {_r('corr(a.z, b.z)', 'r')} FROM j UNION ALL SELECT 2, 0, {_r('corr(a.z, c.z)', 'r')} FROM j WHERE c.z IS NOT NULL UNION ALL SELECT 2, 1, {_r('corr(b.z, c.z)', 'r')} FROM j WHERE c.z IS NOT NULL", "dem", "dem2", "dem_gappy", more='j AS (SELECT a, b, c FROM dem a JOIN dem2 b ON a."row" = b."row" AND a."col" = b."col" JOIN dem_gappy c ON a."row" = c."row" AND a."col" = c."col")')
stat("image_regression", lambda s, d: op.image_regression(raster(s, d, "dem"), raster(s, d, "dem2")), f"SELECT count(*) AS n, {_r('regr_slope(b, a)', 'slope', 8)}, {_r('regr_intercept(b, a)', 'intercept', 8)}, {_r('regr_r2(b, a)', 'r2', 8)} FROM p", "dem", "dem2", more=_PAIR.format("dem", "dem2"), digits=8)
stat("paired_sample_t_test", lambda s, d: op.paired_t_test(raster(s, d, "flags"), raster(s, d, "flags2")), f"SELECT count(*) AS n, {_r('avg(b - a)', 'mean')}, {_r('stddev_samp(b - a)', 'stdev')}, {_r('avg(b - a) / (stddev_samp(b - a) / sqrt(count(*)))', 't')} FROM p", "flags", "flags2", more=_PAIR.format("flags", "flags2"))
stat("wilcoxon_signed_rank_test", lambda s, d: op.wilcoxon(raster(s, d, "zones"), raster(s, d, "dem2")), f"SELECT CAST(count(*) AS BIGINT) AS n, sum(sign(v) * rk) AS w, {_r('sum(sign(v) * rk) / sqrt(count(*) * (count(*) + 1.0) * (2.0 * count(*) + 1) / 6)', 'z')} FROM (SELECT v, rank() OVER (ORDER BY abs(v)) + (count(*) OVER (PARTITION BY abs(v)) - 1) / 2.0 AS rk FROM (SELECT b - a AS v FROM p WHERE b <> a) q) x", "zones", "dem2", more=_PAIR.format("zones", "dem2"))
stat(
    "anova",
    lambda s, d: op.anova(raster(s, d, "dem2"), raster(s, d, "zones")),
    f"SELECT {_r('sum(n * power(m - g, 2))', 'ssb')}, {_r('sum(w)', 'ssw')}, count(*) - 1 AS df1, CAST(sum(n) AS BIGINT) - count(*) AS df2, {_r('sum(n * power(m - g, 2)) / (count(*) - 1) / (sum(w) / (sum(n) - count(*)))', 'f')} FROM (SELECT b, count(*) AS n, avg(a) AS m, var_pop(a) * count(*) AS w, (SELECT avg(a) FROM p) AS g FROM p GROUP BY 1) x",
    "dem2", "zones", more=_PAIR.format("dem2", "zones"),
)
stat("two_sample_ks_test", lambda s, d: op.two_sample_ks(raster(s, d, "dem"), raster(s, d, "dem_gappy")), f"SELECT {_r('max(abs(x - y))', 'd')} FROM (SELECT sum(sum(x)) OVER (ORDER BY z) / sum(sum(x)) OVER () AS x, sum(sum(y)) OVER (ORDER BY z) / sum(sum(y)) OVER () AS y FROM (SELECT z, 1.0 AS x, 0.0 AS y FROM dem UNION ALL SELECT z, 0.0, 1.0 FROM dem_gappy WHERE z IS NOT NULL) u GROUP BY z) q", "dem", "dem_gappy")
stat("ks_test_for_normality", lambda s, d: op.ks_normality(raster(s, d, "dem")), "")
stat("crispness_index", lambda s, d: op.crispness_index(raster(s, d, "unit")), f"SELECT {_r('sum(power(z - m, 2))', 'ss')}, {_r('sum(power(z - m, 2)) / (sum(z) * power(1 - any_value(m), 2) + (count(*) - sum(z)) * power(any_value(m), 2))', 'crispness')} FROM (SELECT z, avg(z) OVER () AS m FROM unit) x", "unit")
stat(
    "image_autocorrelation",
    lambda s, d: op.morans_i(raster(s, d, "dem2"), "king"),
    f"SELECT count(*) AS n, {_r('any_value(m)', 'mean')}, {_r('count(*) / sum(k) * sum(dev * x) / sum(dev * dev)', 'i')}, {_r('-1.0 / (count(*) - 1)', 'expected')} FROM (SELECT m, z - m AS dev, len(v) AS k, list_sum(list_transform(v, lambda t: t - m)) AS x FROM (SELECT z, avg(z) OVER () AS m, list_filter(n[1:4] || n[6:9], lambda t: t IS NOT NULL) AS v FROM nb) a) b",
    "dem2", more=neighbours_sql("dem2", 1),
)
register("math_trend_surface", lambda s, d: tidy(op.trend_surface(raster(s, d, "dem"), 1).join(raster(s, d, "dem").filter("z IS NOT NULL").select("row", "col"), ["row", "col"]), digits=3), None)
stat("principal_component_analysis", lambda s, d: op.principal_components(bands(s, d), 3).drop("loadings"), "")
register("image_k_means_clustering", lambda s, d: tidy(op.k_means(bands(s, d).filter("band < 3"), 3, 4)), None)
local("math_random_field", "dem", op.random_field, None)
local("math_random_sample", "dem", op.random_sample, None)
register("gis_raster_area", lambda s, d: raster(s, d, "zones").filter("z IS NOT NULL").groupBy(F.col("z").cast("long").alias("zone")).agg(F.count(F.lit(1)).alias("n")), with_inputs("SELECT CAST(z AS BIGINT) AS zone, count(*) AS n FROM zones GROUP BY 1", "zones"))
register("gis_centroid", lambda s, d: rounded(raster(s, d, "zones").filter("z > 0").groupBy("z").agg(F.avg("row").alias("row"), F.avg("col").alias("col"))), with_inputs(f"SELECT z, {_r('avg(\"row\")', '\"row\"')}, {_r('avg(\"col\")', '\"col\"')} FROM zones WHERE z > 0 GROUP BY 1", "zones"))
register(
    "gis_radius_of_gyration",
    lambda s, d: rounded(raster(s, d, "zones").filter("z > 0").groupBy("z").agg(F.sqrt(F.var_pop("row") + F.var_pop("col")).alias("radius"))),
    with_inputs(f"SELECT z, {_r('sqrt(var_pop(\"row\") + var_pop(\"col\"))', 'radius')} FROM zones WHERE z > 0 GROUP BY 1", "zones"),
)
register("gis_find_lowest_or_highest_points", lambda s, d: raster(s, d, "dem").filter("z IS NOT NULL").orderBy(F.desc("z"), "row", "col").limit(1), with_inputs(f"SELECT {RC}, z FROM dem ORDER BY z DESC, 1, 2 LIMIT 1", "dem"))
