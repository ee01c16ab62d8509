"""Statistics of rasters and attribute tables: aggregates, tests and models.

Everything is one or two aggregations; what reaches the driver are a few sums.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from math import erf, sqrt

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoloom.functions.cells import quotient
from geoloom.operators.local import pair
from geoloom.plans.ranking import running

Raster = DataFrame


def summary(raster: Raster) -> DataFrame:
    """n, minimum, maximum, mean, stdev (population) and total of the valid cells."""
    z = F.col("z")
    return raster.agg(F.count(z).alias("n"), F.min(z).alias("minimum"), F.max(z).alias("maximum"), F.avg(z).alias("mean"), F.stddev_pop(z).alias("stdev"), F.sum(z).alias("total"))


def zonal_statistics(raster: Raster, zones: Raster) -> DataFrame:
    """zone, n, mean, median, minimum, maximum, range, stdev (sample, 0 for one cell) and total of each zone."""
    j = pair(raster, zones).filter("a IS NOT NULL AND b IS NOT NULL")
    a = F.col("a")
    return j.groupBy(F.round("b").cast("long").alias("zone")).agg(F.count(a).alias("n"), F.avg(a).alias("mean"), F.percentile(a, 0.5).alias("median"), F.min(a).alias("minimum"), F.max(a).alias("maximum"), (F.max(a) - F.min(a)).alias("range"), F.coalesce(F.stddev_samp(a), F.lit(0.0)).alias("stdev"), F.sum(a).alias("total"))


def z_scores(raster: Raster) -> Raster:
    s = raster.agg(F.avg("z").alias("m"), F.stddev_pop("z").alias("s"))  # one row
    return raster.crossJoin(F.broadcast(s)).select("row", "col", ((F.col("z") - F.col("m")) / F.col("s")).alias("z"))


def histogram(values: DataFrame, bins: int, value: str = "z") -> DataFrame:
    """bin, low, n of ``bins`` equal intervals between the least and the largest value."""
    span = values.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    b = F.when(F.col("hi") > F.col("lo"), F.least(F.lit(bins - 1), F.floor((F.col(value) - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins))).otherwise(0).cast("int")
    h = values.filter(F.col(value).isNotNull()).crossJoin(F.broadcast(span))
    return h.groupBy(b.alias("bin"), (F.col("lo") + b * (F.col("hi") - F.col("lo")) / bins).alias("low")).agg(F.count(F.lit(1)).alias("n"))


def _with_cdf(raster: Raster, bins: int) -> DataFrame:
    """Cells with lo, hi, bin and cdf: the share of cells in their bin or below."""
    span = raster.agg(F.min("z").alias("lo"), F.max("z").alias("hi"))
    b = F.when(F.col("hi") > F.col("lo"), F.least(F.lit(bins - 1), F.floor((F.col("z") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins))).otherwise(0).cast("int")
    cells = raster.filter("z IS NOT NULL").crossJoin(F.broadcast(span)).withColumn("bin", b)
    counts = cells.groupBy("bin").agg(F.count(F.lit(1)).alias("n"))  # ``bins`` rows at most
    below = F.sum("n").over(Window.orderBy("bin")) / F.sum("n").over(Window.partitionBy())
    return cells.join(F.broadcast(counts.select("bin", below.alias("cdf"))), "bin")


def cumulative_distribution(raster: Raster, bins: int = 50_000) -> Raster:
    return _with_cdf(raster, bins).select("row", "col", F.col("cdf").alias("z"))


def quantiles(raster: Raster, n: int = 5, bins: int = 10_000) -> Raster:
    """The quantile (from 0) of each cell."""
    return _with_cdf(raster, bins).select("row", "col", F.least(F.lit(n - 1), F.floor(F.col("cdf") * n)).cast("double").alias("z"))


def histogram_equalization(raster: Raster, tones: int = 256, bins: int = 1024) -> Raster:
    return _with_cdf(raster, bins).select("row", "col", F.floor(F.col("cdf") * (tones - 1)).cast("double").alias("z"))


def contrast_stretch(raster: Raster, low: Column, high: Column, tones: int = 256) -> Raster:
    """Linear stretch of low..high (expressions over one row of aggregates of z) to 0..tones - 1."""
    ends = raster.agg(low.alias("lo"), high.alias("hi"))
    part = (F.col("z") - F.col("lo")) / (F.col("hi") - F.col("lo"))
    tone = F.least(F.greatest(F.floor(part * tones), F.lit(0)), F.lit(tones - 1)) + F.lit(0.0)
    return raster.crossJoin(F.broadcast(ends)).select("row", "col", F.when(F.col("z").isNotNull(), tone).alias("z"))  # least and greatest skip NULL


def min_max_contrast_stretch(raster: Raster, low: float, high: float, tones: int = 256) -> Raster:
    return contrast_stretch(raster, F.first(F.lit(low)), F.first(F.lit(high)), tones)


def stdev_contrast_stretch(raster: Raster, stdev: float = 2.0, tones: int = 256) -> Raster:
    m, s = F.avg("z"), F.stddev_pop("z")
    return contrast_stretch(raster, F.greatest(m - stdev * s, F.min("z")), F.least(m + stdev * s, F.max("z")), tones)


def percentage_contrast_stretch(raster: Raster, clip: float = 1.0, tones: int = 256) -> Raster:
    return contrast_stretch(raster, F.percentile("z", clip / 100), F.percentile("z", 1 - clip / 100), tones)


def sigmoidal_contrast_stretch(raster: Raster, cutoff: float = 0.0, gain: float = 1.0, tones: int = 256) -> Raster:
    ends = raster.agg(F.min("z").alias("lo"), F.max("z").alias("hi"))
    a = 1 / (1 + np.exp(gain * cutoff))
    b = 1 / (1 + np.exp(gain * (cutoff - 1))) - a
    part = (F.col("z") - F.col("lo")) / (F.col("hi") - F.col("lo"))
    s = 1 / (1 + F.exp(gain * (cutoff - part)))
    return raster.crossJoin(F.broadcast(ends)).select("row", "col", F.floor((s - float(a)) / float(b) * (tones - 1) + 1e-9).cast("double").alias("z"))


def gamma_correction(raster: Raster, gamma: float = 0.5) -> Raster:
    return raster.select("row", "col", F.pow("z", F.lit(gamma)).alias("z"))


def otsu(raster: Raster, bins: int = 256) -> Raster:
    """1 above the threshold that parts the values into two classes with the most variance between them, else 0."""
    h = histogram(raster, bins)
    w = Window.orderBy("bin")
    every = Window.partitionBy()
    h = h.select("bin", F.sum("n").over(w).alias("w0"), F.sum(F.col("n") * F.col("bin")).over(w).alias("s0"), F.sum("n").over(every).alias("n"), F.sum(F.col("n") * F.col("bin")).over(every).alias("s"))
    gap = F.col("s0") / F.col("w0") - (F.col("s") - F.col("s0")) / (F.col("n") - F.col("w0"))
    best = h.filter("w0 < n").withColumn("v", F.col("w0") * (F.col("n") - F.col("w0")) * gap * gap).agg(F.min_by("bin", F.struct(-F.col("v"), F.col("bin"))).alias("cut"))
    span = raster.agg(F.min("z").alias("lo"), F.max("z").alias("hi"))
    b = F.least(F.lit(bins - 1), F.floor((F.col("z") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins))
    return raster.crossJoin(F.broadcast(span)).crossJoin(F.broadcast(best)).select("row", "col", F.when(F.col("z").isNotNull(), b > F.col("cut")).cast("double").alias("z"))  # least skips NULL


def unique_values(values: DataFrame, value: str = "z") -> DataFrame:
    return values.filter(F.col(value).isNotNull()).groupBy(F.col(value).alias("value")).agg(F.count(F.lit(1)).alias("n"))


# two rasters


def cross_tabulation(a: Raster, b: Raster) -> DataFrame:
    """class1, class2, n of the rounded values."""
    return pair(a, b).filter("a IS NOT NULL AND b IS NOT NULL").groupBy(F.round("a").cast("long").alias("class1"), F.round("b").cast("long").alias("class2")).agg(F.count(F.lit(1)).alias("n"))


def kappa_index(a: Raster, b: Raster) -> DataFrame:
    """n, agreement (share of equal classes) and kappa."""
    t = cross_tabulation(a, b)
    rows, cols = t.groupBy("class1").agg(F.sum("n").alias("r")), t.groupBy("class2").agg(F.sum("n").alias("c"))
    chance = rows.join(cols, F.col("class1") == F.col("class2")).agg(F.coalesce(F.sum(F.col("r") * F.col("c")), F.lit(0)).alias("rc"))
    total = t.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("class1") == F.col("class2"), F.col("n")).otherwise(0)).alias("same"))
    e = F.col("rc") / F.col("n")
    return total.crossJoin(chance).select("n", (F.col("same") / F.col("n")).alias("agreement"), ((F.col("same") - e) / (F.col("n") - e)).alias("kappa"))


def root_mean_square_error(raster: Raster, base: Raster) -> DataFrame:
    """n, mean, rmse, at95 (1.96 rmse) and le90 (the |difference| at place ⌊0.9 n⌋) of base less raster."""
    d = pair(raster, base).select((F.col("b") - F.col("a")).alias("d")).filter("d IS NOT NULL")
    n = d.agg(F.count("d").alias("n"), F.avg("d").alias("mean"), F.sqrt(F.avg(F.col("d") * F.col("d"))).alias("rmse"))
    le = d.agg(F.percentile_approx(F.abs("d"), F.lit(0.9), F.lit(1_000_000)).alias("le90"))
    return n.crossJoin(le).select("n", "mean", "rmse", (F.col("rmse") * 1.96).alias("at95"), "le90")


def _corr(a: Column, b: Column) -> Column:
    """Pearson's r of columns that are NULL together; Spark's own makes an error of columns that do not vary, here r is NaN."""
    return quotient(F.covar_pop(a, b), F.sqrt(F.var_pop(a) * F.var_pop(b)))


def image_correlation(rasters: Sequence[Raster]) -> DataFrame:
    """i, j, r: Pearson's r of each pair of rasters over their jointly valid cells; NaN if one of them does not vary there."""
    named = [r.select("row", "col", F.col("z").alias(f"z{i}")) for i, r in enumerate(rasters)]
    j = reduce(lambda a, b: a.join(b, ["row", "col"]), named)
    pairs = [(a, b) for a in range(len(rasters)) for b in range(a)]
    both = lambda a, b: F.when(F.col(f"z{a}").isNotNull() & F.col(f"z{b}").isNotNull(), F.col(f"z{a}"))
    row = j.agg(*[_corr(both(a, b), both(b, a)).alias(f"r{a}_{b}") for a, b in pairs])
    return row.select(F.explode(F.array(*[F.struct(F.lit(a).alias("i"), F.lit(b).alias("j"), F.col(f"r{a}_{b}").alias("r")) for a, b in pairs])).alias("x")).select("x.*")


def image_regression(x: Raster, y: Raster) -> DataFrame:
    """n, slope, intercept and r2 of y on x."""
    p = pair(x, y).filter("a IS NOT NULL AND b IS NOT NULL")
    return p.agg(F.count(F.lit(1)).alias("n"), F.regr_slope("b", "a").alias("slope"), F.regr_intercept("b", "a").alias("intercept"), F.regr_r2("b", "a").alias("r2"))


def paired_t_test(a: Raster, b: Raster) -> DataFrame:
    """n, mean, stdev and t of the differences b - a."""
    d = pair(a, b).select((F.col("b") - F.col("a")).alias("d")).filter("d IS NOT NULL")
    return d.agg(F.count("d").alias("n"), F.avg("d").alias("mean"), F.stddev_samp("d").alias("stdev")).withColumn("t", F.col("mean") / (F.col("stdev") / F.sqrt("n")))


def wilcoxon(a: Raster, b: Raster) -> DataFrame:
    """n, w (sum of signed average ranks of |b - a|, zeros left out) and z."""
    d = pair(a, b).select((F.col("b") - F.col("a")).alias("d")).filter("d <> 0")
    by = d.groupBy(F.abs("d").alias("k")).agg(F.count(F.lit(1)).alias("c"), F.sum(F.signum("d")).alias("s"))
    rank = F.col("upto") - F.col("c") + (F.col("c") + 1) / 2
    w = running(by, [F.col("k")], {"upto": F.col("c")}).select((rank * F.col("s")).alias("w"), "c").agg(F.sum("w").alias("w"), F.sum("c").alias("n"))
    return w.select("n", "w", (F.col("w") / F.sqrt(F.col("n") * (F.col("n") + 1.0) * (2.0 * F.col("n") + 1) / 6)).alias("z"))


def anova(raster: Raster, classes: Raster) -> DataFrame:
    """Between- and within-class sums of squares, degrees of freedom and F; infinite or NaN without variation within classes or without degrees of freedom."""
    p = pair(raster, classes).filter("a IS NOT NULL AND b IS NOT NULL")
    g = p.groupBy(F.round("b").alias("k")).agg(F.count(F.lit(1)).alias("n"), F.sum("a").alias("s"), F.sum(F.col("a") * F.col("a")).alias("q"))
    t = g.agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("between"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    ssb, ssw = F.col("between") - F.col("s") * F.col("s") / F.col("n"), F.col("q") - F.col("between")
    df1, df2 = F.col("k") - 1, F.col("n") - F.col("k")
    return t.select(ssb.alias("ssb"), ssw.alias("ssw"), df1.alias("df1"), df2.alias("df2"), quotient(quotient(ssb, df1), quotient(ssw, df2)).alias("f"))


def two_sample_ks(a: Raster, b: Raster) -> DataFrame:
    """d: the largest gap between the two cumulative distributions."""
    u = a.select("z", F.lit(1).alias("x"), F.lit(0).alias("y")).union(b.select("z", F.lit(0).alias("x"), F.lit(1).alias("y"))).filter("z IS NOT NULL")
    by = u.groupBy("z").agg(F.sum("x").alias("x"), F.sum("y").alias("y"))
    every = by.agg(F.sum("x").alias("nx"), F.sum("y").alias("ny"))  # one row
    gap = F.abs(F.col("cx") / F.col("nx") - F.col("cy") / F.col("ny"))
    return running(by, [F.col("z")], {"cx": F.col("x"), "cy": F.col("y")}).crossJoin(F.broadcast(every)).agg(F.max(gap).alias("d"))


def ks_normality(raster: Raster, bins: int = 10_000) -> DataFrame:
    """d: the largest gap between the binned distribution and the normal one of the same mean and deviation."""
    m = raster.agg(F.avg("z").alias("m"), F.stddev_pop("z").alias("s"), F.min("z").alias("lo"), F.max("z").alias("hi"))
    b = F.least(F.lit(bins - 1), F.floor((F.col("z") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins))
    h = raster.filter("z IS NOT NULL").crossJoin(F.broadcast(m)).groupBy(b.alias("bin"), "m", "s", "lo", "hi").agg(F.count(F.lit(1)).alias("n")).orderBy("bin").collect()  # ``bins`` rows
    total, below, d = sum(r["n"] for r in h), 0, 0.0
    for r in h:
        below += r["n"]
        edge = r["lo"] + (r["bin"] + 1) * (r["hi"] - r["lo"]) / bins
        d = max(d, abs(below / total - 0.5 * (1 + erf((edge - r["m"]) / (r["s"] * sqrt(2))))))
    return raster.sparkSession.createDataFrame([(total, d)], "n long, d double")


def crispness_index(raster: Raster) -> DataFrame:
    """Sum of squared deviations of probabilities over that of a crisp image with the same mean."""
    z = F.col("z")
    t = raster.agg(F.count(z).alias("n"), F.sum(z).alias("s"), F.sum(z * z).alias("q"))
    m = F.col("s") / F.col("n")
    return t.select((F.col("q") - F.col("s") * m).alias("ss"), ((F.col("q") - F.col("s") * m) / (F.col("s") * (1 - m) * (1 - m) + (F.col("n") - F.col("s")) * m * m)).alias("crispness"))


def morans_i(raster: Raster, contiguity: str = "rook") -> DataFrame:
    """n, mean, i (Moran's I) and expected of a raster with rook, bishop or king contiguity; i is NaN if nothing varies or no cell has a neighbour."""
    from geoloom.plans.stencil import neighbourhood

    steps = {"rook": (1, 3, 5, 7), "bishop": (0, 2, 6, 8), "king": (0, 1, 2, 3, 5, 6, 7, 8)}[contiguity]
    m = raster.agg(F.avg("z").alias("m"))
    n = neighbourhood(raster).filter("z IS NOT NULL").crossJoin(F.broadcast(m))
    near = F.filter(F.array(*[F.get("n", F.lit(i)) for i in steps]), lambda v: v.isNotNull())
    dev = F.col("z") - F.col("m")
    cross = F.aggregate(near, F.lit(0.0), lambda a, v: a + (v - F.col("m")))
    t = n.agg(F.count(F.lit(1)).alias("n"), F.first("m").alias("mean"), F.sum(F.size(near)).alias("w"), F.sum(dev * cross).alias("x"), F.sum(dev * dev).alias("v"))
    i = quotient(quotient(F.col("n"), F.col("w")) * F.col("x"), F.col("v"))
    return t.select("n", "mean", i.alias("i"), quotient(F.lit(-1.0), F.col("n") - 1).alias("expected"))


def trend_surface(raster: Raster, order: int = 1) -> Raster:
    """Polynomial of x = col and y = -row of that order, fitted by least squares; the sums come from one aggregation."""
    powers = [(i, j) for i in range(order + 1) for j in range(order + 1 - i)]
    scale = raster.agg(F.max(F.abs("col")).alias("c"), F.max(F.abs("row")).alias("r")).first()
    x, y = F.col("col") / float(scale["c"] or 1), -F.col("row") / float(scale["r"] or 1)
    term = [F.pow(x, F.lit(float(i))) * F.pow(y, F.lit(float(j))) for i, j in powers]
    k = len(powers)
    valid = raster.filter("z IS NOT NULL")
    got = valid.agg(*[F.sum(term[a] * term[b]).alias(f"m{a}_{b}") for a in range(k) for b in range(a + 1)], *[F.sum(term[a] * F.col("z")).alias(f"v{a}") for a in range(k)]).first()
    m = np.array([[got[f"m{max(a, b)}_{min(a, b)}"] for b in range(k)] for a in range(k)])
    beta = np.linalg.lstsq(m, np.array([got[f"v{a}"] for a in range(k)]), rcond=None)[0]
    return raster.select("row", "col", sum((t * float(c) for t, c in zip(term, beta, strict=True)), F.lit(0.0)).alias("z"))


def principal_components(bands: DataFrame, n: int, standardized: bool = False) -> DataFrame:
    """component (from 1), eigenvalue, share and loadings of the bands' covariance (or correlation)."""
    wide = bands.groupBy("row", "col").agg(*[F.max(F.when(F.col("band") == i, F.col("z"))).alias(f"z{i}") for i in range(n)]).dropna()
    how = F.corr if standardized else F.covar_pop
    got = wide.agg(*[how(f"z{a}", f"z{b}").alias(f"c{a}_{b}") for a in range(n) for b in range(a + 1)]).first()
    m = np.array([[got[f"c{max(a, b)}_{min(a, b)}"] for b in range(n)] for a in range(n)])
    values, vectors = np.linalg.eigh(m)
    order = np.argsort(-values)
    rows = [(i + 1, float(values[o]), float(values[o] / values.sum()), [float(v) for v in vectors[:, o] * np.sign(vectors[np.argmax(np.abs(vectors[:, o])), o])]) for i, o in enumerate(order)]
    return bands.sparkSession.createDataFrame(rows, "component int, eigenvalue double, share double, loadings array<double>")


def k_means(bands: DataFrame, n: int, classes: int, rounds: int = 10) -> Raster:
    """Class (from 1) of each cell by Lloyd's algorithm, started on the diagonal of the bands' ranges."""
    wide = bands.groupBy("row", "col").agg(*[F.max(F.when(F.col("band") == i, F.col("z"))).alias(f"z{i}") for i in range(n)]).dropna()
    wide = wide.cache()
    ends = wide.agg(*[F.min(f"z{i}").alias(f"a{i}") for i in range(n)], *[F.max(f"z{i}").alias(f"b{i}") for i in range(n)]).first()
    if ends["a0"] is None:
        return wide.select("row", "col", F.lit(None).cast("double").alias("z"))
    centres = [[ends[f"a{i}"] + (k + 0.5) / classes * (ends[f"b{i}"] - ends[f"a{i}"]) for i in range(n)] for k in range(classes)]

    def nearest() -> Column:
        far = [F.struct(sum(((F.col(f"z{i}") - float(c[i])) * (F.col(f"z{i}") - float(c[i])) for i in range(n)), F.lit(0.0)).alias("d"), F.lit(k).alias("k")) for k, c in enumerate(centres)]
        return F.least(*far)["k"] if classes > 1 else F.lit(0)

    for _ in range(rounds):
        means = wide.groupBy(nearest().alias("k")).agg(*[F.avg(f"z{i}").alias(f"z{i}") for i in range(n)]).collect()  # a row for each class
        new = list(centres)
        for r in means:
            new[r["k"]] = [r[f"z{i}"] for i in range(n)]
        if np.allclose(new, centres):
            break
        centres = new
    return wide.select("row", "col", (nearest() + 1).cast("double").alias("z"))


def random_field(base: Raster, seed: int = 0) -> Raster:
    """Standard normal values, a function of the cell and the seed."""
    u = lambda k: (F.pmod(F.xxhash64("row", "col", F.lit(seed), F.lit(k)), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    return base.select("row", "col", (F.sqrt(-2 * F.log(u(0))) * F.cos(2 * 3.141592653589793 * u(1))).alias("z"))


def random_sample(base: Raster, n: int = 1000, seed: int = 0) -> DataFrame:
    """row, col, z: ``n`` cells picked by a hash of cell and seed, numbered from 1."""
    k = F.xxhash64("row", "col", F.lit(seed))
    picked = base.filter("z IS NOT NULL").orderBy(k, "row", "col").limit(n)
    return picked.select("row", "col", F.row_number().over(Window.orderBy(k, "row", "col")).cast("double").alias("z"))


def trend_surface_points(points: DataFrame, base: Raster, order: int = 1) -> Raster:
    """A polynomial of x and y fitted to z of the points, at the centres of the base's cells (x = col + 0.5, y = row + 0.5)."""
    powers = [(i, j) for i in range(order + 1) for j in range(order + 1 - i)]
    k = len(powers)
    top = points.agg(F.max(F.abs("x")).alias("x"), F.max(F.abs("y")).alias("y")).first()
    sx, sy = float(top["x"] or 1), float(top["y"] or 1)
    terms = lambda x, y: [F.pow(x / sx, F.lit(float(i))) * F.pow(y / sy, F.lit(float(j))) for i, j in powers]
    own = terms(F.col("x"), F.col("y"))
    got = points.filter("z IS NOT NULL").agg(*[F.sum(own[a] * own[b]).alias(f"m{a}_{b}") for a in range(k) for b in range(a + 1)], *[F.sum(own[a] * F.col("z")).alias(f"v{a}") for a in range(k)]).first()
    m = np.array([[got[f"m{max(a, b)}_{min(a, b)}"] for b in range(k)] for a in range(k)], float)
    beta = np.linalg.lstsq(m, np.array([got[f"v{a}"] for a in range(k)], float), rcond=None)[0]
    at = terms(F.col("col") + 0.5, F.col("row") + 0.5)
    return base.select("row", "col", sum((t * float(c) for t, c in zip(at, beta, strict=True)), F.lit(0.0)).alias("z"))


def correlation_neighbourhood(a: Raster, b: Raster, size: int = 11) -> DataFrame:
    """row, col, z: Pearson's r of the two rasters in the window around each cell; NULL where one of them does not vary.

    Values are taken about the rasters' means, so that the window sums lose no digits.
    """
    from geoloom.plans.stencil import dense, focal

    j = pair(a, b)
    both = j.agg(F.avg("a").alias("ma"), F.avg("b").alias("mb"))
    x = j.crossJoin(F.broadcast(both)).select("row", "col", F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), F.col("a") - F.col("ma")).alias("x"), F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), F.col("b") - F.col("mb")).alias("y"))
    u, v = F.col("x"), F.col("y")
    f = focal(dense(x), size // 2, size // 2, {"n": F.when(u.isNotNull(), 1), "sx": u, "sy": v, "xx": u * u, "yy": v * v, "xy": u * v}, {}, {})
    n = F.col("n")
    cov = F.col("xy") - F.col("sx") * F.col("sy") / n
    vx, vy = F.col("xx") - F.col("sx") * F.col("sx") / n, F.col("yy") - F.col("sy") * F.col("sy") / n
    return f.select("row", "col", F.when(u.isNotNull() & (vx > 1e-6) & (vy > 1e-6), cov / F.sqrt(vx * vy)).alias("z"))
