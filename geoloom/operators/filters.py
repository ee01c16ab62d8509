"""Moving-window filters.

Sums, minima and maxima are separable windows; order statistics gather a cell's window as
an array; weighted filters gather it with its gaps. All stay in the JVM. Windows are
clipped to the grid and pass over NoData.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom.functions.kernels import EMBOSS, LAPLACIAN, LINES, PREWITT_X, PREWITT_Y, SCHARR_X, SCHARR_Y, SOBEL_X, SOBEL_Y, gaussian, laplacian_of_gaussian
from geoloom.plans.stencil import focal, neighbourhood, window_values

Raster = DataFrame


def _reach(size: int) -> int:
    """Cells on either side: sizes are odd and 3 at least."""
    return max(size, 3) // 2


def stats(raster: Raster, x: int = 11, y: int = 11) -> DataFrame:
    """row, col, z with n, s, q (count, sum, sum of squares), lo and hi of the window."""
    sums = {"n": F.when(F.col("z").isNotNull(), 1), "s": F.col("z"), "q": F.col("z") * F.col("z")}
    return focal(raster, _reach(y), _reach(x), sums, {"lo": F.col("z")}, {"hi": F.col("z")})


def _from_stats(raster: Raster, x: int, y: int, value: Column) -> Raster:
    return stats(raster, x, y).select("row", "col", F.when(F.col("z").isNotNull(), value).alias("z"))


def mean() -> Column:
    """Mean of a window, from :func:`stats`."""
    return F.col("s") / F.col("n")


def std() -> Column:
    """Population standard deviation of a window, from :func:`stats`."""
    return F.sqrt(F.greatest(F.lit(0.0), F.col("q") / F.col("n") - mean() * mean()))


def mean_filter(raster: Raster, x: int = 3, y: int = 3) -> Raster:
    return _from_stats(raster, x, y, mean())


def total_filter(raster: Raster, x: int = 11, y: int = 11) -> Raster:
    return _from_stats(raster, x, y, F.col("s"))


def maximum_filter(raster: Raster, x: int = 11, y: int = 11) -> Raster:
    return _from_stats(raster, x, y, F.col("hi"))


def minimum_filter(raster: Raster, x: int = 11, y: int = 11) -> Raster:
    return _from_stats(raster, x, y, F.col("lo"))


def range_filter(raster: Raster, x: int = 11, y: int = 11) -> Raster:
    return _from_stats(raster, x, y, F.col("hi") - F.col("lo"))


def standard_deviation_filter(raster: Raster, x: int = 11, y: int = 11) -> Raster:
    """Population standard deviation."""
    return _from_stats(raster, x, y, std())


def high_pass_filter(raster: Raster, x: int = 11, y: int = 11) -> Raster:
    return _from_stats(raster, x, y, F.col("z") - mean())


def adaptive_filter(raster: Raster, x: int = 11, y: int = 11, threshold: float = 2.0) -> Raster:
    """Cells more than ``threshold`` standard deviations off the window's mean become the mean."""
    off = F.abs(F.col("z") - mean()) / std()
    return _from_stats(raster, x, y, F.when((std() > 0) & (off > threshold), mean()).otherwise(F.col("z")))


def olympic_filter(raster: Raster, x: int = 11, y: int = 11) -> Raster:
    """Mean without the largest and the least value."""
    n = F.col("n")
    return _from_stats(raster, x, y, F.when(n > 2, (F.col("s") - F.col("hi") - F.col("lo")) / (n - 2)).otherwise(mean()))


def opening(raster: Raster, x: int = 11, y: int = 11) -> Raster:
    return maximum_filter(minimum_filter(raster, x, y), x, y)


def closing(raster: Raster, x: int = 11, y: int = 11) -> Raster:
    return minimum_filter(maximum_filter(raster, x, y), x, y)


def tophat(raster: Raster, x: int = 11, y: int = 11, white: bool = True) -> Raster:
    """z less its opening (white), or its closing less z (black)."""
    other = (opening if white else closing)(raster, x, y).withColumnRenamed("z", "o")
    value = F.col("z") - F.col("o") if white else F.col("o") - F.col("z")
    return raster.join(other, ["row", "col"]).select("row", "col", value.alias("z"))


# order statistics


def _values(raster: Raster, x: int, y: int, value: Callable[[Column], Column]) -> Raster:
    return window_values(raster, _reach(y), _reach(x)).select("row", "col", F.when(F.col("z").isNotNull(), value(F.col("v"))).alias("z"))


def _mean_of(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, b: a + b) / F.size(v)


def _median(v: Column) -> Column:
    s = F.sort_array(v)
    return F.transform(F.array(s), lambda t: (F.get(t, F.floor((F.size(t) - 1) / 2).cast("int")) + F.get(t, F.floor(F.size(t) / 2).cast("int"))) / 2)[0]


def median_filter(raster: Raster, x: int = 11, y: int = 11) -> Raster:
    return _values(raster, x, y, _median)


def high_pass_median_filter(raster: Raster, x: int = 11, y: int = 11) -> Raster:
    return _values(raster, x, y, lambda v: F.col("z") - _median(v))


def percentile_filter(raster: Raster, x: int = 11, y: int = 11) -> Raster:
    """Percentage of the window's values below the cell's."""
    return _values(raster, x, y, lambda v: 100.0 * F.size(F.filter(v, lambda t: t < F.col("z"))) / F.size(v))


def diversity_filter(raster: Raster, x: int = 11, y: int = 11) -> Raster:
    return _values(raster, x, y, lambda v: F.size(F.array_distinct(v)).cast("double"))


def majority_filter(raster: Raster, x: int = 11, y: int = 11) -> Raster:
    """The most frequent value; the least on a tie."""

    def mode(v: Column) -> Column:
        counted = F.transform(F.array_distinct(v), lambda t: F.struct((-F.size(F.filter(v, lambda u: u == t))).alias("n"), t.alias("t")))
        return F.array_min(counted)["t"]

    return _values(raster, x, y, mode)


def k_nearest_mean_filter(raster: Raster, x: int = 11, y: int = 11, k: int = 5) -> Raster:
    """Mean of the ``k`` values of the window nearest the cell's, its own included; the smaller on a tie."""
    near = lambda v: F.transform(F.slice(F.sort_array(F.transform(v, lambda t: F.struct(F.abs(t - F.col("z")).alias("d"), t.alias("t")))), 1, k), lambda s: s["t"])
    return _values(raster, x, y, lambda v: _mean_of(near(v)))


def edge_preserving_mean_filter(raster: Raster, size: int = 11, threshold: float = 15.0) -> Raster:
    return _values(raster, size, size, lambda v: _mean_of(F.filter(v, lambda t: F.abs(t - F.col("z")) <= threshold)))


def lee_sigma_filter(raster: Raster, x: int = 11, y: int = 11, sigma: float = 10.0, m: int = 5) -> Raster:
    """Mean of the values within ``sigma`` of the cell's if more than ``m`` are, else mean of the eight neighbours."""
    near = window_values(raster, _reach(y), _reach(x)).select("row", "col", "z", F.filter("v", lambda t: F.abs(t - F.col("z")) <= sigma).alias("v"))
    around = neighbourhood(raster).select("row", "col", F.filter(F.concat(F.slice("n", 1, 4), F.slice("n", 6, 4)), lambda t: t.isNotNull()).alias("n"))
    j = near.join(around, ["row", "col"])
    value = F.when(F.size("v") > m, _mean_of(F.col("v"))).when(F.size("n") > 0, _mean_of(F.col("n"))).otherwise(F.col("z"))
    return j.select("row", "col", F.when(F.col("z").isNotNull(), value).alias("z"))


def conservative_smoothing_filter(raster: Raster, size: int = 3) -> Raster:
    """Clamps each cell to the range of the others in its window."""
    r = _reach(size)
    centre = 2 * r * (r + 1)
    n = neighbourhood(raster, r).withColumn("n", F.concat(F.slice("n", 1, centre), F.slice("n", centre + 2, centre)))
    value = F.least(F.greatest(F.col("z"), F.array_min("n")), F.array_max("n"))
    return n.select("row", "col", F.when(F.col("z").isNotNull(), value).alias("z"))


# weights


def weighted(raster: Raster, kernel: Sequence[float], *, fill: bool = False, mean: bool = False) -> Raster:
    """Σ w·z over a square kernel; ``fill``: the cell's value stands in for missing ones; ``mean``: divided by the weights used."""
    side = int(len(kernel) ** 0.5)
    n = neighbourhood(raster, side // 2)
    value = lambda i: F.coalesce(F.get("n", F.lit(i)), F.col("z") if fill else F.lit(0.0))
    used = [(i, float(w)) for i, w in enumerate(kernel) if w]
    if len(used) > 60:  # an array expression instead of a long sum
        terms = F.zip_with(F.col("n"), F.lit([float(w) for w in kernel]), lambda a, w: F.coalesce(a, F.col("z") if fill else F.lit(None)) * w)
        total = F.aggregate(terms, F.lit(0.0), lambda a, b: a + F.coalesce(b, F.lit(0.0)))
        weight = F.aggregate(F.zip_with(F.col("n"), F.lit([float(w) for w in kernel]), lambda a, w: F.when(a.isNotNull(), w).otherwise(0.0)), F.lit(0.0), lambda a, b: a + b)
    else:
        total = sum((value(i) * w for i, w in used[1:]), value(used[0][0]) * used[0][1])
        weight = sum((F.when(F.get("n", F.lit(i)).isNotNull(), w).otherwise(0.0) for i, w in used[1:]), F.when(F.get("n", F.lit(used[0][0])).isNotNull(), used[0][1]).otherwise(0.0))
    return n.select("row", "col", F.when(F.col("z").isNotNull(), total / weight if mean else total).alias("z"))


def gaussian_filter(raster: Raster, sigma: float = 0.75) -> Raster:
    return weighted(raster, gaussian(sigma), mean=True)


def difference_of_gaussian_filter(raster: Raster, sigma1: float = 2.0, sigma2: float = 4.0) -> Raster:
    b = gaussian_filter(raster, sigma2).withColumnRenamed("z", "b")
    return gaussian_filter(raster, sigma1).join(b, ["row", "col"]).select("row", "col", (F.col("z") - F.col("b")).alias("z"))


def unsharp_masking(raster: Raster, sigma: float = 0.75, amount: float = 100.0, threshold: float = 0.0) -> Raster:
    b = gaussian_filter(raster, sigma).withColumnRenamed("z", "b")
    diff = F.col("z") - F.col("b")
    return raster.join(b, ["row", "col"]).select("row", "col", F.when(F.abs(diff) > threshold, F.col("z") + diff * (amount / 100.0)).otherwise(F.col("z")).alias("z"))


def laplacian_filter(raster: Raster, variant: str = "3x3(1)") -> Raster:
    return weighted(raster, LAPLACIAN[variant], fill=True)


def laplacian_of_gaussian_filter(raster: Raster, sigma: float = 0.75) -> Raster:
    return weighted(raster, laplacian_of_gaussian(sigma), fill=True)


def emboss_filter(raster: Raster, direction: str = "n") -> Raster:
    return weighted(raster, EMBOSS[direction], fill=True)


def line_detection_filter(raster: Raster, variant: str = "vertical") -> Raster:
    return weighted(raster, LINES[variant], fill=True)


def user_defined_weights_filter(raster: Raster, kernel: Sequence[float], normalize: bool = False) -> Raster:
    return weighted(raster, kernel, mean=normalize)


def gradient(raster: Raster, gx: Sequence[float], gy: Sequence[float]) -> Raster:
    """Magnitude of two kernels' sums; the cell's value stands in for missing neighbours."""
    n = neighbourhood(raster)
    at = [F.coalesce(F.get("n", F.lit(i)), F.col("z")) for i in range(9)]
    total = lambda k: sum((at[i] * float(w) for i, w in enumerate(k) if w), F.lit(0.0))
    x, y = total(gx), total(gy)
    return n.select("row", "col", F.when(F.col("z").isNotNull(), F.sqrt(x * x + y * y)).alias("z"))


def sobel_filter(raster: Raster) -> Raster:
    return gradient(raster, SOBEL_X, SOBEL_Y)


def prewitt_filter(raster: Raster) -> Raster:
    return gradient(raster, PREWITT_X, PREWITT_Y)


def scharr_filter(raster: Raster) -> Raster:
    return gradient(raster, SCHARR_X, SCHARR_Y)


def roberts_cross_filter(raster: Raster) -> Raster:
    n = neighbourhood(raster)
    e, s, se = (F.coalesce(F.get("n", F.lit(i)), F.col("z")) for i in (5, 7, 8))
    return n.select("row", "col", (F.abs(F.col("z") - se) + F.abs(e - s)).alias("z"))


def bilateral_filter(raster: Raster, sigma_dist: float = 0.75, sigma_int: float = 1.0) -> Raster:
    """Gaussian weights of distance and of difference in value."""
    kernel = gaussian(sigma_dist)
    n = neighbourhood(raster, int(len(kernel) ** 0.5) // 2)
    w = F.zip_with(F.col("n"), F.lit(kernel), lambda a, k: F.when(a.isNotNull(), F.struct(a.alias("a"), (k * F.exp(-(a - F.col("z")) * (a - F.col("z")) / (2 * sigma_int * sigma_int))).alias("w"))))
    total = F.aggregate(F.filter(w, lambda x: x.isNotNull()), F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("w")), lambda acc, x: F.struct((acc["s"] + x["a"] * x["w"]).alias("s"), (acc["w"] + x["w"]).alias("w")), lambda acc: acc["s"] / acc["w"])
    return n.select("row", "col", F.when(F.col("z").isNotNull(), total).alias("z"))


def high_pass_bilateral_filter(raster: Raster, sigma_dist: float = 0.75, sigma_int: float = 1.0) -> Raster:
    b = bilateral_filter(raster, sigma_dist, sigma_int).withColumnRenamed("z", "b")
    return raster.join(b, ["row", "col"]).select("row", "col", (F.col("z") - F.col("b")).alias("z"))


def box_mean(raster: Raster, size: int) -> Raster:
    return mean_filter(raster, size, size)


def fast_almost_gaussian_filter(raster: Raster, sigma: float = 1.8, passes: int = 4) -> Raster:
    """Box means in a row whose variances add up to that of the Gaussian."""
    ideal = (12 * sigma * sigma / passes + 1) ** 0.5
    low = int(ideal) if int(ideal) % 2 else int(ideal) - 1
    m = round((12 * sigma * sigma - passes * low * low - 4 * passes * low - 3 * passes) / (-4 * low - 4))
    for i in range(passes):
        size = low if i < m else low + 2
        raster = box_mean(raster, size) if size >= 3 else raster
    return raster
