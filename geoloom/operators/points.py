"""Point sets and point clouds: gridding, interpolation, binning, filters.

Points are rows with x and y (and z, classes, …). Neighbours within a radius meet
in square bins as wide as the radius: an equi-join on 3x3 bins and a distance test.
"""

from __future__ import annotations

from math import pi, sqrt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def to_cells(points: DataFrame, size: float, x: str = "x", y: str = "y") -> DataFrame:
    """``points`` with row and col of their cell of ``size``, from the origin."""
    return points.withColumns({"row": F.floor(F.col(y) / size).cast("int"), "col": F.floor(F.col(x) / size).cast("int")})


def block_gridding(points: DataFrame, size: float, kind: str = "max", value: str = "z") -> DataFrame:
    """row, col, z: max, min, sum, mean or number of the points' values in each cell."""
    v = F.col(value)
    how = {"max": F.max(v), "min": F.min(v), "sum": F.sum(v), "mean": F.avg(v), "number": F.count(v).cast("double")}[kind]
    return to_cells(points, size).groupBy("row", "col").agg(how.alias("z"))


def points_to_raster(points: DataFrame, size: float, assign: str = "last", value: str = "z", order: str = "fid") -> DataFrame:
    """As :func:`block_gridding`, also with the first or last value by ``order``."""
    if assign in ("first", "last"):
        pick = F.min_by if assign == "first" else F.max_by
        return to_cells(points, size).groupBy("row", "col").agg(pick(value, order).alias("z"))
    return block_gridding(points, size, assign, value)


def point_stats(points: DataFrame, size: float) -> DataFrame:
    """row, col, n, z_range, intensity_range and predominant class (the least on a tie)."""
    c = to_cells(points, size)
    by = c.groupBy("row", "col", "classification").agg(F.count(F.lit(1)).alias("n"), F.min("z").alias("z0"), F.max("z").alias("z1"), F.min("intensity").alias("i0"), F.max("intensity").alias("i1"))
    return by.groupBy("row", "col").agg(F.sum("n").alias("n"), (F.max("z1") - F.min("z0")).alias("z_range"), (F.max("i1") - F.min("i0")).alias("intensity_range"), F.min_by("classification", F.struct(-F.col("n"), F.col("classification"))).alias("predominant"))


def flightline_overlap(points: DataFrame, size: float) -> DataFrame:
    return to_cells(points, size).groupBy("row", "col").agg(F.count_distinct("point_source_id").cast("double").alias("z"))


def hex_bins(points: DataFrame, width: float) -> DataFrame:
    """q, r, n: points in each hexagon (axial coordinates, pointy top, ``width`` across flats)."""
    size = width / sqrt(3)
    q = (sqrt(3) / 3 * F.col("x") - F.col("y") / 3) / size
    r = F.col("y") * (2 / 3) / size
    a, b, c = F.round(q), F.round(r), F.round(-q - r)
    da, db, dc = F.abs(a - q), F.abs(b - r), F.abs(c + q + r)
    qq = F.when((da > db) & (da > dc), -b - c).otherwise(a)
    rr = F.when((da > db) & (da > dc), b).when(db > dc, -a - c).otherwise(b)
    return points.groupBy(qq.cast("long").alias("q"), rr.cast("long").alias("r")).agg(F.count(F.lit(1)).alias("n"))


# neighbours


def within(targets: DataFrame, points: DataFrame, radius: float, prefix: str = "p_") -> DataFrame:
    """Each target (x, y, …) with every point at most ``radius`` away (columns prefixed) and their distance d."""
    bin_ = lambda c: F.floor(F.col(c) / radius)
    around = lambda c: F.explode(F.array(*[bin_(c) + k for k in (-1, 0, 1)]))
    t = targets.withColumn("_bx", around("x")).withColumn("_by", around("y"))
    p = points.select(*[F.col(c).alias(f"{prefix}{c}") for c in points.columns], bin_("x").alias("_bx"), bin_("y").alias("_by"))
    d = F.sqrt((F.col("x") - F.col(f"{prefix}x")) * (F.col("x") - F.col(f"{prefix}x")) + (F.col("y") - F.col(f"{prefix}y")) * (F.col("y") - F.col(f"{prefix}y")))
    return t.join(p, ["_bx", "_by"]).withColumn("d", d).filter(F.col("d") <= radius).drop("_bx", "_by")


def centres(points: DataFrame, size: float) -> DataFrame:
    """row, col, x, y of every cell in the extent of the points."""
    e = to_cells(points, size).agg(F.min("row").alias("r0"), F.max("row").alias("r1"), F.min("col").alias("c0"), F.max("col").alias("c1")).filter("r0 IS NOT NULL")
    g = e.select(F.explode(F.sequence("r0", "r1")).alias("row"), "c0", "c1").select("row", F.explode(F.sequence("c0", "c1")).alias("col"))
    return g.select("row", "col", ((F.col("col") + 0.5) * size).alias("x"), ((F.col("row") + 0.5) * size).alias("y"))


def idw_interpolation(points: DataFrame, size: float, radius: float, weight: float = 2.0, value: str = "z") -> DataFrame:
    """row, col, z: inverse-distance weighted mean within ``radius``; points at a centre decide alone."""
    n = within(centres(points, size), points.select("x", "y", F.col(value).alias("v")), radius)
    w = F.pow("d", F.lit(-weight))
    exact = F.avg(F.when(F.col("d") == 0, F.col("p_v")))
    far = F.col("d") > 0
    return n.groupBy("row", "col").agg(F.coalesce(exact, F.sum(F.when(far, F.col("p_v") * w)) / F.sum(F.when(far, w))).alias("z"))


def nearest_gridding(points: DataFrame, size: float, radius: float, value: str = "z") -> DataFrame:
    """row, col, z: the value of the nearest point within ``radius``; the least value on a tie."""
    n = within(centres(points, size), points.select("x", "y", F.col(value).alias("v")), radius)
    return n.groupBy("row", "col").agg(F.min(F.struct("d", "p_v")).alias("m")).select("row", "col", F.col("m.p_v").alias("z"))


def point_density(points: DataFrame, size: float, radius: float) -> DataFrame:
    n = within(centres(points, size), points.select("x", "y"), radius)
    return n.groupBy("row", "col").agg((F.count(F.lit(1)) / (pi * radius * radius)).alias("z"))


#: Kernels of the distance as a part t of the bandwidth.
KERNELS = {
    "uniform": "0.5",
    "triangular": "1 - t",
    "epanechnikov": "0.75 * (1 - t * t)",
    "quartic": "0.9375 * power(1 - t * t, 2)",
    "triweight": "1.09375 * power(1 - t * t, 3)",
    "tricube": "0.8641975308641975 * power(1 - t * t * t, 3)",
    "gaussian": "exp(-t * t / 2) / sqrt(2 * pi())",
    "cosine": "pi() / 4 * cos(pi() / 2 * t)",
    "logistic": "1 / (exp(t) + 2 + exp(-t))",
    "sigmoid": "2 / pi() / (exp(t) + exp(-t))",
    "silverman": "0.5 * exp(-t / sqrt(2.0)) * sin(t / sqrt(2.0) + pi() / 4)",
}


def heat_map(points: DataFrame, size: float, bandwidth: float, kernel: str = "quartic") -> DataFrame:
    """row, col, z: kernel density of the points."""
    n = within(centres(points, size), points.select("x", "y"), bandwidth).withColumn("t", F.col("d") / bandwidth)
    return n.groupBy("row", "col").agg(F.sum(F.expr(KERNELS[kernel])).alias("z"))


def height_above_ground(points: DataFrame, radius: float, ground: int = 2) -> DataFrame:
    """``points`` with height over the nearest ground point within ``radius`` (the lowest on a tie); NULL without one."""
    g = points.filter(F.col("classification") == ground).select("x", "y", "z").distinct()
    key = ["x", "y", "z"]
    n = within(points.select(*key).distinct(), g, radius).groupBy(*key).agg(F.min(F.struct("d", "p_z")).alias("m"))
    return points.join(n, key, "left").withColumn("height", F.col("z") - F.col("m.p_z")).drop("m")


def remove_outliers(points: DataFrame, radius: float, difference: float) -> DataFrame:
    """Points whose z is at most ``difference`` off the mean of the others within ``radius``; lone points stay."""
    sums = points.groupBy("x", "y").agg(F.sum("z").alias("s"), F.count(F.lit(1)).alias("n"))
    near = within(sums.select("x", "y"), sums, radius).groupBy("x", "y").agg(F.sum("p_s").alias("s"), F.sum("p_n").alias("n"))
    j = points.join(near, ["x", "y"])
    mean = (F.col("s") - F.col("z")) / (F.col("n") - 1)
    return j.filter((F.col("n") < 2) | (F.abs(F.col("z") - mean) <= difference)).drop("s", "n")


def tophat(points: DataFrame, radius: float) -> DataFrame:
    """x, y, z, height: z less the opening (largest of the least z within ``radius``)."""
    low = points.groupBy("x", "y").agg(F.min("z").alias("z"))
    e = within(low.select("x", "y"), low, radius).groupBy("x", "y").agg(F.min("p_z").alias("z"))
    o = within(e.select("x", "y"), e, radius).groupBy("x", "y").agg(F.max("p_z").alias("o"))
    return points.join(o, ["x", "y"]).select("x", "y", "z", (F.col("z") - F.col("o")).alias("height"))


# filters of clouds


def thin(points: DataFrame, size: float, method: str = "lowest", order: list[str] | None = None) -> DataFrame:
    """One point of each cell: the lowest, highest, first, last or nearest to the centre; ``order`` breaks ties."""
    order = order or ["x", "y", "z"]
    c = to_cells(points, size)
    dx, dy = F.col("x") - (F.col("col") + 0.5) * size, F.col("y") - (F.col("row") + 0.5) * size
    key = {"lowest": [F.col("z")], "highest": [F.desc("z")], "first": [], "last": [F.desc(k) for k in order], "nearest": [dx * dx + dy * dy]}[method]
    w = Window.partitionBy("row", "col").orderBy(*key, *order)
    return c.withColumn("_k", F.row_number().over(w)).filter("_k = 1").select(*points.columns)


def thin_high_density(points: DataFrame, size: float, most: int, order: list[str]) -> DataFrame:
    """At most ``most`` points of each cell, in ``order``."""
    w = Window.partitionBy("row", "col").orderBy(*order)
    return to_cells(points, size).withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= most).select(*points.columns)


def elevation_slice(points: DataFrame, low: float, high: float) -> DataFrame:
    return points.filter(F.col("z").between(low, high))


def remove_duplicates(points: DataFrame, with_z: bool = False) -> DataFrame:
    """One point of each position: the least of its other columns."""
    key = ["x", "y", *(["z"] if with_z else [])]
    rest = [c for c in points.columns if c not in key]
    one = points.groupBy(*key).agg(F.min(F.struct(*rest)).alias("_s"))
    return one.select(*[F.col(c) if c in key else F.col(f"_s.{c}").alias(c) for c in points.columns])


def shift(points: DataFrame, dx: float = 0.0, dy: float = 0.0, dz: float = 0.0) -> DataFrame:
    return points.withColumns({"x": F.col("x") + dx, "y": F.col("y") + dy, "z": F.col("z") + dz})


def info(points: DataFrame) -> DataFrame:
    """classification, return_no, n, least and largest z and intensity."""
    return points.groupBy("classification", "return_no").agg(F.count(F.lit(1)).alias("n"), F.min("z").alias("z0"), F.max("z").alias("z1"), F.avg("intensity").alias("intensity"))


def normalize(points: DataFrame, terrain: DataFrame, size: float) -> DataFrame:
    """Points with z over the terrain raster (row, col, z) of cells of ``size``."""
    t = terrain.select("row", "col", F.col("z").alias("_t"))
    return to_cells(points, size).join(t, ["row", "col"], "left").withColumn("z", F.col("z") - F.col("_t")).select(*points.columns)


def coincident(points: DataFrame, tolerance: float, order: str = "fid") -> DataFrame:
    """Points without an earlier one (by ``order``) within ``tolerance``."""
    w = within(points, points.select(order, "x", "y"), tolerance)
    late = w.filter(F.col(f"p_{order}") < F.col(order)).select(order).distinct()
    return points.join(late, order, "left_anti")


