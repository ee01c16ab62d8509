"""Image operators that are neither filters nor map algebra."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geoloom.functions.calculator import to_sql
from geoloom.functions.grids import AROUND
from geoloom.operators.stats import _with_cdf
from geoloom.plans.stencil import neighbourhood

Raster = DataFrame


def raster_calculator(statement: str, rasters: dict[str, Raster]) -> Raster:
    """Any expression over rasters, named in quotes; NoData in any input is NoData."""
    named = [r.select("row", "col", F.col("z").alias(f"r{i}")) for i, r in enumerate(rasters.values())]
    j = reduce(lambda a, b: a.join(b, ["row", "col"]), named)
    names = {n: f"r{i}" for i, n in enumerate(rasters)} | {"row": "CAST(row AS DOUBLE)", "column": "CAST(col AS DOUBLE)"}
    valid = reduce(lambda a, b: a & b, [F.col(f"r{i}").isNotNull() for i in range(len(named))])
    return j.select("row", "col", F.when(valid, F.expr(to_sql(statement, names))).alias("z"))


def integral_image(raster: Raster) -> Raster:
    """The sum of all values up and to the left: running sums along rows, then columns."""
    rows = Window.partitionBy("row").orderBy("col").rowsBetween(Window.unboundedPreceding, 0)
    cols = Window.partitionBy("col").orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    return raster.withColumn("s", F.sum(F.coalesce("z", F.lit(0.0))).over(rows)).select("row", "col", F.sum("s").over(cols).alias("z"))


def change_vector_analysis(first: Sequence[Raster], second: Sequence[Raster]) -> DataFrame:
    """row, col, magnitude and direction (bit i set where band i rose) of the change between two dates."""
    d = [b.select("row", "col", F.col("z").alias("_b")).join(a, ["row", "col"]).select("row", "col", (F.col("_b") - F.col("z")).alias(f"d{i}")) for i, (a, b) in enumerate(zip(first, second, strict=True))]
    j = reduce(lambda a, b: a.join(b, ["row", "col"]), d)
    n = range(len(d))
    return j.select("row", "col", F.sqrt(sum((F.col(f"d{i}") * F.col(f"d{i}") for i in n), F.lit(0.0))).alias("magnitude"), sum((F.when(F.col(f"d{i}") > 0, float(1 << i)).otherwise(0.0) for i in n), F.lit(0.0)).alias("direction"))


def histogram_matching(raster: Raster, reference: Raster, bins: int = 1024) -> Raster:
    """Values of ``reference`` at the raster's place in its distribution: the least bin whose share is as large."""
    own = _with_cdf(raster, bins).select("row", "col", "cdf")
    like = _with_cdf(reference, bins).groupBy("bin").agg(F.first("cdf").alias("c"), F.min("z").alias("v"))  # ``bins`` rows at most
    ladder = like.agg(F.array_sort(F.collect_list(F.struct("c", "v"))).alias("ladder"))
    hit = F.get(F.filter("ladder", lambda s: s["c"] >= F.col("cdf") - 1e-12), F.lit(0))["v"]
    return own.crossJoin(F.broadcast(ladder)).select("row", "col", hit.alias("z"))


def image_stack_profile(bands: DataFrame, points: DataFrame) -> DataFrame:
    """fid, band, z at the points' cells (fid, row, col)."""
    return points.join(bands, ["row", "col"]).select("fid", "band", "z")


def find_patch_edge_cells(raster: Raster) -> Raster:
    """The value of cells with a neighbour of another value or none, else 0."""
    n = neighbourhood(raster).filter(F.col("z").isNotNull())
    near = F.array(*[F.get("n", F.lit(at)) for _, _, at in AROUND])
    edge = F.exists(near, lambda v: v.isNull() | (v != F.col("z")))
    return n.select("row", "col", F.when(edge, F.col("z")).otherwise(0.0).alias("z"))


def edge_proportion(raster: Raster) -> DataFrame:
    """class, proportion of its cells that are edge cells; background 0 left out."""
    e = find_patch_edge_cells(raster).withColumnRenamed("z", "e")
    return raster.filter("z > 0").join(e, ["row", "col"]).groupBy(F.col("z").alias("class")).agg(F.avg((F.col("e") != 0).cast("double")).alias("proportion"))


def raster_to_points(raster: Raster) -> DataFrame:
    """row, col, x, y, z of the cells that are not 0 or NoData."""
    return raster.filter("z <> 0").select("row", "col", (F.col("col") + 0.5).alias("x"), (F.col("row") + 0.5).alias("y"), "z")


def resample(raster: Raster, factor: float, method: str = "nearest") -> Raster:
    """A raster ``factor`` times as fine, by the nearest cell or bilinear weights of valid cells."""
    box = raster.agg(F.min("row").alias("r0"), F.max("row").alias("r1"), F.min("col").alias("c0"), F.max("col").alias("c1")).filter("r0 IS NOT NULL")
    ends = lambda a, b: F.sequence((F.col(a) * factor).cast("int"), ((F.col(b) + 1) * factor - 1).cast("int"))
    fine = box.select(F.explode(ends("r0", "r1")).alias("row"), "c0", "c1").select("row", F.explode(ends("c0", "c1")).alias("col"))
    y, x = (F.col("row") + 0.5) / factor - 0.5, (F.col("col") + 0.5) / factor - 0.5
    source = raster.select(F.col("row").alias("sr"), F.col("col").alias("sc"), "z").filter(F.col("z").isNotNull())
    if method == "nearest":
        near = fine.withColumns({"sr": F.floor(y + 0.5).cast("int"), "sc": F.floor(x + 0.5).cast("int")})
        return near.join(source, ["sr", "sc"]).select("row", "col", "z")
    corners = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1)]))
    f = fine.withColumns({"y": y, "x": x, "o": corners}).withColumns({"sr": (F.floor("y") + F.col("o.a")).cast("int"), "sc": (F.floor("x") + F.col("o.b")).cast("int")})
    w = (1 - F.abs(F.col("y") - F.col("sr"))) * (1 - F.abs(F.col("x") - F.col("sc")))
    return f.withColumn("w", w).join(source, ["sr", "sc"]).groupBy("row", "col").agg((F.sum(F.col("z") * F.col("w")) / F.sum("w")).alias("z"))


def mosaic(rasters: Sequence[Raster]) -> Raster:
    """All rasters on one grid; where several have a value the last one counts."""
    tagged = reduce(DataFrame.unionByName, [r.select("row", "col", "z", F.lit(i).alias("i")) for i, r in enumerate(rasters)])
    return tagged.filter(F.col("z").isNotNull()).groupBy("row", "col").agg(F.max_by("z", "i").alias("z"))


def vignetting(raster: Raster, row: float, col: float, focal: float, n: float = 4.0) -> Raster:
    """Brightness corrected by cos(angle)^-n of the angle from the principal point."""
    d = F.sqrt((F.col("row") - row) * (F.col("row") - row) + (F.col("col") - col) * (F.col("col") - col))
    return raster.select("row", "col", (F.col("z") / F.pow(F.cos(F.atan(d / focal)), F.lit(n))).alias("z"))


def find_parallel_flow(pointer: Raster, streams: Raster) -> Raster:
    """1 where a stream cell has a stream neighbour that flows the same way without being in line, else 0."""
    s = streams.filter("z > 0").select("row", "col")
    n = neighbourhood(pointer.join(s.withColumn("on", F.lit(1)), ["row", "col"], "left").withColumn("z", F.when(F.col("on") == 1, F.col("z"))).drop("on"))
    beside = F.lit(False)
    for i, (dr, dc, at) in enumerate(AROUND):
        v = F.get("n", F.lit(at))
        in_line = (F.col("z") == float(1 << i)) | (F.col("z") == float(1 << ((i + 4) % 8)))
        beside = beside | F.coalesce((v == F.col("z")) & ~in_line & (F.col("z") > 0), F.lit(False))
    return n.filter(F.col("z").isNotNull()).select("row", "col", beside.cast("double").alias("z"))
