"""Contour lines of a raster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom.plans.stencil import neighbourhood

Raster = DataFrame


def contour_segments(dem: Raster, interval: float, base: float = 0.0) -> DataFrame:
    """level, x1, y1, x2, y2: the contours' segments between cell centres (x = col + 0.5, y = row + 0.5).

    Each square of four centres is cut into two triangles, in which a level is a straight segment between the two
    sides it crosses. A level counts as above the values it equals, so that no segment is a point or is drawn twice.
    """
    n = neighbourhood(dem).filter(F.col("z").isNotNull())
    # the square to the lower right: the cell, its right, lower right and lower neighbours
    corners = [(0.0, 0.0, F.col("z")), (1.0, 0.0, F.get("n", F.lit(5))), (1.0, 1.0, F.get("n", F.lit(8))), (0.0, 1.0, F.get("n", F.lit(7)))]
    point = lambda i: F.struct((F.col("col") + 0.5 + corners[i][0]).alias("x"), (F.col("row") + 0.5 + corners[i][1]).alias("y"), corners[i][2].alias("z"))
    triangles = F.array(*[F.struct(*[point(i).alias(k) for i, k in zip(t, "abc", strict=True)]) for t in ((0, 1, 2), (0, 2, 3))])
    t = n.select(F.explode(triangles).alias("t")).select("t.*").filter("a.z IS NOT NULL AND b.z IS NOT NULL AND c.z IS NOT NULL")
    low, high = F.least("a.z", "b.z", "c.z"), F.greatest("a.z", "b.z", "c.z")
    first, last = F.floor((low - base) / interval) + 1, F.floor((high - base) / interval)
    t = t.filter(first <= last).withColumn("k", F.explode(F.sequence(first, last))).withColumn("level", F.col("k") * interval + base)

    def cross(p: str, q: str) -> Column:
        up = lambda c: F.col(f"{c}.z") >= F.col("level")
        part = (F.col("level") - F.col(f"{p}.z")) / (F.col(f"{q}.z") - F.col(f"{p}.z"))
        return F.when(up(p) != up(q), F.struct(*[(F.col(f"{p}.{c}") + part * (F.col(f"{q}.{c}") - F.col(f"{p}.{c}"))).alias(c) for c in "xy"]))

    ends = F.filter(F.array(cross("a", "b"), cross("b", "c"), cross("a", "c")), lambda e: e.isNotNull())
    s = t.select("level", ends.alias("e"))
    return s.select("level", *[F.get("e", F.lit(i))[c].alias(f"{c}{i + 1}") for i in (0, 1) for c in "xy"]).filter("x1 <> x2 OR y1 <> y2")


def contours(dem: Raster, interval: float, base: float = 0.0) -> DataFrame:
    """fid, level, segments, length: the connected contours; ends are equal as they come from the same two centres."""
    from geoloom.plans.graph import components
    from geoloom.plans.lineage import written

    end = lambda i: F.xxhash64("level", F.round(f"x{i}", 9), F.round(f"y{i}", 9))
    s = written(contour_segments(dem, interval, base).withColumns({"a": end(1), "b": end(2)}), "segments")
    roots = components(s.select(F.col("a").alias("id")).union(s.select("b")).distinct(), s.select("a", "b"))
    j = s.join(roots.withColumnRenamed("id", "_i"), F.col("a") == F.col("_i"))
    return j.groupBy(F.col("root").alias("fid"), "level").agg(F.count(F.lit(1)).alias("segments"), F.sum(F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))).alias("length"))
