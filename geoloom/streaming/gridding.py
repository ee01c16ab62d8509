"""Gridding of point streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def block_gridding(points: DataFrame, size: float, time: str = "ts", window: str = "1 day", late: str = "2 days") -> DataFrame:
    """Cells of each time window of a stream of points (x, y, z and a time): start, row, col, n, lowest, highest and mean.

    Points later than ``late`` are dropped; state is bounded by the cells of open windows.
    """
    cell = [F.floor(F.col(c) / size).cast("int").alias(n) for c, n in (("y", "row"), ("x", "col"))]
    w = F.window(time, window)
    out = points.withWatermark(time, late).groupBy(w.alias("w"), *cell).agg(F.count(F.lit(1)).alias("n"), F.min("z").alias("lowest"), F.max("z").alias("highest"), F.avg("z").alias("mean"))
    return out.select(F.col("w.start").alias("start"), "row", "col", "n", "lowest", "highest", "mean")
