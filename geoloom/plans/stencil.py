"""Neighbourhoods of grid cells.

A raster is a DataFrame (row, col, z) with a row for every cell; NoData is
NULL. Cells are dealt to square tiles, those near an edge also to the
tiles beyond it, in one shuffle that moves little more than the raster once. All
windows inside a tile reuse that partitioning: they sort, but don't shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Cells along the side of a tile.
TILE = 256


def dense(cells: DataFrame) -> DataFrame:
    """``cells`` with a row for every cell of their extent; absent ones have NULL."""
    box = cells.agg(F.min("row").alias("r0"), F.max("row").alias("r1"), F.min("col").alias("c0"), F.max("col").alias("c1")).filter("r0 IS NOT NULL")
    rows = box.select(F.explode(F.sequence("r0", "r1")).alias("row"), "c0", "c1")
    grid = rows.select("row", F.explode(F.sequence("c0", "c1")).alias("col"))
    return grid.join(cells, ["row", "col"], "left")


def tiled(cells: DataFrame, halo: int, tile: int = TILE) -> DataFrame:
    """``cells`` with tile numbers tr, tc; cells within ``halo`` of a tile are in it too. Partitioned by tile."""

    def near(at: Column) -> Column:
        return F.sequence(F.floor((at - halo) / tile).cast("int"), F.floor((at + halo) / tile).cast("int"))

    if not halo:
        out = cells.withColumns({"tr": F.floor(F.col("row") / tile).cast("int"), "tc": F.floor(F.col("col") / tile).cast("int")})
    else:
        out = cells.withColumn("tr", F.explode(near(F.col("row")))).withColumn("tc", F.explode(near(F.col("col"))))
    return out.repartition("tr", "tc")


def inner(cells: DataFrame, tile: int = TILE) -> DataFrame:
    """Only the cells that belong to their tile."""
    own = (F.col("tr") == F.floor(F.col("row") / tile)) & (F.col("tc") == F.floor(F.col("col") / tile))
    return cells.filter(own).drop("tr", "tc")


def along_row(reach: int | None = None) -> Window:
    w = Window.partitionBy("tr", "tc", "row").orderBy("col")
    return w if reach is None else w.rowsBetween(-reach, reach)


def along_col(reach: int | None = None) -> Window:
    w = Window.partitionBy("tr", "tc", "col").orderBy("row")
    return w if reach is None else w.rowsBetween(-reach, reach)


def _at(value: str, k: int, w: Window) -> Column:
    """The value ``k`` cells on; the grid is dense, so that is k rows on."""
    if k == 0:
        return F.col(value)
    return F.lead(value, k).over(w) if k > 0 else F.lag(value, -k).over(w)


def neighbourhood(raster: DataFrame, reach: int = 1, value: str = "z", tile: int = TILE) -> DataFrame:
    """``raster`` with n: the (2·reach+1)² values around each cell, row by row, NULL off the grid."""
    side = range(-reach, reach + 1)
    t = tiled(raster, reach, tile)
    t = t.withColumn("_r", F.array(*[_at(value, k, along_row()) for k in side]))
    blank = F.array(*[F.lit(None).cast("double") for _ in side])
    t = t.withColumn("n", F.concat(*[F.coalesce(_at("_r", k, along_col()), blank) for k in side]))
    return inner(t.drop("_r"), tile)


def focal(raster: DataFrame, ry: int, rx: int, sums: dict[str, Column], lows: dict[str, Column], highs: dict[str, Column], tile: int = TILE) -> DataFrame:
    """``raster`` with sums, minima and maxima of expressions over windows of (2·ry+1) x (2·rx+1) cells.

    Separable: along rows, then along columns of the results.
    """
    t = tiled(raster, max(ry, rx), tile)
    for w in (along_row(rx), along_col(ry)):
        step = {k: F.sum(v).over(w) for k, v in sums.items()} | {k: F.min(v).over(w) for k, v in lows.items()} | {k: F.max(v).over(w) for k, v in highs.items()}
        t = t.withColumns(step)
        sums, lows, highs = ({k: F.col(k) for k in d} for d in (sums, lows, highs))
    return inner(t, tile)


def window_values(raster: DataFrame, ry: int, rx: int, value: str = "z", tile: int = TILE) -> DataFrame:
    """``raster`` with v: the values (no NULLs) in a window of (2·ry+1) x (2·rx+1) cells, row by row."""
    t = tiled(raster, max(ry, rx), tile)
    t = t.withColumn("_r", F.collect_list(value).over(along_row(rx)))
    t = t.withColumn("v", F.flatten(F.collect_list("_r").over(along_col(ry))))
    return inner(t.drop("_r"), tile)
