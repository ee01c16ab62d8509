"""Distances on a grid: Euclidean and cost-weighted."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geoloom.functions.grids import AROUND, spread
from geoloom.plans.lineage import written
from geoloom.plans.stencil import TILE, neighbourhood, tiled

Raster = DataFrame


def nearest_target(raster: Raster) -> DataFrame:
    """row, col, d2, tr, tc: squared distance to the nearest target (a cell that is not 0 or NoData) and its place; the first in row order on a tie.

    The nearest targets above and below come from windows along the columns; a
    row is then searched outwards, column by column, only as far as the worst best distance.
    """
    target = F.when(F.coalesce(F.col("z"), F.lit(0.0)) != 0, F.col("row"))
    w = Window.partitionBy("col").orderBy("row")
    up = F.last(target, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    down = F.first(target, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    columns = raster.select("row", "col", up.alias("up"), down.alias("down"))

    def run(cells: pd.DataFrame) -> pd.DataFrame:
        cells = cells.sort_values("col")
        row, col = int(cells["row"].iloc[0]), cells["col"].to_numpy()
        n = len(col)
        best = [np.full(n, np.inf), np.full(n, np.inf), np.full(n, np.inf)]
        places = [cells[c].to_numpy(dtype=float, na_value=np.nan) for c in ("up", "down")]
        for k in range(n):
            if k and k * k > best[0].max():
                break
            for s in (-k, k) if k else (0,):
                to = slice(max(0, -s), n - max(0, s))
                of = slice(max(0, s), n + min(0, s))
                for at in places:
                    tr = at[of]
                    d2 = (tr - row) ** 2 + k * k
                    tc = col[of].astype(float)
                    b0, b1, b2 = (b[to] for b in best)
                    better = (d2 < b0) | ((d2 == b0) & ((tr < b1) | ((tr == b1) & (tc < b2))))
                    for b, v in zip((b0, b1, b2), (d2, tr, tc), strict=True):
                        b[better] = v[better]
        out = pd.DataFrame({"row": row, "col": col, "d2": best[0], "tr": best[1], "tc": best[2]})
        return out[np.isfinite(out["d2"])]

    return columns.groupBy("row").applyInPandas(run, "row int, col int, d2 double, tr double, tc double")


def euclidean_distance(raster: Raster) -> Raster:
    return nearest_target(raster).select("row", "col", F.sqrt("d2").alias("z"))


def euclidean_allocation(raster: Raster) -> Raster:
    """The value of the nearest target."""
    values = raster.select(F.col("row").cast("double").alias("tr"), F.col("col").cast("double").alias("tc"), "z")
    return nearest_target(raster).join(values, ["tr", "tc"]).select("row", "col", "z")


def buffer_raster(raster: Raster, size: float) -> Raster:
    """1 within ``size`` of a target, else 0."""
    return euclidean_distance(raster).select("row", "col", (F.col("z") <= size).cast("double").alias("z"))


def elevation_above_stream_euclidean(dem: Raster, streams: Raster) -> Raster:
    """Height above the nearest stream cell."""
    near = nearest_target(streams).select("row", "col", F.col("tr").cast("int").alias("sr"), F.col("tc").cast("int").alias("sc"))
    low = dem.select(F.col("row").alias("sr"), F.col("col").alias("sc"), F.col("z").alias("low"))
    return dem.join(near, ["row", "col"]).join(low, ["sr", "sc"]).select("row", "col", (F.col("z") - F.col("low")).alias("z"))


def cost_distance(source: Raster, cost: Raster, tile: int = TILE) -> Raster:
    """Least accumulated cost from the sources (not 0 or NoData); a step costs the mean of its two cells times its length.

    Each round spreads within every tile from what its neighbours reached, until nothing falls.
    """
    s = source.select("row", "col", F.coalesce(F.col("z"), F.lit(0.0)).alias("s"))
    state = written(cost.join(s, ["row", "col"]).select("row", "col", "z", F.when(F.col("s") != 0, 0.0).otherwise(float("inf")).alias("w")), "costs")

    def run(key: tuple, cells: pd.DataFrame) -> pd.DataFrame:
        r, c = cells["row"].to_numpy(), cells["col"].to_numpy()
        y, x = r - r.min(), c - c.min()
        z, w = np.full((y.max() + 1, x.max() + 1), np.nan), np.full((y.max() + 1, x.max() + 1), np.inf)
        z[y, x], w[y, x] = cells["z"], cells["w"]
        own = (r // tile == key[0]) & (c // tile == key[1])
        total = spread(z, w)[y, x]
        return pd.DataFrame({"row": r, "col": c, "z": cells["z"], "w": total, "fell": total < cells["w"]})[own]

    while True:
        state = written(tiled(state.select("row", "col", "z", "w"), 1, tile).groupBy("tr", "tc").applyInPandas(run, "row int, col int, z double, w double, fell boolean"), "costs")
        if not state.filter("fell").limit(1).count():
            return state.filter(F.col("w") < float("inf")).select("row", "col", F.col("w").alias("z"))


def backlink(accumulated: Raster, cost: Raster) -> Raster:
    """Pointer (codes of :mod:`geoloom.operators.hydro`) to the neighbour a least-cost path comes from; 0 at sources. Costs must be over 0."""
    j = cost.select("row", "col", F.col("z").alias("c")).join(accumulated, ["row", "col"], "left")
    n = neighbourhood(j)
    n = neighbourhood(n.select("row", "col", "c", "z", F.col("n").alias("away")), value="c").filter("z IS NOT NULL")
    ways = []
    for i, (dr, dc, at) in enumerate(AROUND):
        step = (F.col("c") + F.get("n", F.lit(at))) / 2 * (2**0.5 if dr and dc else 1.0)
        ways.append(F.struct((F.get("away", F.lit(at)) + step).alias("t"), F.lit(i).alias("i")))
    best = F.array_min(F.filter(F.array(*ways), lambda w: w["t"].isNotNull()))
    return n.select("row", "col", F.when(F.col("z") == 0, 0.0).otherwise(F.pow(F.lit(2.0), best["i"])).alias("z"))


def cost_allocation(source: Raster, pointer: Raster) -> Raster:
    """The value of the source that each cell's back-link path ends at."""
    from geoloom.operators.hydro import watershed

    return watershed(pointer, source)


def cost_pathway(destination: Raster, pointer: Raster, zero_background: bool = False) -> Raster:
    """How many destinations' paths pass a cell; elsewhere NoData or 0."""
    from geoloom.operators.hydro import trace_downslope_flowpaths

    t = trace_downslope_flowpaths(pointer, destination)
    return t.select("row", "col", F.coalesce("z", F.lit(0.0)).alias("z")) if zero_background else t
