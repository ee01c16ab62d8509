"""Removal of depressions by breaching, and edits of a DEM before flow is routed over it."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geoloom.functions.grids import AROUND
from geoloom.operators.hydro import cell_id, d8_flow_accumulation, d8_pointer, fill_depressions, forest
from geoloom.plans.lifting import jumps, paths
from geoloom.plans.lineage import written
from geoloom.plans.stencil import TILE, neighbourhood, tiled

Raster = DataFrame


def lowered(dem: Raster, cuts: DataFrame) -> Raster:
    """``dem`` with every cell no higher than the least ``cut`` (row, col, cut) for it."""
    low = cuts.groupBy("row", "col").agg(F.min("cut").alias("cut"))
    return dem.join(low, ["row", "col"], "left").select("row", "col", F.when(F.col("z").isNotNull(), F.least("z", "cut")).alias("z"))


def fill_depressions_planchon_darboux(dem: Raster, increment: float = 0.0) -> Raster:
    """The surface that drains from infinity down to each cell's least spill level (plus ``increment`` a cell)."""
    return fill_depressions(dem, increment)


def fill_depressions_wang_liu(dem: Raster, increment: float = 0.0) -> Raster:
    """Spill levels found inward from the edges, raised by ``increment`` a cell."""
    return fill_depressions(dem, increment)


def breach_single_cell_pits(dem: Raster) -> Raster:
    """Where a pit has a lower cell two cells away, the cell between them gets their mean level."""
    n = neighbourhood(dem, 2).filter(F.col("z").isNotNull())
    at = lambda dr, dc: F.get("n", F.lit((dr + 2) * 5 + dc + 2))
    pit = F.lit(True)
    for dr, dc, _ in AROUND:
        pit = pit & ~F.coalesce(at(dr, dc) < F.col("z"), F.lit(False))
    cuts = []
    for a in (-2, -1, 0, 1, 2):
        for b in (-2, -1, 0, 1, 2):
            if max(abs(a), abs(b)) == 2:
                middle = (F.lit(int(a / 2)), F.lit(int(b / 2)))  # towards the far cell
                cuts.append(F.when(at(a, b) < F.col("z"), F.struct((F.col("row") + middle[0]).alias("row"), (F.col("col") + middle[1]).alias("col"), ((F.col("z") + at(a, b)) / 2).alias("cut"))))
    found = n.filter(pit).select(F.explode(F.filter(F.array(*cuts), lambda c: c.isNotNull())).alias("c")).select("c.*")
    return lowered(dem, found)


def pits(dem: Raster) -> DataFrame:
    """row, col, z of cells without a lower neighbour, off the edge of the data."""
    n = neighbourhood(dem).filter(F.col("z").isNotNull())
    return n.filter(~F.exists("n", lambda v: v.isNull() | (v < F.col("z")))).select("row", "col", "z")


def breach_depressions(dem: Raster, increment: float = 0.0, max_depth: float | None = None, max_length: int | None = None, fill: bool = True) -> Raster:
    """Carves a channel from each pit along its spill path to the first cell that is lower.

    The spill path follows the filled surface, so it leaves over the lowest saddle. Cells on it are cut to
    the pit's level less ``increment`` a step. Pits whose channel would be deeper than ``max_depth`` or
    longer than ``max_length`` cells stay, and are filled at the end if ``fill``.
    """
    eps = 1e-7
    z = written(dem.filter(F.col("z").isNotNull()), "dem")
    spill = written(fill_depressions(dem, eps), "spill")
    f = written(forest(d8_pointer(spill)), "forest")
    low = pits(dem).select(cell_id().alias("key"), F.col("z").alias("pit"))
    # along the spill path elevations rise and fall; the first lower cell is found on the paths of the pits alone
    walked = paths(jumps(f), low.select("key", F.col("key").alias("at")))
    level = z.select(cell_id().alias("_z"), F.col("z").alias("v"))
    j = walked.join(level, F.col("id") == F.col("_z")).join(low, "key")
    out = j.filter(F.col("v") < F.col("pit")).groupBy("key").agg(F.min("steps").alias("stop"))
    ends = j.groupBy("key").agg(F.max("steps").alias("end"))
    channel = j.join(out, "key", "left").join(ends, "key").filter(F.col("steps") <= F.coalesce(F.col("stop") - 1, F.col("end"))).withColumn("cut", F.col("pit") - increment * F.col("steps"))
    if max_depth is not None or max_length is not None:
        size = channel.groupBy("key").agg(F.max(F.col("v") - F.col("cut")).alias("depth"), F.max("steps").alias("long"))
        fits = size.filter((F.col("depth") <= (float("inf") if max_depth is None else max_depth)) & (F.col("long") <= (1 << 62 if max_length is None else max_length)))
        channel = channel.join(fits.select("key"), "key", "left_semi")
    cuts = channel.select(F.shiftright("id", 32).cast("int").alias("row"), F.col("id").bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("col"), "cut")
    breached = written(lowered(dem, cuts), "breached")
    return fill_depressions(breached, increment) if fill and (max_depth is not None or max_length is not None) else breached


def least_cost_channel(z: np.ndarray, start: tuple[int, int], reach: int, max_cost: float) -> list[tuple[int, int]]:
    """Cells from a pit to the first lower one (excluded) by the path with the least depth to cut; none within limits: empty."""
    r0, c0 = start
    floor = z[start]
    best = {start: 0.0}
    back: dict[tuple[int, int], tuple[int, int]] = {}
    heap = [(0.0, r0, c0)]
    while heap:
        cost, r, c = heapq.heappop(heap)
        if cost > best[(r, c)]:
            continue
        if z[r, c] < floor:
            path = []
            at = (r, c)
            while at in back:
                at = back[at]
                path.append(at)
            return path[::-1]
        for dr, dc, _ in AROUND:
            y, x = r + dr, c + dc
            if not (0 <= y < z.shape[0] and 0 <= x < z.shape[1]) or max(abs(y - r0), abs(x - c0)) > reach or np.isnan(z[y, x]):
                continue
            new = cost + max(z[y, x] - floor, 0.0) * (2**0.5 if dr and dc else 1.0)
            if new <= max_cost and new < best.get((y, x), np.inf):
                best[(y, x)] = new
                back[(y, x)] = (r, c)
                heapq.heappush(heap, (new, y, x))
    return []


def breach_depressions_least_cost(dem: Raster, dist: int, max_cost: float = float("inf"), increment: float = 0.0, fill: bool = True, rounds: int = 4, tile: int = TILE) -> Raster:
    """Carves from each pit the channel with the least cost (depth cut times length) to a lower cell at most ``dist`` cells away.

    All pits of a round are carved at once, each in its tile with a halo of ``dist`` cells; what one channel
    leaves open another may have closed, so rounds follow until no pit can be breached (``rounds`` at most). Then the rest is filled, if asked for.
    """

    def run(key: tuple, cells: pd.DataFrame) -> pd.DataFrame:
        r, c = cells["row"].to_numpy(), cells["col"].to_numpy()
        y, x = r - r.min(), c - c.min()
        z = np.full((y.max() + 1, x.max() + 1), np.nan)
        z[y, x] = cells["z"].to_numpy(dtype=float, na_value=np.nan)
        own = (r // tile == key[0]) & (c // tile == key[1]) & (cells["pit"].to_numpy() == 1)
        rows: list[tuple[int, int, float]] = []
        for a, b in zip(y[own].tolist(), x[own].tolist(), strict=True):
            for k, (i, j) in enumerate(least_cost_channel(z, (a, b), dist, max_cost)):
                rows.append((i + int(r.min()), j + int(c.min()), float(z[a, b]) - increment * k))
        return pd.DataFrame(rows, columns=["row", "col", "cut"])

    state = written(dem, "breach")
    for _ in range(rounds):
        marked = state.join(pits(state).select("row", "col", F.lit(1).alias("pit")), ["row", "col"], "left").fillna(0, ["pit"])
        cuts = written(tiled(marked, dist, tile).groupBy("tr", "tc").applyInPandas(run, "row int, col int, cut double"), "cuts")
        low = cuts.groupBy("row", "col").agg(F.min("cut").alias("cut"))
        if not state.join(low, ["row", "col"]).filter("cut < z").limit(1).count():
            break
        state = written(lowered(state, cuts), "breach")
    return fill_depressions(state, increment) if fill else state


def flow_accumulation_full_workflow(dem: Raster, increment: float = 1e-5, out: str = "cells") -> dict[str, Raster]:
    """A breached DEM without depressions, its D8 pointer and its flow accumulation."""
    clear = written(fill_depressions(breach_depressions(dem, increment), increment), "breached")
    pointer = written(d8_pointer(clear), "pointer")
    return {"dem": clear, "pointer": pointer, "accumulation": d8_flow_accumulation(pointer, out)}


def _draw(seed: int, k: int):
    """A normal deviate of a cell: both halves of a hash as uniform numbers."""
    h = F.xxhash64(F.lit(seed), F.lit(k), "row", "col")
    u = (F.shiftrightunsigned(h, 32) + 1) / 4294967297.0
    v = h.bitwiseAND(F.lit((1 << 32) - 1)) / 4294967296.0
    return F.sqrt(-2 * F.log(u)) * F.cos(2 * F.pi() * v)


def stochastic_depression_analysis(dem: Raster, rmse: float, reach: int, iterations: int = 10, seed: int = 0) -> Raster:
    """The share of ``iterations`` in which a cell lies in a depression of the DEM with random errors.

    Errors are normal draws of each cell, averaged over windows of 2·``reach`` + 1 cells and scaled to ``rmse``.
    """
    from geoloom.plans.stencil import focal

    hits = None
    for k in range(iterations):
        noise = focal(dem.select("row", "col", F.when(F.col("z").isNotNull(), _draw(seed, k)).alias("e"), "z"), reach, reach, {"s": F.col("e"), "n": F.when(F.col("e").isNotNull(), 1)}, {}, {})
        field = noise.select("row", "col", "z", (F.col("s") / F.col("n")).alias("e"))
        scale = field.agg((rmse / F.stddev_pop("e")).alias("scale"))  # one row
        shaken = written(field.crossJoin(F.broadcast(scale)).select("row", "col", (F.col("z") + F.coalesce(F.col("e") * F.col("scale"), F.lit(0.0))).alias("z")), "shaken")
        deep = shaken.join(fill_depressions(shaken).withColumnRenamed("z", "f"), ["row", "col"]).filter("f > z").select("row", "col")
        hits = deep if hits is None else hits.union(deep)
    count = hits.groupBy("row", "col").agg(F.count(F.lit(1)).alias("k"))
    return dem.join(count, ["row", "col"], "left").select("row", "col", F.when(F.col("z").isNotNull(), F.coalesce("k", F.lit(0)) / iterations).alias("z"))


# edits


def flatten_lakes(dem: Raster, lakes: Raster) -> Raster:
    """Every lake (cells with one value > 0) at the least elevation of its perimeter cells."""
    n = neighbourhood(lakes.select("row", "col", "z")).filter("z > 0")
    rim = n.filter(F.exists("n", lambda v: ~v.eqNullSafe(F.col("z")))).select("row", "col", F.col("z").alias("lake"))
    level = rim.join(dem, ["row", "col"]).groupBy("lake").agg(F.min("z").alias("level"))
    inside = lakes.filter("z > 0").select("row", "col", F.col("z").alias("lake")).join(level, "lake").select("row", "col", "level")
    return dem.join(inside, ["row", "col"], "left").select("row", "col", F.when(F.col("z").isNotNull(), F.coalesce("level", "z")).alias("z"))


def raise_walls(dem: Raster, walls: Raster, height: float, breaches: Raster | None = None) -> Raster:
    """``height`` more on wall cells (> 0), but not where a breach (> 0) crosses."""
    w = walls.filter("z > 0").select("row", "col")
    if breaches is not None:
        w = w.join(breaches.filter("z > 0").select("row", "col"), ["row", "col"], "left_anti")
    w = w.withColumn("_w", F.lit(height))
    return dem.join(w, ["row", "col"], "left").select("row", "col", (F.col("z") + F.coalesce("_w", F.lit(0.0))).alias("z"))


def fill_burn(dem: Raster, streams: Raster, depth: float | None = None) -> Raster:
    """Streams (> 0) lowered by ``depth`` (the DEM's range and 1, if not given), then depressions filled."""
    span = dem.agg((F.lit(depth) if depth is not None else F.max("z") - F.min("z") + 1).cast("double").alias("_d"))
    s = streams.filter("z > 0").select("row", "col").crossJoin(F.broadcast(span))
    burned = dem.join(s, ["row", "col"], "left").select("row", "col", (F.col("z") - F.coalesce("_d", F.lit(0.0))).alias("z"))
    return fill_depressions(written(burned, "burned"))


def burn_streams_at_roads(dem: Raster, streams: Raster, roads: Raster, width: int) -> Raster:
    """Stream cells within ``width`` cells of a crossing with a road get the least stream elevation there."""
    s = streams.filter("z > 0").select("row", "col")
    crossing = s.join(roads.filter("z > 0").select("row", "col"), ["row", "col"], "left_semi")
    side = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in range(-width, width + 1) for b in range(-width, width + 1)]))
    near = crossing.select(cell_id().alias("at"), "row", "col", side.alias("o")).select("at", (F.col("row") + F.col("o.a")).alias("row"), (F.col("col") + F.col("o.b")).alias("col"))
    near = near.join(s, ["row", "col"], "left_semi").join(dem, ["row", "col"])
    cuts = near.withColumn("cut", F.min("z").over(Window.partitionBy("at"))).select("row", "col", "cut")  # a window is bounded by ``width``
    return lowered(dem, cuts)


def impoundment_size_index(dem: Raster, dam_length: int, increment: float = 1e-5) -> DataFrame:
    """row, col, height, area, volume, mean: what a dam of at most ``dam_length`` cells across each cell would impound.

    The dam stands across the flow (of four directions the one nearest to a right angle to it) and is as high as the
    lower of the two banks it ends at, each the highest cell on its side. Impounded are upslope cells below its crest.
    """
    half = dam_length // 2
    z = written(dem, "dem")
    pointer = written(d8_pointer(fill_depressions(z, increment)), "pointer")
    n = neighbourhood(z, half).filter(F.col("z").isNotNull())
    side = 2 * half + 1
    at = lambda dr, dc: F.get("n", F.lit((dr + half) * side + dc + half))
    bank = lambda dr, dc: F.array_max(F.array(*[at(dr * k, dc * k) for k in range(1, half + 1)]))
    crest = lambda a: F.least(bank(*a), bank(-a[0], -a[1]))
    across = [(-1, -1), (-1, 0), (-1, 1), (0, 1)]  # of flow to NE/SW, E/W, SE/NW, S/N
    j = n.join(pointer.select("row", "col", F.log2(F.nullif("z", F.lit(0.0))).cast("int").alias("way")), ["row", "col"])
    top = F.when(F.col("way") % 4 == 0, crest(across[0])).when(F.col("way") % 4 == 1, crest(across[1])).when(F.col("way") % 4 == 2, crest(across[2])).when(F.col("way") % 4 == 3, crest(across[3]))
    dams = j.select(cell_id().alias("dam"), "z", top.alias("crest")).filter("crest > z")
    f = written(forest(pointer), "forest")
    # upslope cells below the crest, reached without crossing higher ones: the front climbs while it stays below
    up = f.filter("next IS NOT NULL").select(F.col("next").alias("_n"), F.col("id").alias("up"))
    level = z.filter(F.col("z").isNotNull()).select(cell_id().alias("_z"), F.col("z").alias("v"))
    up = written(up.join(level, F.col("up") == F.col("_z")).drop("_z"), "up")
    front = written(dams.select("dam", "crest", F.col("dam").alias("id"), F.col("z").alias("v")), "front")
    parts = [front]
    while True:
        front = written(front.join(up.withColumnRenamed("v", "_v"), F.col("id") == F.col("_n")).filter("_v < crest").select("dam", "crest", F.col("up").alias("id"), F.col("_v").alias("v")), "front")
        if not front.limit(1).count():
            break
        parts.append(front)
    wet = parts[0]
    for p in parts[1:]:
        wet = wet.union(p)
    depth = F.col("crest") - F.col("v")
    sizes = wet.groupBy(F.col("dam").alias("_d")).agg(F.count(F.lit(1)).alias("area"), F.sum(depth).alias("volume"), F.avg(depth).alias("mean"))
    out = dams.join(sizes, F.col("dam") == F.col("_d"))
    return out.select(F.shiftright("dam", 32).cast("int").alias("row"), F.col("dam").bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("col"), (F.col("crest") - F.col("z")).alias("height"), F.col("area").cast("double").alias("area"), "volume", "mean")


def insert_dams(dem: Raster, sites: DataFrame, dam_length: int) -> Raster:
    """``dem`` with a wall across the flow at each site (row, col), as high as the lower bank it ends at."""
    half = dam_length // 2
    pointer = d8_pointer(fill_depressions(dem, 1e-5))
    n = neighbourhood(dem, half).join(sites.select("row", "col").distinct(), ["row", "col"], "left_semi")
    side = 2 * half + 1
    at = lambda dr, dc: F.get("n", F.lit((dr + half) * side + dc + half))
    bank = lambda dr, dc: F.array_max(F.array(*[at(dr * k, dc * k) for k in range(1, half + 1)]))
    j = n.join(pointer.select("row", "col", F.log2(F.nullif("z", F.lit(0.0))).cast("int").alias("way")), ["row", "col"])
    walls = []
    for k, (dr, dc) in enumerate([(-1, -1), (-1, 0), (-1, 1), (0, 1)]):
        crest = F.least(bank(dr, dc), bank(-dr, -dc))
        cells = F.array(*[F.struct((F.col("row") + dr * i).alias("row"), (F.col("col") + dc * i).alias("col"), crest.alias("wall")) for i in range(-half, half + 1)])
        walls.append(j.filter(F.col("way") % 4 == k).select(F.explode(cells).alias("w")).select("w.*"))
    raised = walls[0].union(walls[1]).union(walls[2]).union(walls[3]).groupBy("row", "col").agg(F.max("wall").alias("wall"))
    return dem.join(raised, ["row", "col"], "left").select("row", "col", F.when(F.col("z").isNotNull(), F.greatest("z", "wall")).alias("z"))
