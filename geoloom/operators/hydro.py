"""Flow directions, flow accumulation and what depends on them.

A pointer raster has in z the code 2^i of the neighbour a cell drains to (NE 1, E 2, SE 4, S 8,
SW 16, W 32, NW 64, N 128), 0 where none is lower. It is a forest: values along
flow paths are carried by doubling (:mod:`geoloom.plans.graph`), in as many
rounds as the longest path has binary digits.
"""

from __future__ import annotations

from math import pi, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom.functions.grids import AROUND, flood
from geoloom.operators.terrain import _around
from geoloom.plans.flow import settle
from geoloom.plans.graph import components, downstream, upstream
from geoloom.plans.lineage import written
from geoloom.plans.ranking import ranked
from geoloom.plans.stencil import TILE, dense, neighbourhood, tiled

Raster = DataFrame


def cell_id(row: Column | str = "row", col: Column | str = "col") -> Column:
    c = lambda x: F.col(x) if isinstance(x, str) else x
    return c(row).cast("long") * (1 << 32) + c(col).cast("long")


def _by_id(df: DataFrame, value: Column) -> Raster:
    """Back from ids to cells."""
    return df.select(F.shiftright("id", 32).cast("int").alias("row"), F.col("id").bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("col"), value.cast("double").alias("z"))


# pointers


def d8_pointer(dem: Raster) -> Raster:
    """The steepest lower neighbour; the first in order on a tie."""

    def value(near) -> Column:
        drops = F.array(*[F.struct((-(F.col("z") - v) / d).alias("s"), F.lit(i).alias("i")) for i, (v, d) in enumerate(near)])
        best = F.array_min(F.filter(drops, lambda x: x["s"] < 0))
        return F.coalesce(F.pow(F.lit(2.0), best["i"]), F.lit(0.0))

    return _around(dem, value)


def rho8_pointer(dem: Raster, seed: int = 0) -> Raster:
    """D8 with the diagonal distance replaced by 1 / (2 - u) for a draw u of the cell and direction."""
    n = neighbourhood(dem).filter(F.col("z").isNotNull())
    drops = []
    for i, (dr, dc, at) in enumerate(AROUND):
        u = F.pmod(F.xxhash64("row", "col", F.lit(i), F.lit(seed)), F.lit(1 << 20)) / float(1 << 20)
        drops.append(F.struct((-(F.col("z") - F.get("n", F.lit(at))) * (1 / (2 - u) if dr and dc else F.lit(1.0))).alias("s"), F.lit(i).alias("i")))
    best = F.array_min(F.filter(F.array(*drops), lambda x: x["s"] < 0))
    return n.select("row", "col", F.coalesce(F.pow(F.lit(2.0), best["i"]), F.lit(0.0)).alias("z"))


def fd8_pointer(dem: Raster) -> Raster:
    """The sum of the codes of all lower neighbours."""
    return _around(dem, lambda near: sum((F.when(v < F.col("z"), float(1 << i)).otherwise(0.0) for i, (v, _) in enumerate(near)), F.lit(0.0)))


#: Facets of D-infinity: the straight and the diagonal neighbour (places in the 3x3 array), multiple and sign of the angle.
FACETS = [(5, 2, 0, 1), (1, 2, 1, -1), (1, 0, 1, 1), (3, 0, 2, -1), (3, 6, 2, 1), (7, 6, 3, -1), (7, 8, 3, 1), (5, 8, 4, -1)]


def dinf_pointer(dem: Raster, resolution: float = 1.0) -> Raster:
    """Direction of the steepest descent over eight triangular facets, degrees clockwise from north; -1 where there is none."""
    n = neighbourhood(dem).filter(F.col("z").isNotNull())
    facets = []
    for i, (e1, e2, a, s) in enumerate(FACETS):
        z1, z2 = F.get("n", F.lit(e1)), F.get("n", F.lit(e2))
        s1, s2 = (F.col("z") - z1) / resolution, (z1 - z2) / resolution
        r = F.atan2(s2, s1)
        angle = F.when(r < 0, 0.0).when(r > pi / 4, pi / 4).otherwise(r)
        drop = F.when(r < 0, s1).when(r > pi / 4, (F.col("z") - z2) / (resolution * sqrt(2))).otherwise(F.sqrt(s1 * s1 + s2 * s2))
        drop = F.when((s1 == 0) & (s2 == 0), 0.0).otherwise(drop)
        facets.append(F.when(z1.isNotNull() & z2.isNotNull(), F.struct((-drop).alias("s"), F.lit(i).alias("i"), (s * angle + a * pi / 2).alias("angle"))))
    best = F.array_min(F.filter(F.array(*facets), lambda f: f["s"] < 0))
    degrees = (450 - F.degrees(best["angle"])) % 360
    return n.select("row", "col", F.when(best.isNull(), -1.0).otherwise(degrees).alias("z"))


def forest(pointer: Raster) -> DataFrame:
    """id, next (NULL where flow ends or leaves the grid) and step (length to next) of a pointer raster."""
    code = F.log2(F.col("z")).cast("int")
    dr, dc = (F.get(F.lit([a[k] for a in AROUND]), code) for k in (0, 1))
    to = pointer.filter("z IS NOT NULL").select(cell_id().alias("id"), F.when(F.col("z") > 0, cell_id(F.col("row") + dr, F.col("col") + dc)).alias("next"), F.when(F.col("z") > 0, F.when((dr != 0) & (dc != 0), sqrt(2)).otherwise(1.0)).otherwise(0.0).alias("step"))
    there = to.select(F.col("id").alias("_i"))
    j = to.join(there, F.col("next") == F.col("_i"), "left")
    return j.select("id", F.col("_i").alias("next"), F.when(F.col("_i").isNotNull(), F.col("step")).otherwise(0.0).alias("step"))


def num_inflowing_neighbours(dem: Raster) -> Raster:
    f = forest(d8_pointer(dem))
    n = f.groupBy("next").agg(F.count(F.lit(1)).alias("n"))
    return _by_id(f.join(n.withColumnRenamed("next", "_i"), F.col("id") == F.col("_i"), "left"), F.coalesce("n", F.lit(0)))


# along the paths


def d8_flow_accumulation(pointer: Raster, out: str = "cells", resolution: float = 1.0) -> Raster:
    """Cells that drain through a cell, itself included; as ``catchment`` area or ``specific`` contributing area."""
    acc = upstream(forest(pointer).withColumn("n", F.lit(1).cast("long")), ["n"])
    return _by_id(acc, F.col("n") * {"cells": 1.0, "catchment": resolution * resolution, "specific": resolution}[out])


def d8_mass_flux(pointer: Raster, loading: Raster, efficiency: Raster, absorption: Raster) -> Raster:
    """Mass that reaches each cell: its load and what comes in, less absorption, passed on by its efficiency (0 to 1)."""
    f = forest(pointer)
    values = loading.select(cell_id().alias("_a"), F.col("z").alias("load")).join(efficiency.select(cell_id().alias("_a"), F.col("z").alias("eff")), "_a").join(absorption.select(cell_id().alias("_a"), F.col("z").alias("loss")), "_a")
    v = written(f.join(values, F.col("id") == F.col("_a")).select("id", "next", "load", "eff", "loss"), "flux")
    return _flux(v, v.filter("next IS NOT NULL").select(F.col("id").alias("src"), F.col("next").alias("dst"), F.lit(1.0).alias("w")))


def dinf_mass_flux(dem: Raster, loading: Raster, efficiency: Raster, absorption: Raster) -> Raster:
    """As :func:`d8_mass_flux`, along D-infinity flow."""
    named = {"load": loading, "eff": efficiency, "loss": absorption}
    v = dem.filter(F.col("z").isNotNull()).select(cell_id().alias("id"))
    for k, r in named.items():
        v = v.join(r.select(cell_id().alias("id"), F.col("z").alias(k)), "id")
    return _flux(v, dinf_edges(dinf_pointer(dem)))


def _flux(v: DataFrame, edges: DataFrame) -> Raster:
    return _by_id(settle(v.select("id", F.col("load").alias("start"), "loss", "eff"), edges), F.col("x"))


def basins(pointer: Raster) -> Raster:
    """Each outlet's basin, numbered by the outlets' order."""
    ends = downstream(forest(pointer), {})
    rank = ranked(ends.select(F.col("last").alias("_l")).distinct(), [F.col("_l")])
    return _by_id(ends.join(rank, F.col("last") == F.col("_l")), F.col("n"))


def _sum(a: str, b: str) -> Column:
    return F.col(a) + F.col(b)


def downslope_flowpath_length(pointer: Raster) -> Raster:
    return _by_id(downstream(forest(pointer), {"step": _sum}), F.col("step"))


def flow_length_diff(pointer: Raster) -> Raster:
    """Largest difference of downslope flow length to a neighbour."""
    return _around(dense(downslope_flowpath_length(pointer)), lambda near: F.greatest(*[F.coalesce(F.abs(v - F.col("z")), F.lit(0.0)) for v, _ in near]))


def elev_above_pit(dem: Raster) -> Raster:
    """Height above the end of the cell's flow path."""
    ends = downstream(forest(d8_pointer(dem)), {})
    z = dem.select(cell_id().alias("_i"), F.col("z").alias("own"))
    low = dem.select(cell_id().alias("_j"), F.col("z").alias("low"))
    return _by_id(ends.join(z, F.col("id") == F.col("_i")).join(low, F.col("last") == F.col("_j")), F.col("own") - F.col("low"))


def _to_marked(pointer: Raster, marks: Raster, carry: dict | None = None) -> DataFrame:
    """id, mark of the first marked cell downstream (itself included; NULL: none), last, and carried columns."""
    m = marks.filter("z IS NOT NULL AND z <> 0").select(cell_id().alias("_m"), F.col("z").alias("mark"))
    f = forest(pointer).join(m, F.col("id") == F.col("_m"), "left")
    stop = F.col("_m").isNotNull()
    paths = downstream(f.select("id", F.when(~stop, F.col("next")).alias("next"), F.when(stop, 0.0).otherwise(F.col("step")).alias("step")), carry or {})
    return paths.join(m, F.col("last") == F.col("_m"), "left")


def watershed(pointer: Raster, pour_points: Raster) -> Raster:
    """The value of the first pour point downstream; NoData where there is none."""
    return _by_id(_to_marked(pointer, pour_points), F.col("mark"))


def downslope_distance_to_stream(pointer: Raster, streams: Raster) -> Raster:
    return _by_id(_to_marked(pointer, streams, {"step": _sum}), F.when(F.col("mark").isNotNull(), F.col("step")))


def elevation_above_stream(dem: Raster, streams: Raster) -> Raster:
    """Height above the first stream cell downstream."""
    p = _to_marked(d8_pointer(dem), streams)
    z = dem.select(cell_id().alias("_i"), F.col("z").alias("own"))
    low = dem.select(cell_id().alias("_j"), F.col("z").alias("low"))
    return _by_id(p.join(z, F.col("id") == F.col("_i")).join(low, F.col("last") == F.col("_j")), F.when(F.col("mark").isNotNull(), F.col("own") - F.col("low")))


def max_upslope_flowpath_length(dem: Raster) -> Raster:
    return _by_id(upstream(forest(d8_pointer(dem)).withColumn("far", F.lit(0.0)), [], {"far": "step"}), F.col("far"))


def max_upslope_value(dem: Raster, values: Raster) -> Raster:
    f = forest(d8_pointer(dem)).join(values.select(cell_id().alias("_i"), F.col("z").alias("v")), F.col("id") == F.col("_i"))
    return _by_id(upstream(f.withColumn("none", F.lit(0.0)), [], {"v": "none"}), F.col("v"))


def trace_downslope_flowpaths(pointer: Raster, seeds: Raster) -> Raster:
    """How many seeds' paths pass a cell; NoData where none does."""
    f = forest(pointer).join(seeds.filter("z IS NOT NULL AND z <> 0").select(cell_id().alias("_i")), F.col("id") == F.col("_i"), "left")
    hits = upstream(f.withColumn("n", F.col("_i").isNotNull().cast("long")), ["n"])
    return _by_id(hits, F.nullif("n", F.lit(0)))


def snap_pour_points(points: DataFrame, accumulation: Raster, distance: int) -> DataFrame:
    """fid, row, col of the cell with the largest accumulation within ``distance`` cells; the nearest, then first on a tie."""
    return _snap(points, accumulation, distance, lambda d: F.struct(-F.col("z"), d, F.col("r"), F.col("c")))


def jenson_snap_pour_points(points: DataFrame, streams: Raster, distance: int) -> DataFrame:
    """fid, row, col of the nearest stream cell within ``distance`` cells; points without one stay."""
    return _snap(points, streams.filter("z > 0"), distance, lambda d: F.struct(d, F.col("r"), F.col("c")))


def _snap(points: DataFrame, raster: Raster, distance: int, key) -> DataFrame:
    side = range(-distance, distance + 1)
    near = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in side for b in side]))
    p = points.select("fid", F.col("row").alias("pr"), F.col("col").alias("pc"), near.alias("o")).select("fid", "pr", "pc", (F.col("pr") + F.col("o.a")).alias("r"), (F.col("pc") + F.col("o.b")).alias("c"))
    cells = raster.select(F.col("row").alias("r"), F.col("col").alias("c"), "z").filter(F.col("z").isNotNull())
    d = (F.col("r") - F.col("pr")) * (F.col("r") - F.col("pr")) + (F.col("c") - F.col("pc")) * (F.col("c") - F.col("pc"))
    best = p.join(cells, ["r", "c"]).groupBy("fid").agg(F.min(key(d)).alias("k"), F.min_by(F.struct("r", "c"), key(d)).alias("to"))
    return points.select("fid", "row", "col").join(best, "fid", "left").select("fid", F.coalesce("to.r", "row").alias("row"), F.coalesce("to.c", "col").alias("col"))


# more than one receiver


def fd8_edges(dem: Raster, exponent: float = 1.1, contour: bool = False) -> DataFrame:
    """src, dst, w: each cell's flow to its lower neighbours by slope to the power ``exponent`` (times contour length)."""
    n = neighbourhood(dem).filter(F.col("z").isNotNull())
    to = []
    for dr, dc, at in AROUND:
        d = sqrt(dr * dr + dc * dc)
        v = F.get("n", F.lit(at))
        width = (0.354 if dr and dc else 0.5) if contour else 1.0
        to.append(F.when(v < F.col("z"), F.struct(cell_id(F.col("row") + dr, F.col("col") + dc).alias("dst"), (F.pow((F.col("z") - v) / d, F.lit(exponent)) * width).alias("w"))))
    lower = n.select(cell_id().alias("src"), F.filter(F.array(*to), lambda x: x.isNotNull()).alias("to"))
    total = F.aggregate("to", F.lit(0.0), lambda a, x: a + x["w"])
    return lower.withColumn("total", total).select("src", F.explode("to").alias("e"), "total").select("src", "e.dst", (F.col("e.w") / F.col("total")).alias("w"))


def _spread(dem: Raster, edges: DataFrame) -> Raster:
    cells = dem.filter(F.col("z").isNotNull()).select(cell_id().alias("id"), F.lit(1.0).alias("start"), F.lit(0.0).alias("loss"), F.lit(1.0).alias("eff"))
    return _by_id(settle(cells, written(edges, "edges")), F.col("x"))


def fd8_flow_accumulation(dem: Raster, exponent: float = 1.1) -> Raster:
    return _spread(dem, fd8_edges(dem, exponent))


def quinn_flow_accumulation(dem: Raster, exponent: float = 1.0) -> Raster:
    return _spread(dem, fd8_edges(dem, exponent, contour=True))


def qin_flow_accumulation(dem: Raster, exponent: float = 10.0, max_slope: float = 45.0) -> Raster:
    """The exponent grows from 1.1 with the steepest slope, up to ``exponent`` at ``max_slope`` degrees."""
    n = neighbourhood(dem).filter(F.col("z").isNotNull())
    drops = [((F.col("z") - F.get("n", F.lit(at))) / sqrt(dr * dr + dc * dc), cell_id(F.col("row") + dr, F.col("col") + dc)) for dr, dc, at in AROUND]
    top = F.greatest(*[F.coalesce(s, F.lit(0.0)) for s, _ in drops])
    n = n.withColumn("p", (exponent - 1.1) * F.least(top / F.tan(F.radians(F.lit(max_slope))), F.lit(1.0)) + 1.1)
    to = [F.when(s > 0, F.struct(i.alias("dst"), F.pow(s, F.col("p")).alias("w"))) for s, i in drops]
    lower = n.select(cell_id().alias("src"), F.filter(F.array(*to), lambda x: x.isNotNull()).alias("to"))
    edges = lower.withColumn("total", F.aggregate("to", F.lit(0.0), lambda a, x: a + x["w"])).select("src", F.explode("to").alias("e"), "total").select("src", "e.dst", (F.col("e.w") / F.col("total")).alias("w"))
    return _spread(dem, edges)


def dinf_edges(pointer: Raster) -> DataFrame:
    """src, dst, w of a D-infinity pointer: the two neighbours on either side of the direction, by angle."""
    k = F.floor(F.col("z") / 45.0).cast("int")
    part = (F.col("z") - k * 45.0) / 45.0
    # compass octants from north, clockwise
    steps = [(-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1)]
    at = lambda j, c: F.get(F.lit([s[c] for s in steps]), j % 8)
    ends = [F.struct(cell_id(F.col("row") + at(j, 0), F.col("col") + at(j, 1)).alias("dst"), w.alias("w")) for j, w in ((k, 1 - part), (k + 1, part))]
    return pointer.filter("z >= 0").select(cell_id().alias("src"), F.explode(F.array(*ends)).alias("e")).select("src", "e.dst", "e.w").filter("w > 0")


def dinf_flow_accumulation(dem: Raster) -> Raster:
    return _spread(dem, dinf_edges(dinf_pointer(dem)))


def rho8_flow_accumulation(dem: Raster, seed: int = 0) -> Raster:
    return d8_flow_accumulation(rho8_pointer(dem, seed))


# depressions


def fill_depressions(dem: Raster, increment: float = 0.0, tile: int = TILE) -> Raster:
    """Raises every cell to its least spill level towards the edge of the data.

    Each round floods every tile from its edge cells and from the levels its neighbours reached; it ends
    when no level falls. A tile is a bounded group; only levels cross tiles. NoData cells stay, as NULL.
    """
    n = neighbourhood(dem, tile=tile)
    edge = F.exists("n", lambda x: x.isNull())
    state = written(n.filter(F.col("z").isNotNull()).select("row", "col", "z", F.when(edge, F.col("z")).otherwise(float("inf")).alias("w")), "levels")

    def run(key: tuple, cells: pd.DataFrame) -> pd.DataFrame:
        r, c = cells["row"].to_numpy(), cells["col"].to_numpy()
        y, x = r - r.min(), c - c.min()
        z, w = np.full((y.max() + 1, x.max() + 1), np.nan), np.full((y.max() + 1, x.max() + 1), np.inf)
        z[y, x], w[y, x] = cells["z"], cells["w"]
        own = (r // tile == key[0]) & (c // tile == key[1])
        level = flood(z, w, increment)[y, x]
        return pd.DataFrame({"row": r, "col": c, "z": cells["z"], "w": level, "fell": level < cells["w"]})[own]

    while True:
        state = written(tiled(state.select("row", "col", "z", "w"), 1, tile).groupBy("tr", "tc").applyInPandas(run, "row int, col int, z double, w double, fell boolean"), "levels")
        if not state.filter("fell").limit(1).count():
            levels = state.select("row", "col", F.col("w").alias("z"))
            return dem.select("row", "col").join(levels, ["row", "col"], "left")  # as dense as the DEM, for what looks at neighbours next


def depth_in_sink(dem: Raster) -> Raster:
    f = fill_depressions(dem).withColumnRenamed("z", "f")
    return dem.join(f, ["row", "col"]).select("row", "col", F.when(F.col("f") > F.col("z"), F.col("f") - F.col("z")).alias("z"))


def clump(raster: Raster, diagonal: bool = True, zero_background: bool = False) -> Raster:
    """Patches of equal neighbouring cells, numbered in row order."""
    n = neighbourhood(raster).filter(F.col("z").isNotNull())
    if zero_background:
        n = n.filter("z <> 0")
    steps = [s for s in AROUND if diagonal or not (s[0] and s[1])]
    to = F.array(*[F.when(F.get("n", F.lit(at)) == F.col("z"), cell_id(F.col("row") + dr, F.col("col") + dc)) for dr, dc, at in steps])
    cells = n.select(cell_id().alias("id"), F.filter(to, lambda x: x.isNotNull()).alias("to"))
    roots = components(cells.select("id"), cells.select(F.col("id").alias("a"), F.explode("to").alias("b")))
    number = ranked(roots.select(F.col("root").alias("_r")).distinct(), [F.col("_r")])  # in the order of the patches' first cells
    return _by_id(roots.join(number, F.col("root") == F.col("_r")), F.col("n"))


def sink(dem: Raster) -> Raster:
    """Depressions, each with a number of its own."""
    deep = dense(depth_in_sink(dem))
    return clump(deep.select("row", "col", F.when(F.col("z").isNotNull(), 1.0).alias("z")))


def map_off_terrain_objects(dem: Raster, max_slope: float = 40.0, min_size: int = 1) -> Raster:
    """Patches that no step steeper than ``max_slope`` degrees leads into, numbered in row order; those of fewer than ``min_size`` cells are 0."""
    n = neighbourhood(dem).filter(F.col("z").isNotNull())
    gentle = [F.when(F.abs(F.get("n", F.lit(at)) - F.col("z")) <= F.tan(F.radians(F.lit(max_slope))) * sqrt(dr * dr + dc * dc), cell_id(F.col("row") + dr, F.col("col") + dc)) for dr, dc, at in AROUND]
    cells = n.select(cell_id().alias("id"), F.filter(F.array(*gentle), lambda x: x.isNotNull()).alias("to"))
    roots = written(components(cells.select("id"), cells.select(F.col("id").alias("a"), F.explode("to").alias("b"))), "roots")
    large = roots.groupBy(F.col("root").alias("_r")).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= min_size).select("_r")
    number = ranked(large, [F.col("_r")])
    return _by_id(roots.join(number, F.col("root") == F.col("_r"), "left"), F.coalesce("n", F.lit(0)))
