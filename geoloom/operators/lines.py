"""Lines in Boolean rasters: hit-and-miss patterns of the eight neighbours.

Neighbours are numbered NE, E, SE, S, SW, W, NW, N. Patterns are matched at all cells at
once, one rotation after the other. A tile is read with a halo as wide as the
number of steps that follow, so many steps need one exchange and the result does not depend on tiles.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom.functions.grids import AROUND, shifted
from geoloom.plans.lineage import written
from geoloom.plans.stencil import TILE, neighbourhood
from geoloom.plans.tiles import by_tile

Raster = DataFrame
#: Rounds of thinning between two exchanges of tile edges.
ROUNDS = 8


def boolean(raster: Raster) -> Raster:
    """1 above 0, 0 elsewhere; NoData stays."""
    return raster.select("row", "col", F.when(F.col("z").isNotNull(), (F.col("z") > 0).cast("double")).alias("z"))


def corner_detection(raster: Raster) -> Raster:
    """1 where two side neighbours at a right angle are set and the three opposite ones are not."""
    n = neighbourhood(boolean(raster))
    near: list[Column] = [F.coalesce(F.get("n", F.lit(at)), F.lit(0.0)) == 1 for _, _, at in AROUND]
    found = F.lit(False)
    for q in range(0, 8, 2):
        found = found | (near[(q + 1) % 8] & near[(q + 7) % 8] & ~near[(q + 3) % 8] & ~near[(q + 4) % 8] & ~near[(q + 5) % 8])
    return n.select("row", "col", F.when(F.col("z").isNotNull(), ((F.col("z") == 1) & found).cast("double")).alias("z"))


def _cleared(z: np.ndarray, patterns: list[tuple[list[int], list[int]]]) -> np.ndarray:
    """``z`` with 0 at the cells that match one of ``patterns`` (neighbours that are 0, that are 1)."""
    near = [shifted(z, dr, dc) for dr, dc, _ in AROUND]
    gone = np.zeros(z.shape, bool)
    for off, on in patterns:
        hit = z == 1
        for i in off:
            hit = hit & (near[i % 8] == 0)
        for i in on:
            hit = hit & (near[i % 8] == 1)
        gone |= hit
    return np.where(gone, 0.0, z)


def thinned(z: np.ndarray, rounds: int) -> np.ndarray:
    """``rounds`` times four steps, each removing edge cells of one side and of one corner."""
    for _ in range(rounds):
        for a in range(0, 8, 2):
            side = ([6 + a, 7 + a, a], [4 + a, 3 + a, 2 + a])
            corner = ([7 + a, a, 1 + a], [3 + a, 5 + a])
            z = _cleared(z, [side, corner])
    return z


def line_thinning(raster: Raster, tile: int = TILE) -> Raster:
    """Lines one cell wide: cells are removed side by side until nothing changes."""
    state = written(boolean(raster), "thin")

    def run(z: np.ndarray, at: tuple[int, int]) -> dict[str, np.ndarray]:
        out = thinned(z, ROUNDS)
        return {"z": out, "moved": (out != z) & ~np.isnan(z)}

    while True:
        now = written(by_tile(state, 4 * ROUNDS, run, "row int, col int, z double, moved boolean", tile=tile), "thin")
        if not now.filter("moved").limit(1).count():
            return now.drop("moved")
        state = now.drop("moved")


def pruned(z: np.ndarray, iterations: int) -> np.ndarray:
    """Removes line ends: set cells with six zero neighbours in a row, by the eight directions."""
    for _ in range(iterations):
        for a in range(8):
            z = _cleared(z, [([4 + a + i for i in range(6)], [])])
    return z


def remove_spurs(raster: Raster, iterations: int = 10, tile: int = TILE) -> Raster:
    """Lines without side branches of up to ``iterations`` cells."""
    return by_tile(boolean(raster), 8 * iterations, lambda z, at: {"z": pruned(z, iterations)}, "row int, col int, z double", tile=tile)


def thicken_raster_line(raster: Raster) -> Raster:
    """Diagonal steps of a line closed: of the two cells beside the step the one above (with the smaller row) is set."""
    n = neighbourhood(raster)
    at = lambda i: F.coalesce(F.get("n", F.lit(i)), F.lit(0.0))
    # the empty cell above a step: its side and its lower neighbour are set, the cell between them diagonally is not
    step = lambda side, corner: (at(side) > 0) & (at(7) > 0) & (at(corner) <= 0)
    value = F.when((F.col("z") <= 0) & step(5, 8), at(5)).when((F.col("z") <= 0) & step(3, 6), at(3)).otherwise(F.col("z"))
    return n.select("row", "col", F.when(F.col("z").isNotNull(), value).alias("z"))
