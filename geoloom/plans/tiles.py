"""Whole tiles as numpy arrays, for what windows can't express."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from geoloom.plans.stencil import TILE, tiled


def by_tile(raster: DataFrame, halo: int, fn: Callable[[np.ndarray, tuple[int, int]], dict[str, np.ndarray]], schema: str, value: str = "z", tile: int = TILE) -> DataFrame:
    """Applies ``fn`` to each tile with its halo; keeps what it returns for the tile's own cells.

    fn(z, (row, col) of the array's corner) returns an array of the same shape for
    each column of ``schema`` but row and col. NULL is NaN. A group is bounded by (tile + 2·halo)² cells.
    """

    def run(key: tuple, cells: pd.DataFrame) -> pd.DataFrame:
        r0, c0 = int(cells["row"].min()), int(cells["col"].min())
        r, c = cells["row"].to_numpy() - r0, cells["col"].to_numpy() - c0
        z = np.full((r.max() + 1, c.max() + 1), np.nan)
        z[r, c] = cells[value].to_numpy(dtype=float, na_value=np.nan)
        out = fn(z, (r0, c0))
        own = (cells["row"].to_numpy() // tile == key[0]) & (cells["col"].to_numpy() // tile == key[1])
        got = pd.DataFrame({"row": cells["row"].to_numpy()[own], "col": cells["col"].to_numpy()[own]})
        for k, v in out.items():
            got[k] = v[r[own], c[own]]
        return got.replace({np.nan: None}) if got.isna().any().any() else got

    return tiled(raster.select("row", "col", value), halo, tile).groupBy("tr", "tc").applyInPandas(run, schema)
