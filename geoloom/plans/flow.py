"""Flow over a weighted acyclic graph of cells, settled tile by tile."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.plans.lineage import written
from geoloom.plans.stencil import TILE

_SCHEMA = "kind int, id long, x double, pending int, start double, loss double, eff double, dst array<long>, w array<double>"


def settle(cells: DataFrame, edges: DataFrame, tile: int = TILE) -> DataFrame:
    """id, x with x(v) = start(v) + Σ w · max(x(u) - loss(u), 0) · eff(u) over the edges u → v.

    cells: id (row · 2^32 + col), start, loss, eff; edges: src, dst, w. Inside a tile cells are settled in
    topological order; what crosses an edge of a tile waits for the next round. A cell is
    settled once and then leaves the state, so what a round writes shrinks and rounds are as many as
    a path crosses tiles, not cells.
    """
    at = lambda c: F.struct(F.floor(F.shiftright(c, 32) / tile).alias("r"), F.floor(F.col(c).bitwiseAND(F.lit((1 << 32) - 1)) / tile).alias("c"))
    known = edges.join(cells.select(F.col("id").alias("_d")), F.col("dst") == F.col("_d"), "left_semi")
    out = known.groupBy(F.col("src").alias("_s")).agg(F.collect_list("dst").alias("dst"), F.collect_list(F.col("w").cast("double")).alias("w"))  # eight at most
    into = known.groupBy(F.col("dst").alias("_t")).agg(F.count(F.lit(1)).cast("int").alias("pending"))
    j = cells.join(out, F.col("id") == F.col("_s"), "left").join(into, F.col("id") == F.col("_t"), "left")
    blank = lambda kind: F.array().cast(kind)
    state = written(j.select(F.lit(1).alias("kind"), "id", F.col("start").cast("double").alias("x"), F.coalesce("pending", F.lit(0)).alias("pending"), F.col("start").cast("double").alias("start"), F.col("loss").cast("double").alias("loss"), F.col("eff").cast("double").alias("eff"), F.coalesce("dst", blank("array<long>")).alias("dst"), F.coalesce("w", blank("array<double>")).alias("w")), "flow")

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        wait = part[part["kind"] == 1]
        ids, x, pending = wait["id"].tolist(), wait["x"].tolist(), wait["pending"].tolist()
        loss, eff, dst, w = wait["loss"].tolist(), wait["eff"].tolist(), wait["dst"].tolist(), wait["w"].tolist()
        place = {v: k for k, v in enumerate(ids)}
        sent = part[part["kind"] == 2]
        for v, got in zip(sent["id"].tolist(), sent["x"].tolist(), strict=True):
            x[place[v]] += got
            pending[place[v]] -= 1
        ready = [k for k, n in enumerate(pending) if n == 0]
        done = np.zeros(len(ids), bool)
        far_id, far_x = [], []
        while ready:
            k = ready.pop()
            done[k] = True
            give = max(x[k] - loss[k], 0.0) * eff[k]
            for v, weight in zip(dst[k], w[k], strict=True):
                if v in place:
                    i = place[v]
                    x[i] += give * weight
                    pending[i] -= 1
                    if not pending[i]:
                        ready.append(i)
                else:
                    far_id.append(v)
                    far_x.append(give * weight)
        wait = wait.assign(x=x, pending=pending, kind=np.where(done, 0, 1).astype("int32"))
        if not far_id:
            return wait
        k = len(far_id)
        sent = pd.DataFrame({"kind": np.full(k, 2, "int32"), "id": far_id, "x": far_x, "pending": np.zeros(k, "int32"), "start": 0.0, "loss": 0.0, "eff": 0.0, "dst": [[]] * k, "w": [[]] * k})
        return pd.concat([wait, sent[wait.columns]])

    settled: list[DataFrame] = []
    while True:
        now = written(state.withColumn("_t", at("id")).groupBy("_t").applyInPandas(lambda key, part: run(key, part.drop(columns="_t")), _SCHEMA), "flow")
        settled.append(now.filter("kind = 0").select("id", "x"))
        state = now.filter("kind <> 0")
        if not now.filter("kind = 2").limit(1).count():
            break
    total = settled[0]
    for s in settled[1:]:
        total = total.union(s)
    return total
