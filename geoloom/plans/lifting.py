"""Questions about places along flow paths, by jumps of powers of two (binary lifting)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom.plans.graph import ROUNDS
from geoloom.plans.lineage import written


def jumps(nodes: DataFrame) -> list[DataFrame]:
    """For k = 0, 1, … the tables (id, to, len): where 2^k steps along the path lead, and how long they are.

    nodes: id, next (NULL at an end), step. As many tables as the longest path has binary digits.
    """
    level = written(nodes.filter("next IS NOT NULL").select("id", F.col("next").alias("to"), F.col("step").alias("len")), "jumps")
    out = []
    while level.limit(1).count():
        out.append(level)
        if len(out) > ROUNDS:
            raise ValueError("the flow paths have a cycle")
        on = level.select(F.col("id").alias("_i"), F.col("to").alias("_to"), F.col("len").alias("_len"))
        level = written(level.join(on, F.col("to") == F.col("_i")).select("id", F.col("_to").alias("to"), (F.col("len") + F.col("_len")).alias("len")), "jumps")
    return out


def _jumped(state: DataFrame, level: DataFrame) -> DataFrame:
    """state with _to and _len of its column ``at`` (NULL beyond the end)."""
    return state.join(level.select(F.col("id").alias("_i"), F.col("to").alias("_to"), F.col("len").alias("_len")), F.col("at") == F.col("_i"), "left").drop("_i")


def first_below(levels: list[DataFrame], starts: DataFrame, values: DataFrame) -> DataFrame:
    """For each start (key, at, bar) the first cell of the path with a value <= bar: key, at, len; no row without one.

    ``values`` (id, v) must not rise along paths. The largest jumps that stay above the bar are taken first.
    """
    v = values.select(F.col("id").alias("_v"), F.col("v").alias("_value"))
    state = starts.withColumn("len", F.lit(0.0))
    for level in reversed(levels):
        j = _jumped(state, level).join(v, F.col("_to") == F.col("_v"), "left")
        go = F.col("_value") > F.col("bar")
        state = written(j.select("key", "bar", F.when(go, F.col("_to")).otherwise(F.col("at")).alias("at"), (F.col("len") + F.when(go, F.col("_len")).otherwise(0.0)).alias("len")), "lifted")
    own = state.join(v, F.col("at") == F.col("_v"))
    done = own.filter("_value <= bar").select("key", "at", "len")
    if not levels:
        return done
    last = _jumped(own.filter("_value > bar").drop("_v", "_value"), levels[0]).filter("_to IS NOT NULL")
    return done.union(last.select("key", F.col("_to").alias("at"), (F.col("len") + F.col("_len")).alias("len")))


def paths(levels: list[DataFrame], starts: DataFrame) -> DataFrame:
    """key, id, len, steps for every cell on the path of each start (key, at): the set doubles each round."""
    out = written(starts.select("key", F.col("at").alias("id"), F.lit(0.0).alias("len"), F.lit(0).cast("long").alias("steps")), "paths")
    for k, level in enumerate(levels):
        on = level.select(F.col("id").alias("_i"), F.col("to").alias("_to"), F.col("len").alias("_len"))
        far = out.join(on, F.col("id") == F.col("_i")).select("key", F.col("_to").alias("id"), (F.col("len") + F.col("_len")).alias("len"), (F.col("steps") + (1 << k)).alias("steps"))
        out = written(out.union(far), "paths")
    return out


def meetings(levels: list[DataFrame], pairs: DataFrame, depth: DataFrame) -> DataFrame:
    """For each pair (a, b) the lengths la and lb of their paths to where they meet, or to their ends if they don't.

    depth: (id, d), the steps from a cell to its end. The deeper one moves up to the other's
    depth, then both jump as long as they stay apart.
    """
    d = lambda c: depth.select(F.col("id").alias(f"_{c}"), F.col("d").alias(f"d{c}"))
    state = pairs.select("a", "b", F.col("a").alias("x"), F.col("b").alias("y"), F.lit(0.0).alias("la"), F.lit(0.0).alias("lb"))
    state = state.join(d("a"), F.col("a") == F.col("_a")).join(d("b"), F.col("b") == F.col("_b")).drop("_a", "_b")

    def move(s: DataFrame, level: DataFrame, x: str, length: str, when: Column) -> DataFrame:
        on = level.select(F.col("id").alias("_i"), F.col("to").alias("_to"), F.col("len").alias("_len"))
        j = s.withColumn("_go", when).join(on, F.col(x) == F.col("_i"), "left")
        go = F.col("_go") & F.col("_i").isNotNull()
        return j.withColumns({x: F.when(go, F.col("_to")).otherwise(F.col(x)), length: F.col(length) + F.when(go, F.col("_len")).otherwise(0.0)}).drop("_i", "_to", "_len", "_go")

    for k in range(len(levels) - 1, -1, -1):
        state = move(state, levels[k], "x", "la", F.col("da") - F.col("db") >= (1 << k)).withColumn("da", F.when(F.col("da") - F.col("db") >= (1 << k), F.col("da") - (1 << k)).otherwise(F.col("da")))
        state = move(state, levels[k], "y", "lb", F.col("db") - F.col("da") >= (1 << k)).withColumn("db", F.when(F.col("db") - F.col("da") >= (1 << k), F.col("db") - (1 << k)).otherwise(F.col("db")))
        state = written(state, "lifted")
    for k in range(len(levels) - 1, -1, -1):
        on = lambda c, k=k: levels[k].select(F.col("id").alias(f"_i{c}"), F.col("to").alias(f"_to{c}"), F.col("len").alias(f"_len{c}"))
        j = state.join(on("x"), F.col("x") == F.col("_ix"), "left").join(on("y"), F.col("y") == F.col("_iy"), "left")
        go = (F.col("x") != F.col("y")) & F.coalesce(F.col("_tox") != F.col("_toy"), F.lit(False))
        state = written(j.select("a", "b", F.when(go, F.col("_tox")).otherwise(F.col("x")).alias("x"), F.when(go, F.col("_toy")).otherwise(F.col("y")).alias("y"), (F.col("la") + F.when(go, F.col("_lenx")).otherwise(0.0)).alias("la"), (F.col("lb") + F.when(go, F.col("_leny")).otherwise(0.0)).alias("lb"), "da", "db"), "lifted")
    if not levels:
        return state.select("a", "b", "la", "lb")
    # one step short of the meeting place, or at two ends
    final = move(state, levels[0], "x", "la", F.col("x") != F.col("y"))
    other = F.col("y") != F.col("_x0")
    final = move(final.withColumn("_x0", F.col("x")), levels[0], "y", "lb", other)
    return final.select("a", "b", "la", "lb")
