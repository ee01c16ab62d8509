"""Traversal of forests and graphs by doubling."""

from __future__ import annotations

from collections.abc import Callable
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom.plans.lineage import written

Combine = Callable[[str, str], Column]


#: Rounds after which a path has doubled to more steps than there can be cells.
ROUNDS = 48


def _pending(df: DataFrame, done: int) -> bool:
    """Whether paths go on after ``done`` rounds; those of a cycle would without end."""
    if done > ROUNDS:
        raise ValueError("the flow paths have a cycle")
    return bool(df.filter("next IS NOT NULL").limit(1).count())


def downstream(nodes: DataFrame, carry: dict[str, Combine]) -> DataFrame:
    """Carries values along the path of each node to its end.

    nodes: id, next (NULL at an end) and the carried columns, which say what
    the step from a node to its next contributes; ``carry`` combines a column of the
    path so far with that of the path on. Adds ``last``, the path's end. The path
    doubles each round, so ⌈log₂ longest⌉ rounds of one join do.
    """
    names = list(carry)
    state = nodes.select("id", "next", F.coalesce("next", "id").alias("last"), *names)
    for done in count():
        state = written(state, "paths")
        if not _pending(state, done):
            return state.drop("next")
        on = state.select(*[F.col(c).alias(f"_on_{c}") for c in ("id", "next", "last", *names)])
        j = state.join(on, F.col("next") == F.col("_on_id"), "left")
        hop = F.col("_on_id").isNotNull()
        state = j.select("id", F.when(hop, F.col("_on_next")).alias("next"), F.when(hop, F.col("_on_last")).otherwise(F.col("last")).alias("last"), *[F.when(hop, carry[c](c, f"_on_{c}")).otherwise(F.col(c)).alias(c) for c in names])


def upstream(nodes: DataFrame, sums: list[str], maxima: dict[str, str] | None = None) -> DataFrame:
    """Totals over all nodes whose path passes a node, itself included.

    nodes: id, next (NULL at an end), the summed columns, and for each entry value:
    length of ``maxima`` the column ``length`` of the step to next; value becomes the
    largest value + path length. S_{k+1}(v) combines S_k(v) with S_k of the nodes whose 2^k-th next is v.
    """
    maxima = maxima or {}
    lengths = sorted(set(maxima.values()))
    state = nodes.select("id", "next", *sums, *maxima, *lengths)
    for done in count():
        state = written(state, "totals")
        if not _pending(state, done):
            return state.drop("next", *lengths)
        gain = state.filter("next IS NOT NULL").groupBy("next").agg(*[F.sum(c).alias(f"_gain_{c}") for c in sums], *[F.max(F.col(c) + F.col(length)).alias(f"_gain_{c}") for c, length in maxima.items()]).withColumnRenamed("next", "_to")
        hop = state.select(*[F.col(c).alias(f"_on_{c}") for c in ("id", "next", *lengths)])
        j = state.join(gain, F.col("id") == F.col("_to"), "left").join(hop, F.col("next") == F.col("_on_id"), "left")
        state = j.select(
            "id", F.col("_on_next").alias("next"),
            *[(F.col(c) + F.coalesce(f"_gain_{c}", F.lit(0))).alias(c) for c in sums],
            *[F.greatest(c, f"_gain_{c}").alias(c) for c in maxima],
            *[(F.col(c) + F.coalesce(f"_on_{c}", F.lit(0.0))).alias(c) for c in lengths],
        )


def apart(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that is not broadcast: ids take a few bits a row in a file, so by the file's size
    Spark would send millions of rows through the driver."""
    return df.hint("merge")


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, root for all ``nodes`` (id); root is the least id reachable over ``edges`` (a, b).

    Each round takes the least root among neighbours, then jumps to the root's root.
    """
    both = written(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "links")
    state = written(nodes.select("id", F.col("id").alias("root")).distinct(), "roots")
    while True:
        near = both.join(apart(state), F.col("b") == F.col("id")).groupBy("a").agg(F.min("root").alias("m"))
        hooked = state.join(apart(near), F.col("id") == F.col("a"), "left").select("id", F.col("root").alias("old"), F.least("root", F.coalesce("m", "root")).alias("root"))
        # a root that hooked elsewhere takes its members along
        better = hooked.groupBy("old").agg(F.min("root").alias("m")).withColumnRenamed("old", "_o")
        hooked = hooked.join(apart(better), F.col("old") == F.col("_o")).select("id", "old", F.col("m").alias("root"))
        jump = hooked.select(F.col("id").alias("_i"), F.col("root").alias("_r"))
        now = written(hooked.join(apart(jump), F.col("root") == F.col("_i")).select("id", F.col("_r").alias("root"), (F.col("_r") != F.col("old")).alias("moved")), "roots")
        if not now.filter("moved").limit(1).count():
            return now.drop("moved")
        state = now.drop("moved")
