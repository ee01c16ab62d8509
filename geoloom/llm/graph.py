"""Connected components of a graph given by links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.llm.common import discard, table


def _print(edges: DataFrame) -> tuple:
    return edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()[:]


#: Parts that the links of a hub are dealt in.
SALTS = 64


def _with_least(links: DataFrame) -> DataFrame:
    """u, v, m (the least v of u) for every link; the links of a hub are dealt in SALTS parts, each with a copy of m."""
    dealt = links.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int"))
    least = dealt.groupBy("u", "salt").agg(F.min("v").alias("m")).groupBy("u").agg(F.min("m").alias("m"), F.collect_set("salt").alias("salts"))
    return dealt.join(least.select("u", "m", F.explode("salts").alias("salt")), ["u", "salt"]).select("u", "v", "m")


def components(edges: DataFrame) -> DataFrame:
    """node, root for every node of ``edges`` (u, v: whole numbers); root is the least node reachable.

    Alternating large-star and small-star steps until nothing changes: each
    step hooks neighbours to the least one, so the number of links never grows
    and a few rounds suffice. Every round is a written table, and a round's table
    goes when the next one is written.
    """
    e = edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e = table(e, "links")
    seen = _print(e)
    while True:
        both = _with_least(e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v"))))
        large = both.filter("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        small = _with_least(large).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(large.groupBy("u").agg(F.min("v").alias("v"))).distinct()
        before, e = e, table(small, "stars")
        discard(before)
        now = _print(e)
        if now == seen:
            break
        seen = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select("v", "v").distinct())
