"""Numbers over a whole table without a task that holds it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoloom.plans.lineage import written


def _parts(df: DataFrame, keys: Sequence[Column]) -> tuple[DataFrame, Window]:
    """``df`` in ranges of ``keys``, written with the number of its range as _part."""
    named = df.select("*", *[k.alias(f"_k{i}") for i, k in enumerate(keys)])
    cols = [F.col(f"_k{i}") for i in range(len(keys))]
    dealt = written(named.repartitionByRange(*cols).withColumn("_part", F.spark_partition_id()), "ranges")
    return dealt, Window.partitionBy("_part").orderBy(*cols)


def ranked(df: DataFrame, keys: Sequence[Column], name: str = "n") -> DataFrame:
    """``df`` with its number (from 1) in the order of ``keys``, which must tell rows apart.

    Rows are numbered within ranges; what a range starts with is a running
    sum over as many rows as there are ranges.
    """
    dealt, w = _parts(df, keys)
    sizes = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    before = F.coalesce(F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select(F.col("_part").alias("_p"), before.alias("_before"))
    out = dealt.withColumn("_i", F.row_number().over(w)).join(F.broadcast(starts), F.col("_part") == F.col("_p"))
    return out.withColumn(name, F.col("_before") + F.col("_i")).select(*df.columns, name)


def running(df: DataFrame, keys: Sequence[Column], sums: dict[str, Column]) -> DataFrame:
    """``df`` with running sums (the row itself included) in the order of ``keys``, which must tell rows apart."""
    valued = df.withColumns({f"_v{i}": v for i, v in enumerate(sums.values())})
    dealt, w = _parts(valued, keys)
    totals = dealt.groupBy("_part").agg(*[F.sum(f"_v{i}").alias(f"_t{i}") for i in range(len(sums))])
    prior = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(F.col("_part").alias("_p"), *[F.coalesce(F.sum(f"_t{i}").over(prior), F.lit(0)).alias(f"_b{i}") for i in range(len(sums))])
    rows = w.rowsBetween(Window.unboundedPreceding, 0)
    out = dealt.join(F.broadcast(starts), F.col("_part") == F.col("_p"))
    return out.select(*df.columns, *[(F.col(f"_b{i}") + F.sum(f"_v{i}").over(rows)).alias(k) for i, k in enumerate(sums)])
