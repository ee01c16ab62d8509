"""Inputs of the registered queries, made from the TPC-H-like tables, and helpers for their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.plans.stencil import dense

Query = Callable[[SparkSession, str], DataFrame]

#: name: (function, DuckDB SQL or None).
REGISTERED: dict[str, tuple[Query, str | None]] = {}

SIDE = 50

_CELL = f'CAST(l_partkey % {SIDE} AS INT) AS "row", CAST(l_orderkey % {SIDE} AS INT) AS "col"'

#: Inputs as DuckDB SQL; absent cells equal NoData.
INPUTS = {
    "dem": f"SELECT {_CELL}, MAX(l_extendedprice) AS z FROM lineitem GROUP BY 1, 2",
    "dem2": f"SELECT {_CELL}, MIN(l_quantity) AS z FROM lineitem GROUP BY 1, 2",
    "dem_gappy": f"SELECT {_CELL}, MAX(CASE WHEN l_quantity > 45 THEN l_extendedprice END) AS z FROM lineitem GROUP BY 1, 2",
    "zones": f"SELECT {_CELL}, CAST(COUNT(*) % 7 AS DOUBLE) AS z FROM lineitem GROUP BY 1, 2",
    "unit": f"SELECT {_CELL}, MIN(l_quantity) / 50.0 AS z FROM lineitem GROUP BY 1, 2",
    "flags": f"SELECT {_CELL}, CAST(COUNT(*) % 2 AS DOUBLE) AS z FROM lineitem GROUP BY 1, 2",
    "flags2": f"SELECT {_CELL}, CAST(MIN(l_linenumber) % 2 AS DOUBLE) AS z FROM lineitem GROUP BY 1, 2",
    "bands": f"SELECT {_CELL}, CAST(l_linenumber - 1 AS INT) AS band, MAX(l_extendedprice) AS z FROM lineitem GROUP BY 1, 2, 3",
    "points": "SELECT o_orderkey AS fid, CAST(o_custkey AS DOUBLE) AS x, o_totalprice / 1000.0 AS y, o_totalprice AS z, o_orderpriority AS cls FROM orders",
    "lidar": "SELECT CAST(l_partkey AS DOUBLE) AS x, CAST(l_orderkey % 1000 AS DOUBLE) AS y, l_extendedprice AS z, CAST(l_quantity AS INT) AS intensity, CAST(l_linenumber AS INT) AS return_no, CASE l_returnflag WHEN 'A' THEN 2 WHEN 'R' THEN 5 ELSE 1 END AS classification, l_suppkey AS point_source_id FROM lineitem",
    "edges": "SELECT o_orderkey AS src, CAST(FLOOR(o_orderkey / 3.0) AS BIGINT) AS dst FROM orders WHERE o_orderkey > 0",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cells(spark: SparkSession, sf_dir: str, value: Column, *more: Column) -> DataFrame:
    by = [(F.col("l_partkey") % SIDE).cast("int").alias("row"), (F.col("l_orderkey") % SIDE).cast("int").alias("col"), *more]
    return table(spark, sf_dir, "lineitem").groupBy(*by).agg(value.cast("double").alias("z"))


VALUES: dict[str, Callable[[], Column]] = {
    "dem": lambda: F.max("l_extendedprice"),
    "dem2": lambda: F.min("l_quantity"),
    "dem_gappy": lambda: F.max(F.when(F.col("l_quantity") > 45, F.col("l_extendedprice"))),
    "zones": lambda: F.count(F.lit(1)) % 7,
    "unit": lambda: F.min("l_quantity") / 50.0,
    "flags": lambda: F.count(F.lit(1)) % 2,
    "flags2": lambda: F.min("l_linenumber") % 2,
}


def raster(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A fixture as a dense raster."""
    return dense(cells(spark, sf_dir, VALUES[name]()))


def bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells(spark, sf_dir, F.max("l_extendedprice"), (F.col("l_linenumber") - 1).cast("int").alias("band"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("fid"), F.col("o_custkey").cast("double").alias("x"), (F.col("o_totalprice") / 1000.0).alias("y"), F.col("o_totalprice").alias("z"), F.col("o_orderpriority").alias("cls"))


def lidar(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = table(spark, sf_dir, "lineitem")
    cls = F.when(F.col("l_returnflag") == "A", 2).when(F.col("l_returnflag") == "R", 5).otherwise(1)
    return i.select(F.col("l_partkey").cast("double").alias("x"), (F.col("l_orderkey") % 1000).cast("double").alias("y"), F.col("l_extendedprice").alias("z"), F.col("l_quantity").cast("int").alias("intensity"), F.col("l_linenumber").cast("int").alias("return_no"), cls.alias("classification"), F.col("l_suppkey").alias("point_source_id"))


def off(digits: int) -> float:
    """A nudge that takes values off the half way points of rounding, where engines' last bits decide."""
    return 10.0 ** -(digits + 3)


def tidy(df: DataFrame, *values: str, digits: int = 6) -> DataFrame:
    """Rounded results without NoData cells."""
    values = values or ("z",)
    return df.filter(F.col(values[0]).isNotNull()).select("row", "col", *[(F.round(F.col(v) + F.lit(off(digits)), digits) + F.lit(0.0)).alias(v) for v in values])


def tidy_sql(inner: str, *values: str, digits: int = 6) -> str:
    values = values or ("z",)
    return f'SELECT "row", "col", {", ".join(f"round(CAST({v} AS DOUBLE) + {off(digits)}, {digits}) + 0.0 AS {v}" for v in values)} FROM ({inner}) q WHERE {values[0]} IS NOT NULL'


def with_inputs(sql: str, *names: str, more: str = "") -> str:
    ctes = ", ".join(f"{n} AS ({INPUTS[n]})" for n in names)
    return f"WITH RECURSIVE {ctes}{', ' + more if more else ''} {sql}"


def register(name: str, fn: Query, sql: str | None = None) -> None:
    if name in REGISTERED:
        raise ValueError(f"two queries named {name}")
    REGISTERED[name] = fn, sql


def local(name: str, source: str, op: Callable[[DataFrame], DataFrame], sql: str | None, *values: str) -> None:
    """A raster in, a raster out; ``sql`` selects row, col, z from the input of that name."""
    register(name, lambda s, d: tidy(op(raster(s, d, source)), *values), None if sql is None else with_inputs(tidy_sql(sql, *values), source))


def local2(name: str, a: str, b: str, op: Callable[[DataFrame, DataFrame], DataFrame], sql: str | None, *values: str) -> None:
    """Two rasters in; ``sql`` selects from ``p``: row, col, a, b."""
    pair = f"p AS (SELECT {a}.\"row\", {a}.\"col\", {a}.z AS a, {b}.z AS b FROM {a} JOIN {b} ON {a}.\"row\" = {b}.\"row\" AND {a}.\"col\" = {b}.\"col\")" if a != b else ""
    register(name, lambda s, d: tidy(op(raster(s, d, a), raster(s, d, b)), *values), None if sql is None else with_inputs(tidy_sql(sql, *values), a, b, more=pair))


def neighbours_sql(source: str, reach: int) -> str:
    """CTE ``nb``: row, col, z and the list n of the values around (NULL where there is none), row by row."""
    k = 2 * reach + 1
    return (
        f'o AS (SELECT i, i // {k} - {reach} AS dr, i % {k} - {reach} AS dc FROM range(0, {k * k}) r(i)), '
        f'nb AS (SELECT a."row", a."col", a.z, list(b.z ORDER BY o.i) AS n FROM {source} a CROSS JOIN o LEFT JOIN {source} b ON b."row" = a."row" + o.dr AND b."col" = a."col" + o.dc GROUP BY 1, 2, 3)'
    )


def window_sql(source: str, ry: int, rx: int) -> str:
    """CTE ``w``: a row for each cell (row, col, z) and valid neighbour value v in its window."""
    return f'w AS (SELECT a."row", a."col", a.z, b.z AS v, b."row" - a."row" AS dr, b."col" - a."col" AS dc FROM {source} a JOIN {source} b ON b."row" BETWEEN a."row" - {ry} AND a."row" + {ry} AND b."col" BETWEEN a."col" - {rx} AND a."col" + {rx} WHERE b.z IS NOT NULL)'
