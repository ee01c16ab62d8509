"""Queries of polygon overlay, on two layers of rectangles whose SQL is plain arithmetic."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.operators import overlay as op
from geoloom.operators.vector import polygon_area, rectangular_grid
from geoloom.queries.base import register, table
from geoloom.queries.stats import _r, rounded

#: First layer: rectangles spread so that they do not overlap each other; second: a lattice.
_A = "SELECT s_suppkey AS fid, CAST(s_suppkey % 10 * 30 AS DOUBLE) AS x0, CAST(s_suppkey // 10 * 25 AS DOUBLE) AS y0, 8.0 + s_suppkey % 17 AS w, 6.0 + s_suppkey % 13 AS h FROM supplier"
_B = "SELECT i AS fid, i % 6 * 37.0 AS x0, i // 6 * 31.0 AS y0, 37.0 AS w, 31.0 AS h FROM range(0, 24) t(i)"


def _first(s, d) -> DataFrame:
    b = table(s, d, "supplier").selectExpr("s_suppkey AS fid", "CAST(s_suppkey % 10 * 30 AS DOUBLE) AS x", "CAST(floor(s_suppkey / 10) * 25 AS DOUBLE) AS y", "CAST(8.0 + s_suppkey % 17 AS DOUBLE) AS w", "CAST(6.0 + s_suppkey % 13 AS DOUBLE) AS h")
    p = lambda x, y: F.struct(F.expr(x).alias("x"), F.expr(y).alias("y"))
    return b.select("fid", F.array(F.array(p("x", "y"), p("x + w", "y"), p("x + w", "y + h"), p("x", "y + h"))).alias("parts"))


def _second(s) -> DataFrame:
    return rectangular_grid(0.0, 0.0, 222.0, 124.0, 37.0, 31.0, s)


_PAIRS = f"p AS (SELECT a.fid AS fid1, b.fid AS fid2, least(a.x0 + a.w, b.x0 + b.w) - greatest(a.x0, b.x0) AS dx, least(a.y0 + a.h, b.y0 + b.h) - greatest(a.y0, b.y0) AS dy FROM ({_A}) a, ({_B}) b), i AS (SELECT fid1, fid2, dx * dy AS area FROM p WHERE dx > 0 AND dy > 0)"
_ONLY_A = f"SELECT fid AS fid1, CAST(NULL AS BIGINT) AS fid2, w * h - coalesce((SELECT sum(area) FROM i WHERE fid1 = fid), 0) AS area FROM ({_A}) q"
_ONLY_B = f"SELECT CAST(NULL AS BIGINT) AS fid1, fid AS fid2, w * h - coalesce((SELECT sum(area) FROM i WHERE fid2 = fid), 0) AS area FROM ({_B}) q"


def _areas(df: DataFrame, *by: str) -> DataFrame:
    return rounded(df.withColumn("area", polygon_area()).groupBy(*by).agg(F.sum("area").alias("area")).filter("area > 0.000001"))


_sql = lambda inner: f"WITH {_PAIRS} SELECT CAST(fid1 AS BIGINT) AS fid1, CAST(fid2 AS BIGINT) AS fid2, {_r('area', 'area')} FROM ({inner}) q WHERE area > 0.000001"
register("gis_intersect", lambda s, d: _areas(op.intersect(_first(s, d), _second(s), 64.0), "fid1", "fid2"), _sql("SELECT * FROM i"))
register("gis_difference", lambda s, d: _areas(op.difference(_first(s, d), _second(s), 64.0), "fid"), f"WITH {_PAIRS} SELECT fid1 AS fid, {_r('area', 'area')} FROM ({_ONLY_A}) q WHERE area > 0.000001")
register("gis_symmetrical_difference", lambda s, d: _areas(op.symmetrical_difference(_first(s, d), _second(s), 64.0), "fid1", "fid2"), _sql(f"{_ONLY_A} UNION ALL {_ONLY_B}"))
register("gis_union", lambda s, d: _areas(op.union(_first(s, d), _second(s), 64.0), "fid1", "fid2"), _sql(f"SELECT * FROM i UNION ALL {_ONLY_A} UNION ALL {_ONLY_B}"))
register(
    "gis_dissolve",
    lambda s, d: rounded(op.dissolve(_second(s).withColumn("cls", F.floor(F.col("fid") / 6) % 2), "cls").groupBy("cls").agg(F.count(F.lit(1)).alias("rings"), F.sum("area").alias("area"))),
    f"SELECT CAST(c AS BIGINT) AS cls, CAST(2 AS BIGINT) AS rings, {_r('12 * 37.0 * 31.0', 'area')} FROM range(0, 2) t(c)",
)
