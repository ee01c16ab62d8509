"""Planar overlay of polygon layers.

Polygons of the two layers meet in square bins; a feature's pieces are computed from it and the features
it meets, so a group is bounded by what overlaps one feature. Dissolving cancels shared edges by a join.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom.functions import planar
from geoloom.operators.vector import _binned, envelope

_PIECES = "array<array<array<struct<x: double, y: double>>>>"


def _boxed(layer: DataFrame, size: float, fid: str, parts: str) -> DataFrame:
    boxes = layer.select("fid", "parts").join(envelope(layer), "fid")
    b = _binned(boxes, size, "min_x", "min_y", "max_x", "max_y")
    return b.select("bx", "by", F.col("fid").alias(fid), F.col("parts").alias(parts), *[F.col(c).alias(f"{fid}_{c}") for c in ("min_x", "min_y", "max_x", "max_y")])


def meeting(a: DataFrame, b: DataFrame, size: float) -> DataFrame:
    """a, b, pa, pb: the pairs of features whose envelopes overlap, each once (in the bin of its overlap's corner)."""
    j = _boxed(a, size, "a", "pa").join(_boxed(b, size, "b", "pb"), ["bx", "by"])
    j = j.filter("a_min_x < b_max_x AND b_min_x < a_max_x AND a_min_y < b_max_y AND b_min_y < a_max_y")
    corner = lambda c: F.floor(F.greatest(f"a_{c}", f"b_{c}") / size)
    return j.filter((F.col("bx") == corner("min_x")) & (F.col("by") == corner("min_y"))).select("a", "b", "pa", "pb")


def _rings(parts) -> planar.Rings:
    return [[(p["x"], p["y"]) for p in r] for r in parts]


def _told(found: list[planar.Rings]) -> list:
    return [[[{"x": x, "y": y} for x, y in r] for r in rings] for rings in found]


def _pieces(own: Column, others: Column, common: bool) -> Column:
    """The pieces of ``own`` in (or outside) any of ``others``, each an array of rings."""

    def of(a: pd.Series, b: pd.Series) -> pd.Series:
        keep = (lambda s: s[0] and any(s[1:])) if common else (lambda s: s[0] and not any(s[1:]))
        return pd.Series([_told(planar.overlay([_rings(x), *(_rings(o) for o in y)], keep)) for x, y in zip(a, b, strict=True)])

    return F.pandas_udf(of, _PIECES)(own, others)


def intersect(a: DataFrame, b: DataFrame, size: float) -> DataFrame:
    """fid1, fid2, parts: what two features of the layers have in common; a row for each piece."""
    m = meeting(a, b, size)
    p = m.select(F.col("a").alias("fid1"), F.col("b").alias("fid2"), F.explode(_pieces(F.col("pa"), F.array("pb"), True)).alias("parts"))
    return p.filter("size(parts) > 0")


def difference(a: DataFrame, b: DataFrame, size: float) -> DataFrame:
    """fid, parts: the pieces of each feature of ``a`` that no feature of ``b`` covers."""
    m = meeting(a, b, size).groupBy(F.col("a").alias("_a")).agg(F.collect_list("pb").alias("others"))  # what overlaps one feature
    j = a.select("fid", "parts").join(m, F.col("fid") == F.col("_a"), "left")
    cut = j.filter("_a IS NOT NULL").select("fid", F.explode(_pieces(F.col("parts"), F.col("others"), False)).alias("parts"))
    return cut.unionByName(j.filter("_a IS NULL").select("fid", "parts")).filter("size(parts) > 0")


def symmetrical_difference(a: DataFrame, b: DataFrame, size: float) -> DataFrame:
    """fid1, fid2 (one is NULL), parts: the pieces in one layer only."""
    none = F.lit(None).cast("long")
    first = difference(a, b, size).select(F.col("fid").cast("long").alias("fid1"), none.alias("fid2"), "parts")
    return first.union(difference(b, a, size).select(none, F.col("fid").cast("long"), "parts"))


def union(a: DataFrame, b: DataFrame, size: float) -> DataFrame:
    """fid1, fid2, parts: all pieces, with the features of the layers they are of."""
    both = intersect(a, b, size).select(F.col("fid1").cast("long").alias("fid1"), F.col("fid2").cast("long").alias("fid2"), "parts")
    return both.union(symmetrical_difference(a, b, size))


def dissolve(coverage: DataFrame, by: str | None = None) -> DataFrame:
    """The outer edges of polygons that share whole edges, as rings: the field, ring (number of its first corner), area.

    An edge that two polygons of a value share cancels; the others are joined end to end.
    """
    from geoloom.plans.graph import components
    from geoloom.plans.lineage import written

    key = F.col(by) if by else F.lit(0)
    ring = F.explode("parts").alias("r")
    r = coverage.select(key.alias("k"), ring)
    turned = F.concat(F.slice("r", 2, F.size("r") - 1), F.slice("r", 1, 1))
    e = r.select("k", F.explode(F.zip_with("r", turned, lambda a, b: F.struct(a.alias("a"), b.alias("b")))).alias("e")).filter("e.a <> e.b")
    lesser = F.col("e.a") < F.col("e.b")
    e = e.select("k", F.when(lesser, F.col("e.a")).otherwise(F.col("e.b")).alias("p"), F.when(lesser, F.col("e.b")).otherwise(F.col("e.a")).alias("q"))
    outer = written(e.groupBy("k", "p", "q").agg(F.count(F.lit(1)).alias("n")).filter("n % 2 = 1").select("k", "p", "q"), "edges")
    ids = lambda c: F.xxhash64("k", c)
    links = outer.select(ids("p").alias("a"), ids("q").alias("b"))
    roots = components(links.select(F.col("a").alias("id")).union(links.select("b")).distinct(), links)

    def chain(part: pd.DataFrame) -> pd.DataFrame:
        edges = [((p["x"], p["y"]), (q["x"], q["y"])) for p, q in zip(part["p"], part["q"], strict=True)]
        near: dict = {}
        for a, b in edges:
            near.setdefault(a, []).append(b)
            near.setdefault(b, []).append(a)
        rows, left = [], {frozenset(x) for x in edges}
        for a, b in sorted(edges):
            if frozenset((a, b)) not in left:
                continue
            path, here, to = [a], a, b
            while True:
                left.discard(frozenset((here, to)))
                if to == a:
                    break
                path.append(to)
                here, to = to, next(v for v in near[to] if frozenset((to, v)) in left)
            rows.append((part["k"].iloc[0], [{"x": x, "y": y} for x, y in path], abs(planar.area(path))))
        return pd.DataFrame(rows, columns=["k", "ring", "area"])

    kind = outer.schema["k"].dataType.simpleString()
    named = outer.withColumn("_i", ids("p")).join(roots.withColumnRenamed("id", "_r"), F.col("_i") == F.col("_r")).select("k", "p", "q", "root")
    out = named.groupBy("root").applyInPandas(lambda part: chain(part), f"k {kind}, ring array<struct<x: double, y: double>>, area double")
    return out.withColumnRenamed("k", by or "all")
