"""Components and segments: no table that grows with the input is broadcast, whatever its files say of its size."""

import random

from geoloom.operators import cloud
from geoloom.plans import graph
from geoloom.plans.lineage import written

BROADCAST = ("BroadcastHashJoin", "BroadcastNestedLoopJoin")


def test_nothing_is_broadcast(spark, monkeypatch):
    plans = []

    def noted(df, name):
        plans.append(df._jdf.queryExecution().sparkPlan().toString())
        return written(df, name)

    monkeypatch.setattr(graph, "written", noted)
    nodes = spark.range(2000).select("id")
    edges = spark.range(1999).selectExpr("id AS a", "id + 1 AS b").filter("a % 100 <> 99")
    got = {r.id: r.root for r in graph.components(nodes, edges).collect()}
    assert got == {i: i // 100 * 100 for i in range(2000)}
    assert len(plans) > 3 and not [p for p in plans if any(b in p for b in BROADCAST)]


def test_segments(spark):
    """Two planes with a step between them, and a place alone."""
    r = random.Random(1)
    low = [(x + r.random() / 4, y + r.random() / 4, 0.0) for x in range(6) for y in range(6)]
    high = [(x + 20.0, y, 9.0) for x, y, _ in low]
    points = spark.createDataFrame([*low, *high, (100.0, 100.0, 1.0)], "x double, y double, z double")
    found = cloud.segmentation(points, 2.0)
    top = found._jdf.queryExecution().sparkPlan().toString()
    assert top.count("SortMergeJoin") >= 2
    segment = {(p.x, p.y): p.segment for p in found.collect()}
    assert [{segment[x, y] for x, y, _ in part} for part in (low, high)] == [{1}, {2}] and segment[100.0, 100.0] == 3
