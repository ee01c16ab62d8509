"""Overlay of polygons: known areas, and what a fine grid of points says of random ones."""

import random

import pytest
from pyspark.sql import functions as F

from geoloom.functions import planar
from geoloom.operators import cloud, distance, overlay
from geoloom.operators.hydro import d8_pointer
from tests.geo.test_operators import grid, noise, values


def square(x, y, s):
    return [(x, y), (x + s, y), (x + s, y + s), (x, y + s)]


def size(found):
    return sum(abs(planar.area(h[0])) - sum(abs(planar.area(r)) for r in h[1:]) for h in found)


def test_squares():
    a, b, ring = [square(0, 0, 4)], [square(2, 2, 4)], [square(0, 0, 10), square(3, 3, 2)]
    assert [size(planar.overlay([a, b], k)) for k in (all, any, lambda s: s[0] and not s[1])] == [4, 28, 12]
    assert [size(planar.overlay([ring, b], k)) for k in (all, any)] == [12, 100]
    hole = planar.overlay([[square(0, 0, 10)], [square(3, 3, 2)]], lambda s: s[0] and not s[1])
    assert len(hole) == 1 and len(hole[0]) == 2
    # shared edges and corners
    assert size(planar.overlay([a, [square(4, 0, 4)]], any)) == 32 and not planar.overlay([a, [square(4, 4, 1)]], all)


@pytest.mark.parametrize("seed", range(6))
def test_random_triangles(seed):
    r = random.Random(seed)
    tri = lambda: [[(r.uniform(0, 10), r.uniform(0, 10)) for _ in range(3)]]
    a, b = tri(), tri()
    whole = [abs(planar.area(t[0])) for t in (a, b)]
    common, both = size(planar.overlay([a, b], all)), size(planar.overlay([a, b], any))
    assert common + both == pytest.approx(sum(whole))
    found = planar.overlay([a, b], lambda s: s[0] != s[1])
    for _ in range(300):
        p = (r.uniform(0, 10), r.uniform(0, 10))
        assert planar.inside(p, [ring for h in found for ring in h]) == (planar.inside(p, a) != planar.inside(p, b))


def layer(spark, shapes):
    rows = [(i, [[{"x": float(x), "y": float(y)} for x, y in r] for r in rings]) for i, rings in enumerate(shapes)]
    return spark.createDataFrame(rows, "fid long, parts array<array<struct<x: double, y: double>>>")


def test_layers_across_bins(spark):
    """The result does not depend on the width of bins; pieces of a union add up."""
    r = random.Random(1)
    a = layer(spark, [[square(r.uniform(0, 30), r.uniform(0, 30), r.uniform(1, 9))] for _ in range(8)])
    b = layer(spark, [[square(8 * i, 8 * j, 8)] for i in range(5) for j in range(5)])
    sums = []
    for bins in (3.0, 50.0):
        found = overlay.intersect(a, b, bins).collect()
        sums.append(sorted((x.fid1, x.fid2, round(size([[[(p.x, p.y) for p in ring] for ring in x.parts]]), 6)) for x in found))
    assert sums[0] == sums[1]
    own = sum(abs(planar.area([(p.x, p.y) for p in x.parts[0]])) for x in a.collect())
    left = sum(size([[[(p.x, p.y) for p in ring] for ring in x.parts]]) for x in overlay.difference(a, b, 5.0).collect())
    assert own == pytest.approx(left + sum(s[2] for s in sums[0]))


def test_back_links_lead_to_sources(spark):
    cost = grid(spark, [[v + 1 for v in row] for row in noise(9, 2)])
    source = grid(spark, [[7.0 if (r, c) == (1, 1) else 3.0 if (r, c) == (7, 6) else 0.0 for c in range(9)] for r in range(9)])
    total = distance.cost_distance(source, cost)
    links = distance.backlink(total, cost)
    got = values(distance.cost_allocation(source, links))
    assert set(got.values()) == {3.0, 7.0} and got[(0, 0)] == 7 and got[(8, 7)] == 3
    ends = values(distance.cost_pathway(grid(spark, [[1.0 if (r, c) == (4, 0) else 0.0 for c in range(9)] for r in range(9)]), links))
    assert ends[(4, 0)] == 1 and (ends.get((1, 1)) or ends.get((7, 6))) == 1
    assert values(d8_pointer(total))


def test_normals_of_a_plane(spark):
    points = spark.range(100).select((F.col("id") % 10).cast("double").alias("x"), F.floor(F.col("id") / 10).cast("double").alias("y")).withColumn("z", 0.5 * F.col("x") - 0.25 * F.col("y"))
    for r in cloud.normal_vectors(points, 2.5).collect():
        assert (r.nx / r.nz, r.ny / r.nz) == pytest.approx((-0.5, 0.25))
