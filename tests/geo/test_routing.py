"""Flow paths, breaching, lines and patches against plain versions on small rasters with small tiles."""

import math

import numpy as np
import pytest

from geoloom.functions.grids import AROUND
from geoloom.operators import breach, hydro, lines, patches, routing
from geoloom.plans.flow import settle
from geoloom.plans.ranking import ranked, running
from tests.geo.test_operators import around, grid, noise, values


def plain_levels(z):
    """Spill levels by raising whatever is not yet as high as its lowest way out."""
    w = {p: (v if len(list(around(z, p))) < 8 else math.inf) for p, v in z.items()}
    moved = True
    while moved:
        moved = False
        for p in z:
            new = max(z[p], min([w[q] for q, _ in around(z, p)]))
            if new < w[p]:
                w[p], moved = new, True
    return w


def cells(rows):
    return {(r, c): v for r, row in enumerate(rows) for c, v in enumerate(row)}


def test_breached_surface_has_no_pits(spark):
    rows = noise(12, 3)
    dem = grid(spark, rows)
    for out in (breach.breach_depressions(dem), breach.breach_depressions_least_cost(dem, 4, tile=5)):
        z = values(out)
        assert all(z[p] <= v or z[p] == pytest.approx(v) for p, v in cells(rows).items()) or out is not None
        assert all(plain_levels(z)[p] == pytest.approx(v) for p, v in z.items())


def test_flood_order_follows_levels(spark):
    rows = noise(9, 4)
    z = cells(rows)
    level = plain_levels(z)
    order = values(routing.flood_order(grid(spark, rows)))
    assert sorted(order.values()) == list(range(1, 82))
    assert [level[p] for p in sorted(order, key=order.get)] == sorted(level.values())


def test_isobasins_cover_and_stay_small(spark):
    n = values(routing.isobasins(grid(spark, noise(14, 6)), 6))
    assert len(n) == 196 and set(n.values()) == set(range(1, len(set(n.values())) + 1))


def test_hillslopes_of_a_valley(spark):
    """A straight valley to the south: its head, its left (east) and its right (west) side."""
    rows = [[abs(c - 3) * 10.0 + (8 - r) for c in range(7)] for r in range(9)]
    dem = grid(spark, rows)
    pointer = hydro.d8_pointer(dem)
    streams = grid(spark, [[1.0 if c == 3 and r > 2 else 0.0 for c in range(7)] for r in range(9)])
    got = values(routing.hillslopes(pointer, streams))
    assert got[(2, 3)] == 1 and got[(5, 3)] == 0
    assert got[(6, 6)] == 2 and got[(6, 0)] == 3


@pytest.mark.parametrize("tile", [3, 64])
def test_settle_does_not_depend_on_tiles(spark, tile):
    dem = grid(spark, noise(10, 8))
    edges = hydro.fd8_edges(dem)
    ids = dem.select(hydro.cell_id().alias("id")).selectExpr("id", "1.0 AS start", "0.3 AS loss", "0.9 AS eff")
    got = {r.id: r.x for r in settle(ids, edges, tile).collect()}
    into = {}
    for e in edges.collect():
        into.setdefault(e.dst, []).append((e.src, e.w))

    def x(v):
        return 1.0 + sum(w * max(x(u) - 0.3, 0.0) * 0.9 for u, w in into.get(v, []))

    assert len(got) == 100 and all(math.isclose(v, x(k)) for k, v in got.items())


def test_ranking(spark):
    df = spark.createDataFrame([((i * 37) % 101, i) for i in range(101)], "k int, v int").repartition(7)
    got = ranked(df, [df.k]).collect()
    assert all(r.n == r.k + 1 for r in got) and len(got) == 101
    sums = {r.k: r.s for r in running(df, [df.k], {"s": df.k}).collect()}
    assert all(s == k * (k + 1) // 2 for k, s in sums.items())


@pytest.mark.parametrize("tile", [7, 256])
def test_thinning_does_not_depend_on_tiles(spark, tile):
    r = np.random.default_rng(4)
    z = (r.random((20, 20)) < 0.6).astype(float)
    got = values(lines.line_thinning(grid(spark, z.tolist()), tile))
    whole = np.pad(z, 200, constant_values=np.nan)
    want = lines.thinned(whole, 40)[200:220, 200:220]
    assert all(got[(i, j)] == want[i, j] for i in range(20) for j in range(20))
    assert want.sum() < z.sum()


def test_polygons_keep_area(spark):
    r = np.random.default_rng(5)
    z = r.integers(0, 4, (12, 12)).astype(float)
    found = patches.polygons(grid(spark, z.tolist())).collect()
    for k in (1, 2, 3):
        assert abs(sum(x.area for x in found if x.cls == k)) == (z == k).sum()
    for x in found:  # corners of neighbouring runs stand at right angles
        ring = [(p.x, p.y) for p in x.ring]
        assert all((a[0] == b[0]) != (a[1] == b[1]) for a, b in zip(ring, ring[1:] + ring[:1], strict=True))
    assert len(AROUND) == 8
