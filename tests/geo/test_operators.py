"""Operators beyond SQL, against plain versions on small grids; literal shapes; sources, streams and the registry."""

import heapq
import math
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from geoloom import registry
from geoloom.functions import shapes
from geoloom.functions.grids import AROUND
from geoloom.operators import distance, hydro, local, stats, terrain, vector
from geoloom.plans.graph import components, downstream, upstream
from geoloom.plans.stencil import neighbourhood
from geoloom.sources.ascii import read_arc_ascii, write_arc_ascii
from geoloom.streaming.gridding import block_gridding


def grid(spark, rows):
    return spark.createDataFrame([(r, c, None if z is None else float(z)) for r, row in enumerate(rows) for c, z in enumerate(row)], "row int, col int, z double")


def values(df, value="z"):
    return {(r["row"], r["col"]): r[value] for r in df.collect()}


def noise(n, seed=1):
    r = random.Random(seed)
    return [[r.randint(0, 40) for _ in range(n)] for _ in range(n)]


def around(cells, p):
    return [((p[0] + dr, p[1] + dc), math.hypot(dr, dc)) for dr, dc, _ in AROUND if (p[0] + dr, p[1] + dc) in cells]


def test_neighbourhood_across_tiles(spark):
    rows = noise(11)
    whole = values(neighbourhood(grid(spark, rows), 2), "n")
    tiled = values(neighbourhood(grid(spark, rows), 2, tile=4), "n")
    assert whole == tiled
    assert whole[(5, 5)] == [float(rows[r][c]) for r in range(3, 8) for c in range(3, 8)]


@pytest.mark.parametrize("tile", [256, 4])
def test_fill(spark, tile):
    rows = noise(10)
    rows[4][4] = None
    z = {(r, c): v for r, row in enumerate(rows) for c, v in enumerate(row) if v is not None}
    heap = [(v, p) for p, v in z.items() if len(around(z, p)) < 8]
    want = {}
    heapq.heapify(heap)
    while heap:
        level, p = heapq.heappop(heap)
        if p not in want:
            want[p] = level
            for q, _ in around(z, p):
                heapq.heappush(heap, (max(z[q], level), q))
    assert values(hydro.fill_depressions(grid(spark, rows), tile=tile)) == want | {(4, 4): None}  # a raster has a row for every cell


@pytest.mark.parametrize("tile", [256, 4])
def test_cost_distance(spark, tile):
    cost = noise(9, 3)
    source = [[1 if (r, c) in ((0, 0), (7, 5)) else 0 for c in range(9)] for r in range(9)]
    z = {(r, c): v for r, row in enumerate(cost) for c, v in enumerate(row)}
    heap, want = [(0.0, (0, 0)), (0.0, (7, 5))], {}
    while heap:
        d, p = heapq.heappop(heap)
        if p not in want:
            want[p] = d
            for q, length in around(z, p):
                heapq.heappush(heap, (d + (z[p] + z[q]) / 2 * length, q))
    got = values(distance.cost_distance(grid(spark, source), grid(spark, cost), tile))
    assert got.keys() == want.keys() and all(math.isclose(got[p], want[p], abs_tol=1e-9) for p in want)


def plain_spread(z, share):
    total = dict.fromkeys(z, 1.0)
    for p in sorted(z, key=lambda p: -z[p]):
        w = share(p)
        for q, v in w.items():
            total[q] += total[p] * v / sum(w.values())
    return total


def test_fd8_and_d8_accumulation(spark):
    rows = noise(8, 5)
    z = {(r, c): v for r, row in enumerate(rows) for c, v in enumerate(row)}
    lower = lambda p: {q: ((z[p] - z[q]) / d) ** 1.1 for q, d in around(z, p) if z[q] < z[p]}
    got = values(hydro.fd8_flow_accumulation(grid(spark, rows)))
    assert all(math.isclose(got[p], v) for p, v in plain_spread(z, lower).items())

    def steepest(p):
        best = max([((z[p] - z[q]) / d, -i, q) for i, (q, d) in enumerate(around(z, p)) if z[q] < z[p]], default=None)
        return {best[2]: 1.0} if best else {}

    pointer = hydro.d8_pointer(grid(spark, rows))
    assert values(hydro.d8_flow_accumulation(pointer)) == plain_spread(z, steepest)


def test_mass_flux_without_loss_is_accumulation(spark):
    dem = grid(spark, noise(7, 9))
    pointer = hydro.d8_pointer(dem)
    one, none = local.new_raster(dem, 1.0), local.new_raster(dem, 0.0)
    assert values(hydro.d8_mass_flux(pointer, one, one, none)) == values(hydro.d8_flow_accumulation(pointer))


def test_paths(spark):
    nodes = spark.createDataFrame([(i, i - 1 if i else None, 1.0) for i in range(20)], "id long, next long, step double")
    down = {r.id: (r.last, r.step) for r in downstream(nodes.withColumn("step", F.when(F.col("next").isNotNull(), F.col("step")).otherwise(0.0)), {"step": lambda a, b: F.col(a) + F.col(b)}).collect()}
    assert down == {i: (0, float(i)) for i in range(20)}
    up = upstream(nodes.withColumns({"n": F.lit(1), "far": F.lit(0.0)}), ["n"], {"far": "step"})
    assert {r.id: (r.n, r.far) for r in up.collect()} == {i: (20 - i, float(19 - i)) for i in range(20)}


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 102)], "a long, b long")
    nodes = spark.createDataFrame([(i,) for i in [*range(41), 100, 101, 102]], "id long")
    assert {r.id: r.root for r in components(nodes, edges).collect()} == dict.fromkeys(range(41), 0) | {100: 100, 101: 101, 102: 100}


def test_clump_diagonals(spark):
    rows = [[1, 1, 2, 2], [3, 1, 3, 2], [3, 3, 1, 3], [3, 3, 3, 1]]
    assert len(set(values(hydro.clump(grid(spark, rows))).values())) < len(set(values(hydro.clump(grid(spark, rows), diagonal=False)).values()))


def test_plane(spark):
    rows = [[2 * c + 3 * r for c in range(7)] for r in range(7)]
    d = values(terrain.slope(grid(spark, rows), "ratio"))
    assert math.isclose(d[(3, 3)], math.sqrt(13))
    assert all(abs(v) < 1e-9 for p, v in values(terrain.surface(grid(spark, rows), "total_curvature")).items() if 2 <= p[0] <= 4 and 2 <= p[1] <= 4)


def test_trend_surface_is_exact_on_a_plane(spark):
    rows = [[2 * c + 3 * r + 1 for c in range(6)] for r in range(5)]
    got = values(stats.trend_surface(grid(spark, rows), 1))
    assert all(math.isclose(got[(r, c)], rows[r][c]) for r in range(5) for c in range(6))


def test_k_means_parts_two_groups(spark):
    bands = spark.createDataFrame([(i, 0, b, float((i % 2) * 100 + b)) for i in range(20) for b in range(2)], "row int, col int, band int, z double")
    got = values(stats.k_means(bands, 2, 2))
    assert {v for p, v in got.items() if p[0] % 2} == {2.0} and {v for p, v in got.items() if not p[0] % 2} == {1.0}


def test_empty_raster(spark):
    empty = grid(spark, [])
    assert terrain.slope(empty).count() == 0
    assert hydro.d8_flow_accumulation(hydro.d8_pointer(empty)).count() == 0


# shapes


def test_shapes():
    square = [(0.0, 0.0), (5.0, 0.0), (5.0, 5.0), (0.0, 5.0)]
    assert abs(shapes.area(square)) == 25 and abs(shapes.area([*square, square[0]])) == 25
    assert shapes.hull([*square, (2.0, 2.0), (5.0, 5.0)]) == square
    _, long, short, _ = shapes.bounding_box([(0, 0), (4, 4), (5, 3), (1, -1)])
    assert math.isclose(long, 4 * math.sqrt(2)) and math.isclose(short, math.sqrt(2))
    x, y, r = shapes.enclosing_circle([(0, 0), (2, 0), (1, 1), (1, -0.5)])
    assert math.isclose(x, 1) and abs(y) < 1e-9 and math.isclose(r, 1)


def test_square_with_hole(spark):
    p = lambda *xy: [{"x": float(x), "y": float(y)} for x, y in xy]
    parts = [p((0, 0), (10, 0), (10, 10), (0, 10)), p((4, 4), (6, 4), (6, 6), (4, 6))]
    f = spark.createDataFrame([(1, parts)], "fid long, parts array<array<struct<x:double,y:double>>>")
    m = vector.measures(f).first()
    assert (m.area, m.perimeter) == (96.0, 48.0) and math.isclose(m.hole_proportion, 0.04)
    pts = spark.createDataFrame([(2.0, 2.0), (5.0, 5.0), (12.0, 12.0)], "x double, y double")
    assert [tuple(r) for r in vector.clip_points(pts, f, 4.0).collect()] == [(2.0, 2.0)]


# sources, streams, registry


def test_arc_ascii_round_trip(spark, tmp_path):
    rows = [[1.5, None, 3.0], [4.0, 5.0, 6.25]]
    write_arc_ascii(grid(spark, rows), str(tmp_path / "grid"))
    text = "\n".join(p.read_text() for p in sorted((tmp_path / "grid").glob("part-*")))
    (tmp_path / "one.asc").write_text(text)
    assert values(read_arc_ascii(spark, str(tmp_path / "one.asc"))) == values(grid(spark, rows))


def test_stream(spark):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), (F.col("user_id") * 1.0).alias("x"), (F.col("event_id") % 50 * 1.0).alias("y"), F.col("value").alias("z"))
    folder = tempfile.mkdtemp()
    events.write.mode("overwrite").parquet(folder)
    q = block_gridding(spark.readStream.schema(events.schema).parquet(folder), 10.0).writeStream.outputMode("complete").format("memory").queryName("gridded").start()
    try:
        q.processAllAvailable()
        assert spark.sql("SELECT sum(n) FROM gridded").first()[0] == events.count()
    finally:
        q.stop()


def test_registry():
    assert "terrain.slope" in registry.tools() and "hydro.watershed" in registry.search("pour point")
    assert registry.parameters("terrain.slope")["units"] == "'degrees'"
