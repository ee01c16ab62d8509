"""Patches of a raster: their sizes, shapes and outlines.

A patch is the set of cells with one (rounded) value, as :func:`geoloom.operators.hydro.clump` numbers them.
"""

from __future__ import annotations

from math import pi, sqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoloom.functions.grids import AROUND
from geoloom.operators.distance import nearest_target
from geoloom.operators.lines import line_thinning
from geoloom.plans.stencil import neighbourhood

Raster = DataFrame


def _patch() -> Column:
    return F.round("z").cast("long")


def patch_cells(raster: Raster) -> DataFrame:
    """row, col, patch of the cells of patches (not NoData, not 0)."""
    return raster.filter("z IS NOT NULL AND round(z) <> 0").select("row", "col", _patch().alias("patch"))


def spread_to_cells(raster: Raster, values: DataFrame, value: str) -> Raster:
    """The patch's value in all its cells; ``values`` has one row for each patch."""
    return patch_cells(raster).join(values.select("patch", F.col(value).alias("z")), "patch").select("row", "col", "z")


def filter_by_area(raster: Raster, threshold: int, background: float | None = 0.0) -> Raster:
    """Patches of fewer than ``threshold`` cells become ``background``."""
    large = patch_cells(raster).groupBy("patch").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= threshold).select(F.col("patch").alias("p"))
    j = raster.join(large, F.round("z").cast("long") == F.col("p"), "left")
    small = F.col("p").isNull() & (F.round("z") != 0)
    return j.select("row", "col", F.when(small, F.lit(background).cast("double")).otherwise(F.col("z")).alias("z"))


def perimeters(raster: Raster) -> DataFrame:
    """patch, perimeter: the length of its outline through the middles of cell sides and corners.

    Each block of 2 x 2 cells holds 1, 1/2·√2 or √2 of an outline by how many of its cells are of
    the patch, so straight edges count their length and diagonal ones are not counted as steps.
    """
    own = patch_cells(raster)
    corners = own.select("patch", F.explode(F.array(*[F.struct((F.col("row") + a).alias("r"), (F.col("col") + b).alias("c"), F.lit(2 * a + b).alias("k")) for a in (0, 1) for b in (0, 1)])).alias("x")).select("patch", "x.*")
    blocks = corners.groupBy("patch", "r", "c").agg(F.count(F.lit(1)).alias("n"), F.sum(F.expr("shiftleft(1, k)")).alias("m"))
    # 6 and 9: two cells that touch at the corner
    length = F.when(F.col("n") == 4, 0.0).when((F.col("n") == 2) & ~F.col("m").isin(6, 9), 1.0).when(F.col("n") == 2, sqrt(2)).otherwise(sqrt(2) / 2)
    return blocks.groupBy("patch").agg(F.sum(length).alias("perimeter"))


def raster_perimeter(raster: Raster) -> Raster:
    return spread_to_cells(raster, perimeters(raster), "perimeter")


def narrowness(raster: Raster) -> DataFrame:
    """patch, narrowness: area / (π · d²), d the largest distance to the patch's edge (an edge cell has 1)."""
    n = neighbourhood(raster.select("row", "col", F.round("z").alias("z")))
    edge = F.exists("n", lambda v: ~v.eqNullSafe(F.col("z")))
    cells = n.select("row", "col", "z", edge.alias("edge"))
    away = nearest_target(cells.select("row", "col", F.when(F.col("edge") & (F.coalesce("z", F.lit(0.0)) != 0), 1.0).otherwise(0.0).alias("z")))
    own = patch_cells(raster).join(away, ["row", "col"])
    widest = own.groupBy("patch").agg(F.count(F.lit(1)).alias("area"), (F.sqrt(F.max("d2")) + 1).alias("d"))
    return widest.select("patch", (F.col("area") / (pi * F.col("d") * F.col("d"))).alias("narrowness"))


def narrowness_index(raster: Raster) -> Raster:
    return spread_to_cells(raster, narrowness(raster), "narrowness")


def boundary_shape_complexity(raster: Raster) -> Raster:
    """Branching of each patch's skeleton: the share of its thinned cells that are ends or junctions."""
    thin = line_thinning(raster.select("row", "col", F.when(F.round("z") != 0, 1.0).otherwise(F.when(F.col("z").isNotNull(), 0.0)).alias("z")))
    n = neighbourhood(thin).filter("z = 1")
    links = sum((F.coalesce(F.get("n", F.lit(at)), F.lit(0.0)) for _, _, at in AROUND), F.lit(0.0))
    skeleton = n.select("row", "col", (links != 2).cast("double").alias("odd")).join(patch_cells(raster), ["row", "col"])
    return spread_to_cells(raster, skeleton.groupBy("patch").agg(F.avg("odd").alias("v")), "v")


def shape_complexity(raster: Raster) -> DataFrame:
    """patch, complexity: the mean number of runs a patch has along the rows and columns it meets (1 for a convex one)."""
    own = patch_cells(raster)
    runs = []
    for line, at in (("row", "col"), ("col", "row")):
        w = Window.partitionBy("patch", line).orderBy(at)
        starts = own.withColumn("new", (F.coalesce(F.col(at) - F.lag(at).over(w), F.lit(2)) > 1).cast("long"))
        runs.append(starts.groupBy("patch", line).agg(F.sum("new").alias("runs")).select("patch", "runs"))
    return runs[0].union(runs[1]).groupBy("patch").agg(F.avg("runs").alias("complexity"))


def shape_complexity_index(raster: Raster) -> Raster:
    return spread_to_cells(raster, shape_complexity(raster), "complexity")


# outlines as features


def edges(raster: Raster) -> DataFrame:
    """patch, x1, y1, x2, y2: the cell sides between different patches, each patch's own on its left hand (y grows with the row)."""
    n = neighbourhood(raster.select("row", "col", F.round("z").alias("z"))).filter("z IS NOT NULL AND z <> 0")
    r, c = F.col("row").cast("double"), F.col("col").cast("double")
    sides = ((1, (c + 1, r, c, r)), (3, (c, r, c, r + 1)), (7, (c, r + 1, c + 1, r + 1)), (5, (c + 1, r + 1, c + 1, r)))
    open_ = [F.when(~F.get("n", F.lit(at)).eqNullSafe(F.col("z")), F.struct(*[v.alias(k) for k, v in zip(("x1", "y1", "x2", "y2"), xy, strict=True)])) for at, xy in sides]
    return n.select(_patch().alias("patch"), F.explode(F.filter(F.array(*open_), lambda s: s.isNotNull())).alias("s")).select("patch", "s.*")


def _turns(own: DataFrame) -> DataFrame:
    """For each edge the one that follows it: where two leave a corner, the turn that keeps cells that only touch apart."""
    after = own.select("patch", F.col("x1").alias("x2"), F.col("y1").alias("y2"), F.struct(F.col("x2").alias("nx"), F.col("y2").alias("ny")).alias("to"))
    j = own.join(after, ["patch", "x2", "y2"])
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    ex, ey = F.col("to.nx") - F.col("x2"), F.col("to.ny") - F.col("y2")
    side = dx * ey - dy * ex  # the patch lies on the side with negative values
    return j.groupBy("patch", "x1", "y1", "x2", "y2").agg(F.min_by("to", F.struct(side, F.col("to.nx"))).alias("to"))


def polygons(raster: Raster) -> DataFrame:
    """fid, cls (the patch), parts: the outline of every ring of cells sides as a polygon feature of its own patch.

    Rings are found by doubling along the edges (rounds grow with the logarithm of the longest
    ring), numbered by their first corner and gathered in order; straight runs keep their end corners only. The
    ring that runs round the patch comes first, holes after it; rings of other pieces of a patch are features of their own.
    """
    from geoloom.operators.hydro import cell_id
    from geoloom.plans.graph import components
    from geoloom.plans.lineage import written

    e = written(_turns(edges(raster)), "edges")
    # an edge is named by its start and direction; 4 directions
    name = lambda x1, y1, x2, y2: cell_id(y1.cast("int"), x1.cast("int")) * 4 + F.when(x2 > x1, 0).when(y2 > y1, 1).when(x2 < x1, 2).otherwise(3)
    e = written(e.select("patch", "x1", "y1", "x2", "y2", name(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2")).alias("id"), name(F.col("x2"), F.col("y2"), F.col("to.nx"), F.col("to.ny")).alias("next")), "edges")
    # an edge's name is its own but for patches on both sides of it, which run it in opposite directions
    roots = components(e.select("id"), e.select(F.col("id").alias("a"), F.col("next").alias("b")))
    return rings(e.join(roots, "id"))


def rings(e: DataFrame) -> DataFrame:
    """Rings of edges (patch, root, id, next, x1, y1, x2, y2) put in order, one group for each ring."""
    import pandas as pd

    def order(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        at = {i: k for k, i in enumerate(part["id"].tolist())}
        nexts, xs, ys = part["next"].tolist(), part["x1"].tolist(), part["y1"].tolist()
        k = start = at[min(at)]
        path = []
        while True:
            path.append((xs[k], ys[k]))
            k = at[nexts[k]]
            if k == start:
                break
        kept = [p for i, p in enumerate(path) if not _straight(path[i - 1], p, path[(i + 1) % len(path)])]
        area = sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(kept, kept[1:] + kept[:1], strict=True)) / 2
        return pd.DataFrame({"patch": [key[0]], "root": [key[1]], "area": [area], "xs": [[p[0] for p in kept]], "ys": [[p[1] for p in kept]]})

    r = e.groupBy("patch", "root").applyInPandas(order, "patch long, root long, area double, xs array<double>, ys array<double>")
    return r.select(F.col("root").alias("fid"), F.col("patch").alias("cls"), "area", F.arrays_zip(F.col("xs").alias("x"), F.col("ys").alias("y")).alias("ring"))


def _straight(a: tuple, b: tuple, c: tuple) -> bool:
    return (b[0] - a[0]) * (c[1] - b[1]) == (b[1] - a[1]) * (c[0] - b[0])
