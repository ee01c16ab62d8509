"""Vector features: a DataFrame with fid and parts, an array of rings or lines, each an array of (x, y).

In polygons the first part is the hull, the others are holes. Measures are
expressions over the vertex arrays; shapes that need a scan of sorted points are
pandas UDFs on one feature at a time.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoloom.functions import shapes


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, b: a + b)


def _next(ring: Column) -> Column:
    """The ring turned by one vertex."""
    return F.concat(F.slice(ring, 2, F.size(ring) - 1), F.slice(ring, 1, 1))


def ring_area(ring: Column) -> Column:
    """Signed area; positive if counter-clockwise. The ring may be closed or not."""
    return _sum(F.zip_with(ring, _next(ring), lambda a, b: a["x"] * b["y"] - b["x"] * a["y"])) / 2


def ring_length(ring: Column, closed: bool = True) -> Column:
    on = _next(ring) if closed else F.slice(ring, 2, F.size(ring) - 1)
    start = ring if closed else F.slice(ring, 1, F.size(ring) - 1)
    return _sum(F.zip_with(start, on, lambda a, b: F.hypot(b["x"] - a["x"], b["y"] - a["y"])))


def polygon_area() -> Column:
    """Area of the hull less that of the holes."""
    areas = F.transform("parts", lambda r: F.abs(ring_area(r)))
    return 2 * areas[0] - _sum(areas)


def perimeter() -> Column:
    return _sum(F.transform("parts", lambda r: ring_length(r)))


def measures(polygons: DataFrame) -> DataFrame:
    """``polygons`` with area, perimeter, perimeter_area, compactness (area / perimeter) and hole_proportion."""
    p = polygons.withColumns({"area": polygon_area(), "perimeter": perimeter(), "_hull": F.abs(ring_area(F.col("parts")[0]))})
    return p.withColumns({"perimeter_area": F.col("perimeter") / F.col("area"), "compactness": F.col("area") / F.col("perimeter"), "hole_proportion": (F.col("_hull") - F.col("area")) / F.col("_hull")}).drop("_hull")


def vertices(features: DataFrame) -> DataFrame:
    """fid, part, vertex, x, y: one row for each vertex (the nodes of lines and polygons)."""
    p = features.select("fid", F.posexplode("parts").alias("part", "_r"))
    return p.select("fid", "part", F.posexplode("_r").alias("vertex", "_p")).select("fid", "part", "vertex", "_p.x", "_p.y")


def envelope(features: DataFrame) -> DataFrame:
    """fid, min_x, min_y, max_x, max_y."""
    v = F.flatten("parts")
    x, y = F.transform(v, lambda p: p["x"]), F.transform(v, lambda p: p["y"])
    return features.select("fid", F.array_min(x).alias("min_x"), F.array_min(y).alias("min_y"), F.array_max(x).alias("max_x"), F.array_max(y).alias("max_y"))


def layer_footprint(features: DataFrame) -> DataFrame:
    e = envelope(features)
    return e.agg(F.min("min_x").alias("min_x"), F.min("min_y").alias("min_y"), F.max("max_x").alias("max_x"), F.max("max_y").alias("max_y"))


def centroid(polygons: DataFrame) -> DataFrame:
    """fid, x, y: centre of mass of the hull."""
    r = F.col("parts")[0]
    cross = lambda a, b: a["x"] * b["y"] - b["x"] * a["y"]
    a = ring_area(r)
    part = lambda c: _sum(F.zip_with(r, _next(r), lambda p, q: (p[c] + q[c]) * cross(p, q))) / (6 * a)
    return polygons.select("fid", part("x").alias("x"), part("y").alias("y"))


def medoid(features: DataFrame) -> DataFrame:
    """fid, x, y: the vertex nearest the median of the feature's x and y; the first on a tie."""
    v = vertices(features)
    m = v.groupBy("fid").agg(F.percentile("x", 0.5).alias("mx"), F.percentile("y", 0.5).alias("my"))
    d = F.hypot(F.col("x") - F.col("mx"), F.col("y") - F.col("my"))
    return v.join(m, "fid").groupBy("fid").agg(F.min(F.struct(d, "part", "vertex", "x", "y")).alias("b")).select("fid", "b.x", "b.y")


def linearity_index(polygons: DataFrame) -> DataFrame:
    """fid, linearity: r² of the regression of the vertices."""
    return vertices(polygons).groupBy("fid").agg(F.coalesce(F.regr_r2("y", "x"), F.lit(1.0)).alias("linearity"))


def _shapes_of(xs: pd.Series, ys: pd.Series) -> pd.DataFrame:
    rows = []
    for x, y in zip(xs, ys, strict=True):
        pts = list(zip(x.tolist(), y.tolist(), strict=True))
        _, long, short, direction = shapes.bounding_box(pts)
        rows.append((abs(shapes.area(shapes.hull(pts))), long * short, long, short, shapes.compass(direction), shapes.enclosing_circle(pts)[2]))
    return pd.DataFrame(rows, columns=["hull", "box", "long", "short", "direction", "circle"])


def _coordinates() -> tuple[Column, Column]:
    v = F.flatten("parts")
    return F.transform(v, lambda p: p["x"]), F.transform(v, lambda p: p["y"])


def _shapes() -> Column:
    """Area of the hull and of the least bounding box, its sides and direction, radius of the enclosing circle."""
    return F.pandas_udf(_shapes_of, "hull double, box double, long double, short double, direction double, circle double")(*_coordinates())


def shape_indices(polygons: DataFrame) -> DataFrame:
    """fid, elongation, complexity, circumscribing, orientation, long_axis and short_axis of each polygon."""
    s = polygons.select("fid", polygon_area().alias("area"), _shapes().alias("s"))
    return s.select(
        "fid",
        F.when(F.col("s.long") > 0, 1 - F.col("s.short") / F.col("s.long")).otherwise(0.0).alias("elongation"),
        F.when(F.col("s.hull") > 0, 1 - F.col("area") / F.col("s.hull")).otherwise(0.0).alias("complexity"),
        F.when(F.col("s.circle") > 0, 1 - F.col("area") / (F.lit(3.141592653589793) * F.col("s.circle") * F.col("s.circle"))).otherwise(0.0).alias("circumscribing"),
        F.col("s.direction").alias("orientation"), F.col("s.long").alias("long_axis"), F.col("s.short").alias("short_axis"),
    )


def _hulls_of(xs: pd.Series, ys: pd.Series) -> pd.Series:
    return pd.Series([[c for p in shapes.hull(list(zip(x.tolist(), y.tolist(), strict=True))) for c in p] for x, y in zip(xs, ys, strict=True)])


def convex_hull(features: DataFrame) -> DataFrame:
    flat = features.select("fid", F.pandas_udf(_hulls_of, "array<double>")(*_coordinates()).alias("h"))
    at = F.sequence(F.lit(0), (F.size("h") / 2 - 1).cast("int"))
    ring = F.transform(at, lambda i: F.struct(F.get("h", 2 * i).alias("x"), F.get("h", 2 * i + 1).alias("y")))
    return flat.select("fid", F.array(ring).alias("parts"))


def minimum_bounding_circle(features: DataFrame) -> DataFrame:
    return features.select("fid", _shapes()["circle"].alias("radius"))


# lines


def polygons_to_lines(polygons: DataFrame) -> DataFrame:
    """Each ring as a closed line."""
    first = lambda r: F.slice(r, 1, 1)
    closed = F.transform("parts", lambda r: F.when(r[0] == F.element_at(r, -1), r).otherwise(F.concat(r, first(r))))
    return polygons.withColumn("parts", closed)


def lines_to_polygons(lines: DataFrame) -> DataFrame:
    """Lines with three vertices or more, closed."""
    keep = F.filter("parts", lambda r: F.size(r) >= 3)
    return polygons_to_lines(lines.withColumn("parts", keep).filter("size(parts) > 0"))


def multi_to_single(features: DataFrame) -> DataFrame:
    return features.select(*[c for c in features.columns if c != "parts"], F.explode(F.transform("parts", lambda r: F.array(r))).alias("parts"))


def single_to_multi(features: DataFrame, by: str) -> DataFrame:
    """One feature for each value of ``by``, parts in fid order."""
    return features.groupBy(by).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("fid", "parts"))), lambda s: s["parts"])).alias("parts"))


def remove_holes(polygons: DataFrame) -> DataFrame:
    return polygons.withColumn("parts", F.slice("parts", 1, 1))


def clean(features: DataFrame, least: int = 3) -> DataFrame:
    return features.withColumn("parts", F.filter("parts", lambda r: F.size(r) >= least)).filter("size(parts) > 0")


def smooth(features: DataFrame, size: int = 3) -> DataFrame:
    """Moving average of the inner vertices of each part; the ends stay."""
    k = size // 2

    def one(r: Column) -> Column:
        def vertex(p: Column, i: Column) -> Column:
            w = F.slice(r, i + 1 - k, 2 * k + 1)
            mean = lambda c: _sum(F.transform(w, lambda q: q[c])) / (2 * k + 1)
            return F.when((i >= k) & (i < F.size(r) - k), F.struct(mean("x").alias("x"), mean("y").alias("y"))).otherwise(p)

        return F.transform(r, vertex)

    return features.withColumn("parts", F.transform("parts", one))


def extend_lines(lines: DataFrame, distance: float) -> DataFrame:
    """Lines longer by ``distance`` at both ends."""

    def one(r: Column) -> Column:
        def beyond(a: Column, b: Column) -> Column:
            d = F.hypot(a["x"] - b["x"], a["y"] - b["y"])
            return F.struct(*[(a[c] + (a[c] - b[c]) / d * distance).alias(c) for c in "xy"])

        n = F.size(r)
        return F.concat(F.array(beyond(r[0], r[1])), F.slice(r, 2, n - 2), F.array(beyond(F.element_at(r, -1), F.element_at(r, -2))))

    return lines.withColumn("parts", F.transform("parts", one))


def segments(lines: DataFrame) -> DataFrame:
    """fid, k, x1, y1, x2, y2: every segment."""
    r = F.col("_r")
    s = lines.select("fid", F.explode("parts").alias("_r")).select("fid", F.posexplode(F.zip_with(F.slice(r, 1, F.size(r) - 1), F.slice(r, 2, F.size(r) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))).alias("k", "s"))
    return s.select("fid", "k", F.col("s.a.x").alias("x1"), F.col("s.a.y").alias("y1"), F.col("s.b.x").alias("x2"), F.col("s.b.y").alias("y2"))


def _bins(lo: Column, hi: Column, size: float) -> Column:
    return F.sequence(F.floor(lo / size), F.floor(hi / size))


def _binned(boxes: DataFrame, size: float, x0: str, y0: str, x1: str, y1: str) -> DataFrame:
    """``boxes`` once for each square bin they touch (bx, by)."""
    b = boxes.withColumn("bx", F.explode(_bins(F.least(x0, x1), F.greatest(x0, x1), size)))
    return b.withColumn("by", F.explode(_bins(F.least(y0, y1), F.greatest(y0, y1), size)))


def line_intersections(a: DataFrame, b: DataFrame, size: float) -> DataFrame:
    """fid1, fid2, x, y: where lines of ``a`` cross lines of ``b``; segments meet in bins of ``size``."""
    s, t = _binned(segments(a), size, "x1", "y1", "x2", "y2"), _binned(segments(b), size, "x1", "y1", "x2", "y2")
    t = t.select("bx", "by", F.col("fid").alias("fid2"), F.col("k").alias("k2"), F.col("x1").alias("x3"), F.col("y1").alias("y3"), F.col("x2").alias("x4"), F.col("y2").alias("y4"))
    d = F.expr("(x1 - x2) * (y3 - y4) - (y1 - y2) * (x3 - x4)")
    j = s.join(t, ["bx", "by"]).withColumn("d", d).filter("d <> 0").withColumns({"t": F.expr("((x1 - x3) * (y3 - y4) - (y1 - y3) * (x3 - x4)) / d"), "u": F.expr("((x1 - x3) * (y1 - y2) - (y1 - y3) * (x1 - x2)) / d")})
    hit = j.filter("t BETWEEN 0 AND 1 AND u BETWEEN 0 AND 1")
    return hit.select(F.col("fid").alias("fid1"), "k", "fid2", "k2", F.expr("x1 + t * (x2 - x1)").alias("x"), F.expr("y1 + t * (y2 - y1)").alias("y")).dropDuplicates(["fid1", "k", "fid2", "k2"]).drop("k", "k2")


# points and polygons


def inside(x: Column, y: Column, ring: Column) -> Column:
    """Whether a point is in a ring, by the parity of the edges it has to its right."""
    cross = F.zip_with(ring, _next(ring), lambda a, b: ((a["y"] > y) != (b["y"] > y)) & (x < (b["x"] - a["x"]) * (y - a["y"]) / F.nullif(b["y"] - a["y"], F.lit(0.0)) + a["x"]))
    return F.size(F.filter(cross, lambda c: c)) % 2 == 1


def in_polygon(x: Column, y: Column, parts: Column) -> Column:
    """In the hull and in no hole: in an odd number of rings."""
    return F.size(F.filter(parts, lambda r: inside(x, y, r))) % 2 == 1


def points_in_polygons(points: DataFrame, polygons: DataFrame, size: float) -> DataFrame:
    """``points`` (x, y, …) with the fid of every polygon (as polygon) they are in; both meet in bins of ``size``."""
    boxes = polygons.join(envelope(polygons), "fid").select(F.col("fid").alias("polygon"), "parts", "min_x", "min_y", "max_x", "max_y")
    b = _binned(boxes, size, "min_x", "min_y", "max_x", "max_y")
    p = points.withColumns({"bx": F.floor(F.col("x") / size), "by": F.floor(F.col("y") / size)})
    near = p.join(b, ["bx", "by"]).filter("x >= min_x AND x <= max_x AND y >= min_y AND y <= max_y")
    return near.filter(in_polygon(F.col("x"), F.col("y"), F.col("parts"))).select(*points.columns, "polygon")


def clip_points(points: DataFrame, polygons: DataFrame, size: float, keep_inside: bool = True) -> DataFrame:
    """The points inside (or outside) all polygons; a point is named by all its columns."""
    hit = points_in_polygons(points, polygons, size).select(*points.columns).distinct()
    on = reduce(lambda a, b: a & b, [points[c].eqNullSafe(hit[c]) for c in points.columns])
    return points.join(hit, on, "left_semi" if keep_inside else "left_anti")


def rasterize_polygons(polygons: DataFrame, cells: DataFrame, size: float = 16.0) -> DataFrame:
    """row, col, z: the fid of the last polygon over each cell's centre (x = col + 0.5, y = row + 0.5)."""
    centres = cells.select("row", "col", (F.col("col") + 0.5).alias("x"), (F.col("row") + 0.5).alias("y"))
    return points_in_polygons(centres, polygons, size).groupBy("row", "col").agg(F.max("polygon").cast("double").alias("z"))


def rasterize_lines(lines: DataFrame, cells: DataFrame) -> DataFrame:
    """row, col, z: the fid of the last line through each cell (x from col, y from row).

    A segment meets the cells that lie between its successive crossings with grid lines: the middle of two crossings names the cell.
    """
    s = segments(lines)

    def crossings(a: Column, b: Column) -> Column:
        lo, hi = F.least(a, b), F.greatest(a, b)
        at = F.when(F.ceil(lo) <= F.floor(hi), F.sequence(F.ceil(lo), F.floor(hi))).otherwise(F.array().cast("array<bigint>"))
        return F.when(a != b, F.transform(at, lambda k: (k - a) / (b - a))).otherwise(F.array().cast("array<double>"))

    t = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0.0), F.lit(1.0)), crossings(F.col("x1"), F.col("x2")), crossings(F.col("y1"), F.col("y2")))))
    middle = F.transform(F.sequence(F.lit(1), F.size("t") - 1), lambda i: (F.get("t", i) + F.get("t", i - 1)) / 2)
    m = s.withColumn("t", t).withColumn("m", F.explode(middle))
    at = m.select("fid", F.floor(F.expr("y1 + m * (y2 - y1)")).cast("int").alias("row"), F.floor(F.expr("x1 + m * (x2 - x1)")).cast("int").alias("col"))
    return at.join(cells.select("row", "col"), ["row", "col"], "left_semi").groupBy("row", "col").agg(F.max("fid").cast("double").alias("z"))


def clip_raster(raster: DataFrame, polygons: DataFrame, keep_inside: bool = True) -> DataFrame:
    """Cells whose centres are inside (or outside) all polygons."""
    mask = rasterize_polygons(polygons, raster).select("row", "col")
    return raster.join(mask, ["row", "col"], "left_semi" if keep_inside else "left_anti")


# tables


def join_tables(left: DataFrame, left_key: str, right: DataFrame, right_key: str, order: Sequence[str]) -> DataFrame:
    """``left`` with the columns of ``right``, whose last row (by ``order``) of a key counts; missing ones are NULL."""
    last = right.withColumn("_n", F.row_number().over(Window.partitionBy(right_key).orderBy(*[F.desc(c) for c in order]))).filter("_n = 1").drop("_n")
    clash = [c for c in last.columns if c in left.columns and c != right_key]
    last = last.drop(*clash).withColumnRenamed(right_key, "_key")
    return left.join(last, F.col(left_key).cast("string") == F.col("_key").cast("string"), "left").drop("_key")


def merge(layers: Sequence[DataFrame]) -> DataFrame:
    """All features, with the number of their layer (from 1) as parent; columns that all have."""
    common = [c for c in layers[0].columns if all(c in x.columns for x in layers)]
    return reduce(DataFrame.unionByName, [x.select(*common).withColumn("parent", F.lit(i + 1)) for i, x in enumerate(layers)])


def extract_by_attribute(features: DataFrame, statement: str) -> DataFrame:
    return features.filter(F.expr(statement))


def rectangular_grid(min_x: float, min_y: float, max_x: float, max_y: float, width: float, height: float, spark) -> DataFrame:
    """A lattice of rectangles as features."""
    nx, ny = int(-(-(max_x - min_x) // width)), int(-(-(max_y - min_y) // height))
    at = spark.range(nx * ny).select(F.col("id").alias("fid"), (F.col("id") % nx).alias("i"), F.floor(F.col("id") / nx).alias("j"))
    corner = lambda a, b: F.struct((min_x + (F.col("i") + a) * width).alias("x"), (min_y + (F.col("j") + b) * height).alias("y"))
    return at.select("fid", F.array(F.array(corner(0, 0), corner(1, 0), corner(1, 1), corner(0, 1))).alias("parts"))


def hexagonal_grid(min_x: float, min_y: float, max_x: float, max_y: float, width: float, spark) -> DataFrame:
    """A lattice of hexagons (pointy top, ``width`` across flats) whose centres start at the lower left corner."""
    side = width / 3**0.5
    nx, ny = int(-(-(max_x - min_x) // width)) + 1, int(-(-(max_y - min_y) // (1.5 * side))) + 1
    at = spark.range(nx * ny).select(F.col("id").alias("fid"), (F.col("id") % nx).alias("i"), F.floor(F.col("id") / nx).alias("j"))
    x, y = min_x + (F.col("i") + (F.col("j") % 2) * 0.5) * width, min_y + F.col("j") * (1.5 * side)
    corner = lambda k: F.struct((x + side * F.cos(F.lit(3.141592653589793 / 6 * (2 * k + 1)))).alias("x"), (y + side * F.sin(F.lit(3.141592653589793 / 6 * (2 * k + 1)))).alias("y"))
    return at.select("fid", F.array(F.array(*[corner(k) for k in range(6)])).alias("parts"))


def merge_with_csv(features: DataFrame, key: str, path: str, csv_key: str, order: Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """``features`` with the columns of a CSV table (header, inferred types), joined as :func:`join_tables` does."""
    table = features.sparkSession.read.csv(path, header=True, inferSchema=True)
    return join_tables(features, key, table.select(csv_key, *columns) if columns else table, csv_key, order)


def minimum_bounding_box(features: DataFrame, criterion: str = "area") -> DataFrame:
    """fid, long, short, direction (degrees clockwise from north) and parts of the least bounding rectangle."""

    def of(xs: pd.Series, ys: pd.Series) -> pd.DataFrame:
        rows = []
        for x, y in zip(xs, ys, strict=True):
            corners, long, short, direction = shapes.bounding_box(list(zip(x.tolist(), y.tolist(), strict=True)), criterion)
            rows.append((long, short, shapes.compass(direction), [float(p[0]) for p in corners], [float(p[1]) for p in corners]))
        return pd.DataFrame(rows, columns=["long", "short", "direction", "x", "y"])

    box = features.select("fid", F.pandas_udf(of, "long double, short double, direction double, x array<double>, y array<double>")(*_coordinates()).alias("b"))
    return box.select("fid", "b.long", "b.short", "b.direction", F.array(F.arrays_zip(F.col("b.x").alias("x"), F.col("b.y").alias("y"))).alias("parts"))


def polygon_axes(polygons: DataFrame, which: str = "long") -> DataFrame:
    """fid, parts: the long or short axis of each polygon's bounding box as a line through its middle."""
    b = minimum_bounding_box(polygons).filter("size(parts[0]) = 4")
    p = lambda i: F.get(F.col("parts")[0], F.lit(i))
    mid = lambda i, j: F.struct(*[((p(i)[c] + p(j)[c]) / 2).alias(c) for c in "xy"])
    first = F.hypot(p(1)["x"] - p(0)["x"], p(1)["y"] - p(0)["y"]) >= F.hypot(p(2)["x"] - p(1)["x"], p(2)["y"] - p(1)["y"])
    along, across = F.array(mid(0, 3), mid(1, 2)), F.array(mid(0, 1), mid(3, 2))
    line = F.when(first if which == "long" else ~first, along).otherwise(across)
    return b.select("fid", F.array(line).alias("parts"))


def deviation_from_regional_direction(polygons: DataFrame, threshold: float = 0.75) -> DataFrame:
    """fid, deviation: degrees (0 to 90) between a polygon's axis and the regional one.

    The regional axis is the mean of the doubled angles of polygons with an elongation over ``threshold``, weighted by length.
    """
    b = minimum_bounding_box(polygons).select("fid", "direction", "long", F.when(F.col("long") > 0, 1 - F.col("short") / F.col("long")).otherwise(0.0).alias("e"))
    twice = F.radians(2 * F.col("direction"))
    r = b.filter(F.col("e") > threshold).agg(F.sum(F.col("long") * F.sin(twice)).alias("s"), F.sum(F.col("long") * F.cos(twice)).alias("c"))  # one row
    mean = F.degrees(F.atan2("s", "c")) / 2
    gap = F.abs(F.pmod(F.col("direction") - mean + 90, F.lit(180.0)) - 90)
    return b.crossJoin(F.broadcast(r)).select("fid", gap.alias("deviation"))


def split_lines(lines: DataFrame, length: float) -> DataFrame:
    """fid, piece, x1, y1, x2, y2: the segments of every line cut where its length reaches multiples of ``length``."""
    w = Window.partitionBy("fid").orderBy("k")
    s = segments(lines).withColumn("d", F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))).filter("d > 0")
    s = s.withColumn("b", F.sum("d").over(w)).withColumn("a", F.col("b") - F.col("d"))
    s = s.withColumn("piece", F.explode(F.sequence(F.floor(F.col("a") / length), F.ceil(F.col("b") / length) - 1)))
    lo, hi = F.greatest("a", F.col("piece") * length), F.least("b", (F.col("piece") + 1) * length)
    t = lambda at: (at - F.col("a")) / F.col("d")
    on = lambda at, p, q: F.col(p) + t(at) * (F.col(q) - F.col(p))
    return s.filter(hi > lo).select("fid", "piece", on(lo, "x1", "x2").alias("x1"), on(lo, "y1", "y2").alias("y1"), on(hi, "x1", "x2").alias("x2"), on(hi, "y1", "y2").alias("y2"))
