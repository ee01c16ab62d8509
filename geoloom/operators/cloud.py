"""Point clouds: classes, polygons, ground, flight lines, agreement with a reference."""

from __future__ import annotations

from collections.abc import Sequence
from math import cos, radians, sin, tan

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom.operators.points import centres, to_cells, within
from geoloom.operators.vector import clip_points, in_polygon

Points = DataFrame


def filter_classes(points: Points, excluded: Sequence[int]) -> Points:
    """Points whose class is not one of ``excluded``."""
    return points.filter(~F.col("classification").isin(*excluded))


def filter_scan_angles(points: Points, threshold: float, angle: str = "scan_angle") -> Points:
    """Points with a scan angle of at most ``threshold`` to either side."""
    return points.filter(F.abs(angle) <= threshold)


def join(clouds: Sequence[Points]) -> Points:
    """All points of several clouds with the same columns."""
    out = clouds[0]
    for c in clouds[1:]:
        out = out.unionByName(c)
    return out


def tiles(points: Points, size: float, least: int = 2) -> Points:
    """``points`` with the row and col of their tile; tiles with fewer than ``least`` points are left out."""
    c = to_cells(points, size)
    large = c.groupBy("row", "col").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= least).select("row", "col")
    return c.join(large, ["row", "col"], "left_semi")


def histogram(points: Points, value: str, width: float) -> DataFrame:
    """bin, n of a column in steps of ``width`` from 0."""
    return points.groupBy(F.floor(F.col(value) / width).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def classify_overlap_points(points: Points, size: float, overlap: int = 12) -> Points:
    """Points of any but the first flight line of their cell get the class ``overlap``."""
    c = to_cells(points, size)
    first = c.groupBy("row", "col").agg(F.min("point_source_id").alias("_first"))
    cls = F.when(F.col("point_source_id") != F.col("_first"), overlap).otherwise(F.col("classification"))
    return c.join(first, ["row", "col"]).withColumn("classification", cls).select(*points.columns)


def colourize(points: Points, image: DataFrame, size: float) -> Points:
    """``points`` with the value of the image's cell as colour; points off the image are left out."""
    return to_cells(points, size).join(image.filter("z IS NOT NULL").select("row", "col", F.col("z").alias("colour")), ["row", "col"]).select(*points.columns, "colour")


def to_text(points: Points, columns: Sequence[str]) -> DataFrame:
    """line: the columns of each point joined by commas, for a text sink."""
    return points.select(F.concat_ws(",", *columns).alias("line"))


def from_text(lines: DataFrame, schema: str) -> Points:
    """Points of text lines (column value or line), by a schema such as ``x double, y double, z double``."""
    line = F.col(lines.columns[0])
    return lines.select(F.from_csv(line, schema).alias("p")).select("p.*")


def clip_to_polygons(points: Points, polygons: DataFrame, size: float) -> Points:
    return clip_points(points, polygons, size)


def erase_polygons(points: Points, polygons: DataFrame, size: float) -> Points:
    return clip_points(points, polygons, size, keep_inside=False)


def select_tiles(tiles_: DataFrame, polygons: DataFrame) -> DataFrame:
    """The tiles (tile, x0, y0, x1, y1) that meet a polygon: a corner or the centre inside, or a vertex of it in the tile."""
    boxes = polygons.select("parts", F.flatten("parts").alias("_v"))
    low = lambda c: F.array_min(F.transform("_v", lambda p: p[c]))
    high = lambda c: F.array_max(F.transform("_v", lambda p: p[c]))
    b = boxes.select("parts", "_v", low("x").alias("a0"), low("y").alias("b0"), high("x").alias("a1"), high("y").alias("b1"))
    near = tiles_.join(b, (F.col("x0") <= F.col("a1")) & (F.col("x1") >= F.col("a0")) & (F.col("y0") <= F.col("b1")) & (F.col("y1") >= F.col("b0")))
    inside = lambda x, y: in_polygon(x, y, F.col("parts"))
    mid = lambda a, b_: (F.col(a) + F.col(b_)) / 2
    hit: Column = inside(mid("x0", "x1"), mid("y0", "y1"))
    for x in ("x0", "x1"):
        for y in ("y0", "y1"):
            hit = hit | inside(F.col(x), F.col(y))
    within_ = F.exists("_v", lambda p: p["x"].between(F.col("x0"), F.col("x1")) & p["y"].between(F.col("y0"), F.col("y1")))
    return tiles_.join(near.filter(hit | within_).select("tile").distinct(), "tile", "left_semi")


def classify_subset(points: Points, subset: Points, inside: int, outside: int | None = None, decimals: int = 3) -> Points:
    """Points that stand in ``subset`` (same x, y, z to ``decimals``) get the class ``inside``, others ``outside`` (or keep theirs)."""
    key = [F.round(F.col(c) * 10**decimals).cast("long").alias(f"_{c}") for c in "xyz"]
    known = subset.select(*key).distinct().withColumn("_in", F.lit(True))
    j = points.select("*", *key).join(known, ["_x", "_y", "_z"], "left")
    rest = F.col("classification") if outside is None else F.lit(outside)
    return j.withColumn("classification", F.when(F.col("_in"), inside).otherwise(rest)).select(*points.columns)


def kappa(points: Points, reference: Points, decimals: int = 3) -> DataFrame:
    """n, agreement, kappa of the classes of points that stand at the same place in both clouds."""
    key = [F.round(F.col(c) * 10**decimals).cast("long").alias(f"_{c}") for c in "xyz"]
    a = points.select(*key, F.col("classification").alias("a")).dropDuplicates(["_x", "_y", "_z"])
    b = reference.select(*key, F.col("classification").alias("b")).dropDuplicates(["_x", "_y", "_z"])
    t = a.join(b, ["_x", "_y", "_z"]).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))  # classes squared
    total = t.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("same"))
    sums = t.groupBy(F.col("a").alias("k")).agg(F.sum("n").alias("r")).join(t.groupBy(F.col("b").alias("k")).agg(F.sum("n").alias("c")), "k").agg(F.coalesce(F.sum(F.col("r") * F.col("c")), F.lit(0)).alias("rc"))
    e = F.col("rc") / F.col("n")
    return total.crossJoin(F.broadcast(sums)).select("n", (F.col("same") / F.col("n")).alias("agreement"), ((F.col("same") - e) / F.nullif(F.col("n") - e, F.lit(0.0))).alias("kappa"))


def ground_point_filter(points: Points, radius: float, slope: float = 45.0, height: float = 1.0) -> Points:
    """``points`` with off_terrain: whether a lower point within ``radius`` is over ``height`` and ``slope`` degrees below.

    Equal places are told apart by z; of a place only the lowest point is a neighbour.
    """
    low = points.groupBy("x", "y").agg(F.min("z").alias("z"))
    n = within(points.select("x", "y", "z").distinct(), low, radius)
    drop = F.col("z") - F.col("p_z")
    off = n.filter((drop > height) & (drop > F.col("d") * tan(radians(slope)))).select("x", "y", "z").distinct().withColumn("_off", F.lit(True))
    return points.join(off, ["x", "y", "z"], "left").withColumn("off_terrain", F.coalesce("_off", F.lit(False))).drop("_off")


def flightline_edge_points(points: Points, size: float) -> Points:
    """Points in cells where their flight line is the least or the greatest column of its row: its edges."""
    c = to_cells(points, size)
    ends = c.groupBy("point_source_id", "row").agg(F.min("col").alias("_a"), F.max("col").alias("_b"))
    return c.join(ends, ["point_source_id", "row"]).filter("col = _a OR col = _b").select(*points.columns)


def normal_vectors(points: Points, radius: float) -> DataFrame:
    """x, y, z and the unit normal (nx, ny, nz, upward) of the least-squares plane through the points within ``radius``; NULL for fewer than three."""
    own = points.select("x", "y", "z").distinct()
    n = within(own, own, radius)
    u, v, w = (F.col(f"p_{c}") - F.col(c) for c in "xyz")
    s = n.groupBy("x", "y", "z").agg(F.count(F.lit(1)).alias("n"), *[F.sum(e).alias(k) for k, e in (("u", u), ("v", v), ("w", w), ("uu", u * u), ("vv", v * v), ("uv", u * v), ("uw", u * w), ("vw", v * w))])
    c = lambda a, b: F.col(a + b) - F.col(a) * F.col(b) / F.col("n")
    det = c("u", "u") * c("v", "v") - c("u", "v") * c("u", "v")
    p = (c("u", "w") * c("v", "v") - c("v", "w") * c("u", "v")) / F.nullif(det, F.lit(0.0))
    q = (c("v", "w") * c("u", "u") - c("u", "w") * c("u", "v")) / F.nullif(det, F.lit(0.0))
    size = F.sqrt(p * p + q * q + 1)
    good = (F.col("n") >= 3) & (F.abs(det) > 1e-9)
    return s.select("x", "y", "z", *[F.when(good, e / size).alias(k) for k, e in (("nx", -p), ("ny", -q), ("nz", F.lit(1.0)))])


def digital_surface_model(points: Points, size: float, radius: float) -> DataFrame:
    """row, col, z: the highest point within ``radius`` of each cell's centre."""
    top = points.groupBy("x", "y").agg(F.max("z").alias("z"))
    return within(centres(points, size), top, radius).groupBy("row", "col").agg(F.max("p_z").alias("z"))


def individual_trees(points: Points, radius: float, least_height: float = 0.0) -> Points:
    """x, y, z of the points over ``least_height`` that no point within ``radius`` tops; of equal ones the first by x and y."""
    p = points.filter(F.col("z") >= least_height).groupBy("x", "y").agg(F.max("z").alias("z"))
    higher = (F.col("p_z") > F.col("z")) | ((F.col("p_z") == F.col("z")) & (F.struct("p_x", "p_y") < F.struct("x", "y")))
    lower = within(p, p, radius).filter(higher).select("x", "y").distinct()
    return p.join(lower, ["x", "y"], "left_anti")


def hillshade(points: Points, radius: float, azimuth: float = 315.0, altitude: float = 30.0) -> DataFrame:
    """x, y, z, shade: light (0 to 255) on the plane through the points within ``radius``; NULL where there is none."""
    n = normal_vectors(points, radius)
    a, h = radians(azimuth), radians(altitude)
    light = F.col("nx") * (sin(a) * cos(h)) + F.col("ny") * (cos(a) * cos(h)) + F.col("nz") * sin(h)
    return n.select("x", "y", "z", F.when(F.col("nz").isNotNull(), F.round(F.greatest(light, F.lit(0.0)) * 255)).alias("shade"))


def segmentation(points: Points, radius: float, norm_diff: float = 10.0, height_diff: float = 1.0) -> DataFrame:
    """x, y, z, segment: places connected over steps of at most ``radius`` with normals at most ``norm_diff`` degrees apart and at
    most ``height_diff`` off each other's planes; segments are numbered by their least place. Places without a plane are alone."""
    from geoloom.plans.graph import apart, components
    from geoloom.plans.lineage import written
    from geoloom.plans.ranking import ranked

    n = written(ranked(normal_vectors(points, radius), [F.col("x"), F.col("y"), F.col("z")], "id"), "normals")
    j = within(n, n, radius).filter("id < p_id AND nz IS NOT NULL AND p_nz IS NOT NULL")
    dot = sum((F.col(f"n{c}") * F.col(f"p_n{c}") for c in "xyz"), F.lit(0.0))
    off = lambda p: F.abs(sum(((F.col(f"p_{c}") - F.col(c)) * F.col(f"{p}n{c}") for c in "xyz"), F.lit(0.0)))
    near = j.filter((dot >= cos(radians(norm_diff))) & (off("") <= height_diff) & (off("p_") <= height_diff))
    roots = components(n.select("id"), near.select(F.col("id").alias("a"), F.col("p_id").alias("b"))).withColumnRenamed("id", "_i")
    number = ranked(roots.select(F.col("root").alias("_r")).distinct(), [F.col("_r")], "segment")
    return n.join(apart(roots), F.col("id") == F.col("_i")).join(apart(number), F.col("root") == F.col("_r")).select("x", "y", "z", "segment")


def attribute_correlation_neighbourhood(points: DataFrame, first: str, second: str, radius: float, least: int = 3, key: str = "fid") -> DataFrame:
    """key, n, r: Pearson's r of two columns over the points within ``radius`` of each point; NULL for fewer than ``least``."""
    near = within(points.select(key, "x", "y"), points.select("x", "y", F.col(first).alias("first"), F.col(second).alias("second")), radius)
    r = near.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.corr("p_first", "p_second").alias("r"))
    return r.select(key, "n", F.when(F.col("n") >= least, F.nanvl("r", F.lit(None).cast("double"))).alias("r"))
