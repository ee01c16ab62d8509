"""Queries of vector features: a polygon for each customer, a line for each supplier."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.operators import vector as op
from geoloom.queries.base import points, raster, register, table, tidy, tidy_sql, with_inputs
from geoloom.queries.stats import _r, rounded

_RING = [("a", "b"), ("a + w", "b + k % 3"), ("a + w + 1", "b + h"), ("a + w / 2.0", "b + h + k % 4"), ("a - 1", "b + h - 1")]
_HOLE = [("a + 1", "b + 1"), ("a + 2", "b + 1"), ("a + 2", "b + 2"), ("a + 1", "b + 2")]


def polygons(s, d) -> DataFrame:
    c = table(s, d, "customer").selectExpr("c_custkey AS fid", "c_nationkey AS cls", "c_custkey AS k", "c_custkey % 97 AS a", "c_custkey % 89 AS b", "5 + c_custkey % 7 AS w", "4 + c_custkey % 5 AS h")
    ring = lambda pts: F.array(*[F.struct(F.expr(f"CAST({x} AS DOUBLE)").alias("x"), F.expr(f"CAST({y} AS DOUBLE)").alias("y")) for x, y in pts])
    return c.select("fid", "cls", F.when(F.col("k") % 2 == 0, F.array(ring(_RING), ring(_HOLE))).otherwise(F.array(ring(_RING))).alias("parts"))


def _rows(pts, part: int, more: str = "") -> str:
    return " UNION ALL ".join(f"SELECT fid, cls, {part} AS part, {i} AS i, {len(pts)} AS n, CAST({x} AS DOUBLE) AS x, CAST({y} AS DOUBLE) AS y FROM c{more}" for i, (x, y) in enumerate(pts))


#: v: every vertex; e: every edge of the rings; m: area and perimeter of the parts.
V = (
    "c AS (SELECT c_custkey AS fid, c_nationkey AS cls, c_custkey AS k, c_custkey % 97 AS a, c_custkey % 89 AS b, 5 + c_custkey % 7 AS w, 4 + c_custkey % 5 AS h FROM customer), "
    f"v AS ({_rows(_RING, 0)} UNION ALL {_rows(_HOLE, 1, ' WHERE k % 2 = 0')}), "
    "e AS (SELECT p.*, q.x AS x2, q.y AS y2 FROM v p JOIN v q ON q.fid = p.fid AND q.part = p.part AND q.i = (p.i + 1) % p.n), "
    "m AS (SELECT fid, part, abs(sum(x * y2 - x2 * y)) / 2 AS area, sum(sqrt(power(x2 - x, 2) + power(y2 - y, 2))) AS length FROM e GROUP BY 1, 2), "
    "g AS (SELECT fid, sum(CASE WHEN part = 0 THEN area ELSE -area END) AS area, sum(length) AS perimeter, max(CASE WHEN part = 0 THEN area END) AS hull FROM m GROUP BY 1)"
)


def _vector(name: str, fn, sql: str, digits: int = 5) -> None:
    register(f"gis_{name}", lambda s, d: rounded(fn(s, d), digits), f"WITH RECURSIVE {V} {sql}" if sql else None)


for _name, _col, _sql in (("polygon_area", "area", "area"), ("polygon_perimeter", "perimeter", "perimeter"), ("perimeter_area_ratio", "perimeter_area", "perimeter / area"), ("compactness_ratio", "compactness", "area / perimeter"), ("hole_proportion", "hole_proportion", "(hull - area) / hull")):
    _vector(_name, lambda s, d, c=_col: op.measures(polygons(s, d)).select("fid", c), f"SELECT fid, {_r(_sql, _col)} FROM g")
_vector("extract_nodes", lambda s, d: op.vertices(polygons(s, d)), "SELECT fid, CAST(part AS INT) AS part, CAST(i AS INT) AS vertex, x, y FROM v")
_vector("minimum_bounding_envelope", lambda s, d: op.envelope(polygons(s, d)), "SELECT fid, min(x) AS min_x, min(y) AS min_y, max(x) AS max_x, max(y) AS max_y FROM v GROUP BY 1")
_vector("layer_footprint", lambda s, d: op.layer_footprint(polygons(s, d)), "SELECT min(x) AS min_x, min(y) AS min_y, max(x) AS max_x, max(y) AS max_y FROM v")
_vector("centroid_vector", lambda s, d: op.centroid(polygons(s, d)), f"SELECT fid, {_r('sum((x + x2) * (x * y2 - x2 * y)) / (3 * sum(x * y2 - x2 * y))', 'x')}, {_r('sum((y + y2) * (x * y2 - x2 * y)) / (3 * sum(x * y2 - x2 * y))', 'y')} FROM e WHERE part = 0 GROUP BY 1")
_vector("medoid", lambda s, d: op.medoid(polygons(s, d)), "SELECT fid, arg_min(x, k) AS x, arg_min(y, k) AS y FROM (SELECT v.fid, x, y, {'d': sqrt(power(x - mx, 2) + power(y - my, 2)), 'p': part, 'i': i} AS k FROM v JOIN (SELECT fid, median(x) AS mx, median(y) AS my FROM v GROUP BY 1) m ON m.fid = v.fid) q GROUP BY 1")
_vector("linearity_index", lambda s, d: op.linearity_index(polygons(s, d)), f"SELECT fid, {_r('regr_r2(y, x)', 'linearity')} FROM v GROUP BY 1")
_vector("patch_shape_indices", lambda s, d: op.shape_indices(polygons(s, d)), "")
_vector("minimum_convex_hull", lambda s, d: op.measures(op.convex_hull(polygons(s, d))).select("fid", "area"), "")
_vector("minimum_bounding_circle", lambda s, d: op.minimum_bounding_circle(polygons(s, d)), "")
_vector("smooth_vectors", lambda s, d: op.vertices(op.smooth(polygons(s, d))), f"SELECT fid, CAST(part AS INT) AS part, CAST(i AS INT) AS vertex, {_r('CASE WHEN i BETWEEN 1 AND n - 2 THEN avg(x) OVER w ELSE x END', 'x')}, {_r('CASE WHEN i BETWEEN 1 AND n - 2 THEN avg(y) OVER w ELSE y END', 'y')} FROM v WINDOW w AS (PARTITION BY fid, part ORDER BY i ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)")
_vector("extend_vector_lines", lambda s, d: op.vertices(op.extend_lines(polygons(s, d), 2.0)).filter("vertex = 0"), f"SELECT p.fid, CAST(p.part AS INT) AS part, 0 AS vertex, {_r('x + (x - x2) / sqrt(power(x - x2, 2) + power(y - y2, 2)) * 2', 'x')}, {_r('y + (y - y2) / sqrt(power(x - x2, 2) + power(y - y2, 2)) * 2', 'y')} FROM e p WHERE i = 0")
register("data_polygons_to_lines", lambda s, d: op.vertices(op.polygons_to_lines(polygons(s, d))).groupBy("fid", "part").agg(F.count(F.lit(1)).alias("n")), f"WITH {V} SELECT fid, CAST(part AS INT) AS part, count(*) + 1 AS n FROM v GROUP BY 1, 2")
register("data_lines_to_polygons", lambda s, d: op.vertices(op.lines_to_polygons(polygons(s, d))).groupBy("fid").agg(F.count(F.lit(1)).alias("n")), f"WITH {V} SELECT fid, count(*) + count(DISTINCT part) AS n FROM v GROUP BY 1")
register("data_multi_part_to_single_part", lambda s, d: rounded(op.measures(op.multi_to_single(polygons(s, d))).select("fid", "area")), f"WITH {V} SELECT fid, {_r('area', 'area')} FROM m")
register("data_single_part_to_multi_part", lambda s, d: op.single_to_multi(op.multi_to_single(polygons(s, d)), "cls").select("cls", F.size("parts").cast("long").alias("n")), f"WITH {V} SELECT cls, count(*) AS n FROM v WHERE i = 0 GROUP BY 1")
register("data_remove_polygon_holes", lambda s, d: rounded(op.measures(op.remove_holes(polygons(s, d))).select("fid", "area")), f"WITH {V} SELECT fid, {_r('hull', 'area')} FROM g")
register("data_clean_vector", lambda s, d: op.clean(polygons(s, d), 5).select("fid", F.size("parts").cast("long").alias("n")), f"WITH {V} SELECT fid, count(*) AS n FROM v WHERE i = 0 AND n >= 5 GROUP BY 1")
register("data_reinitialize_attribute_table", lambda s, d: polygons(s, d).select("fid"), "SELECT c_custkey AS fid FROM customer")
register("data_add_point_coordinates_to_table", lambda s, d: points(s, d).select("fid", F.col("x").alias("xcoord"), F.col("y").alias("ycoord")), with_inputs("SELECT fid, x AS xcoord, y AS ycoord FROM points", "points"))
register("data_merge_vectors", lambda s, d: op.merge([points(s, d), points(s, d).withColumn("extra", F.lit(1))]).groupBy("parent").agg(F.count(F.lit(1)).alias("n"), F.max("fid").alias("last")), with_inputs("SELECT p AS parent, count(*) AS n, max(fid) AS last FROM points, (VALUES (1), (2)) t(p) GROUP BY 1", "points"))
register(
    "data_join_tables",
    lambda s, d: op.join_tables(table(s, d, "customer").select("c_custkey", "c_nationkey"), "c_custkey", table(s, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), "o_custkey", ["o_orderkey"]),
    "SELECT c_custkey, c_nationkey, o_orderkey, o_orderdate FROM customer LEFT JOIN (SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1) o ON o_custkey = c_custkey",
)
register("plugin_extract_by_attribute", lambda s, d: op.extract_by_attribute(points(s, d), "z > 200000 AND cls = '1-URGENT'").select("fid"), with_inputs("SELECT fid FROM points WHERE z > 200000 AND cls = '1-URGENT'", "points"))

# points and polygons: points of orders, polygons of suppliers spread over them
_BOXES = "SELECT s_suppkey AS fid, CAST(s_suppkey * 13 % 1400 AS DOUBLE) AS x0, CAST(s_suppkey * 29 % 400 AS DOUBLE) AS y0, 40.0 + s_suppkey % 50 AS w, 30.0 + s_suppkey % 40 AS h FROM supplier"


def _diamonds(s, d) -> DataFrame:
    b = table(s, d, "supplier").selectExpr("s_suppkey AS fid", "CAST(s_suppkey * 13 % 1400 AS DOUBLE) AS x0", "CAST(s_suppkey * 29 % 400 AS DOUBLE) AS y0", "CAST(40.0 + s_suppkey % 50 AS DOUBLE) AS w", "CAST(30.0 + s_suppkey % 40 AS DOUBLE) AS h")
    p = lambda x, y: F.struct(F.expr(x).alias("x"), F.expr(y).alias("y"))
    return b.select("fid", F.array(F.array(p("x0 - w", "y0 + 0.123"), p("x0 + 0.037", "y0 - h"), p("x0 + w", "y0 + 0.123"), p("x0 + 0.037", "y0 + h"))).alias("parts"))


#: A point is in a diamond if it is above both lower and below both upper edges.
_IN = " AND ".join(f"({bx} - {ax}) * (p.y - ({ay})) - ({by} - ({ay})) * (p.x - {ax}) {op_} 0".replace("AX", "") for ax, ay, bx, by, op_ in (("(x0 - w)", "y0 + 0.123", "(x0 + 0.037)", "(y0 - h)", ">"), ("(x0 + 0.037)", "y0 - h", "(x0 + w)", "(y0 + 0.123)", ">"), ("(x0 + w)", "y0 + 0.123", "(x0 + 0.037)", "(y0 + h)", ">"), ("(x0 + 0.037)", "y0 + h", "(x0 - w)", "(y0 + 0.123)", ">")))
register("gis_clip", lambda s, d: op.clip_points(points(s, d).select("fid", "x", "y"), _diamonds(s, d), 64.0).select("fid"), with_inputs(f"SELECT DISTINCT p.fid FROM points p JOIN ({_BOXES}) b ON {_IN}", "points"))
register("gis_erase", lambda s, d: op.clip_points(points(s, d).select("fid", "x", "y"), _diamonds(s, d), 64.0, False).select("fid"), with_inputs(f"SELECT fid FROM points EXCEPT ALL SELECT DISTINCT p.fid FROM points p JOIN ({_BOXES}) b ON {_IN}", "points"))
_SMALL = "SELECT s_suppkey AS fid, CAST(s_suppkey * 7 % 50 AS DOUBLE) AS x0, CAST(s_suppkey * 11 % 50 AS DOUBLE) AS y0, 3.0 + s_suppkey % 4 AS w, 2.0 + s_suppkey % 5 AS h FROM supplier"


def _small(s, d) -> DataFrame:
    b = table(s, d, "supplier").selectExpr("s_suppkey AS fid", "CAST(s_suppkey * 7 % 50 AS DOUBLE) AS x0", "CAST(s_suppkey * 11 % 50 AS DOUBLE) AS y0", "CAST(3.0 + s_suppkey % 4 AS DOUBLE) AS w", "CAST(2.0 + s_suppkey % 5 AS DOUBLE) AS h")
    p = lambda x, y: F.struct(F.expr(x).alias("x"), F.expr(y).alias("y"))
    return b.select("fid", F.array(F.array(p("x0 - w", "y0 + 0.123"), p("x0 + 0.037", "y0 - h"), p("x0 + w", "y0 + 0.123"), p("x0 + 0.037", "y0 + h"))).alias("parts"))


_CENTRES = 'p AS (SELECT "row", "col", z, "col" + 0.5 AS x, "row" + 0.5 AS y FROM dem)'
_dem = lambda s, d: raster(s, d, "dem").filter("z IS NOT NULL")
register("data_vector_polygons_to_raster", lambda s, d: tidy(op.rasterize_polygons(_small(s, d), _dem(s, d))), with_inputs(tidy_sql(f'SELECT p."row", p."col", max(b.fid) AS z FROM p JOIN ({_SMALL}) b ON {_IN} GROUP BY 1, 2'), "dem", more=_CENTRES))
register("gis_clip_raster_to_polygon", lambda s, d: tidy(op.clip_raster(_dem(s, d), _small(s, d))), with_inputs(tidy_sql(f'SELECT DISTINCT p."row", p."col", p.z FROM p JOIN ({_SMALL}) b ON {_IN}'), "dem", more=_CENTRES))
register("gis_erase_polygon_from_raster", lambda s, d: tidy(op.clip_raster(_dem(s, d), _small(s, d).filter("fid % 3 = 0"), False)), with_inputs(tidy_sql(f'SELECT "row", "col", z FROM p WHERE NOT EXISTS (SELECT 1 FROM ({_SMALL}) b WHERE fid % 3 = 0 AND {_IN})'), "dem", more=_CENTRES))


def _lines(s, d, kind: int) -> DataFrame:
    t = table(s, d, "supplier").filter(F.col("s_suppkey") % 2 == kind).selectExpr("s_suppkey AS fid", f"CAST(s_suppkey * {17 + kind} % 211 AS DOUBLE) AS a", f"CAST(s_suppkey * {31 + kind} % 197 AS DOUBLE) AS b")
    p = lambda x, y: F.struct(F.expr(x).alias("x"), F.expr(y).alias("y"))
    return t.select("fid", F.array(F.array(p("a", "b"), p("a + 37.5", "b + 11.25 * (fid % 5 - 2)"), p("a + 60.25", "b - 20.5"))).alias("parts"))


def _seg(kind: int) -> str:
    t = f"(SELECT s_suppkey AS fid, CAST(s_suppkey * {17 + kind} % 211 AS DOUBLE) AS a, CAST(s_suppkey * {31 + kind} % 197 AS DOUBLE) AS b FROM supplier WHERE s_suppkey % 2 = {kind})"
    return f"SELECT fid, a AS x1, b AS y1, a + 37.5 AS x2, b + 11.25 * (fid % 5 - 2) AS y2 FROM {t} t UNION ALL SELECT fid, a + 37.5, b + 11.25 * (fid % 5 - 2), a + 60.25, b - 20.5 FROM {t} t"


register(
    "gis_line_intersections",
    lambda s, d: rounded(op.line_intersections(_lines(s, d, 0), _lines(s, d, 1), 32.0), 4),
    f"SELECT fid1, fid2, {_r('x1 + t * (x2 - x1)', 'x', 4)}, {_r('y1 + t * (y2 - y1)', 'y', 4)} FROM (SELECT s.fid AS fid1, q.fid AS fid2, s.*, ((s.x1 - q.x1) * (q.y1 - q.y2) - (s.y1 - q.y1) * (q.x1 - q.x2)) / ((s.x1 - s.x2) * (q.y1 - q.y2) - (s.y1 - s.y2) * (q.x1 - q.x2)) AS t, ((s.x1 - q.x1) * (s.y1 - s.y2) - (s.y1 - q.y1) * (s.x1 - s.x2)) / ((s.x1 - s.x2) * (q.y1 - q.y2) - (s.y1 - s.y2) * (q.x1 - q.x2)) AS u FROM ({_seg(0)}) s, ({_seg(1)}) q WHERE (s.x1 - s.x2) * (q.y1 - q.y2) - (s.y1 - s.y2) * (q.x1 - q.x2) <> 0) z WHERE t BETWEEN 0 AND 1 AND u BETWEEN 0 AND 1",
)
register("gis_create_rectangular_vector_grid", lambda s, d: rounded(op.measures(op.rectangular_grid(0, 0, 100, 60, 10, 7, s)).select("fid", "area")), "SELECT i AS fid, 70.0::DOUBLE AS area FROM range(0, 90) r(i)")
