"""Queries of clouds, cost paths, lattices, lines and neighbourhood statistics."""

from __future__ import annotations


from pyspark.sql import functions as F

from geoloom.operators import cloud, contours, distance, hydro, stats, terrain
from geoloom.operators import vector as vec
from geoloom.plans.lineage import written
from geoloom.queries.base import lidar, points, raster, register, table, tidy, tidy_sql, with_inputs
from geoloom.queries.distance import _targets
from geoloom.queries.stats import _r, rounded
from geoloom.queries.vector import _BOXES, _IN, _diamonds, polygons

RC = '"row", "col"'


def _cloud(name: str, fn, sql: str | None, more: str = "") -> None:
    register(f"lidar_{name}", lambda s, d: rounded(fn(s, d), 4), None if sql is None else with_inputs(sql, "lidar", more=more))


_cloud("filter_classes", lambda s, d: cloud.filter_classes(lidar(s, d), (2, 5)).select("x", "y", "classification"), "SELECT x, y, classification FROM lidar WHERE classification NOT IN (2, 5)")
_cloud("filter_scan_angles", lambda s, d: cloud.filter_scan_angles(lidar(s, d).withColumn("scan_angle", F.col("intensity") - 25), 10).select("x", "y", "intensity"), "SELECT x, y, intensity FROM lidar WHERE abs(intensity - 25) <= 10")
_cloud("join", lambda s, d: cloud.join([lidar(s, d), lidar(s, d).filter("return_no = 1")]).groupBy("return_no").agg(F.count(F.lit(1)).alias("n")), "SELECT return_no, count(*) * (CASE WHEN return_no = 1 THEN 2 ELSE 1 END) AS n FROM lidar GROUP BY 1")
_cloud("tile", lambda s, d: cloud.tiles(lidar(s, d), 100.0, 2).select("row", "col", "x", "y", "intensity"), 'SELECT CAST(floor(y / 100) AS INT) AS "row", CAST(floor(x / 100) AS INT) AS "col", x, y, intensity FROM lidar QUALIFY count(*) OVER (PARTITION BY floor(y / 100), floor(x / 100)) >= 2')
_cloud("histogram", lambda s, d: cloud.histogram(lidar(s, d), "intensity", 5.0), "SELECT CAST(floor(intensity / 5.0) AS INT) AS bin, count(*) AS n FROM lidar GROUP BY 1")
_cloud("classify_overlap_points", lambda s, d: cloud.classify_overlap_points(lidar(s, d), 50.0).groupBy("classification").agg(F.count(F.lit(1)).alias("n")), "SELECT c AS classification, count(*) AS n FROM (SELECT CASE WHEN point_source_id <> min(point_source_id) OVER (PARTITION BY floor(y / 50), floor(x / 50)) THEN 12 ELSE classification END AS c FROM lidar) q GROUP BY 1")
register("lidar_colourize", lambda s, d: rounded(cloud.colourize(lidar(s, d), raster(s, d, "dem"), 40.0).select("x", "y", "colour")), with_inputs(f'SELECT x, y, {_r("t.z", "colour")} FROM lidar l JOIN dem t ON t."row" = floor(l.y / 40) AND t."col" = floor(l.x / 40)', "lidar", "dem"))
_cloud("las_to_ascii", lambda s, d: cloud.to_text(lidar(s, d).select(F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), "intensity", "return_no"), ["x", "y", "intensity", "return_no"]), "SELECT CAST(x AS BIGINT) || ',' || CAST(y AS BIGINT) || ',' || intensity || ',' || return_no AS line FROM lidar")
_cloud("ascii_to_las", lambda s, d: cloud.from_text(cloud.to_text(lidar(s, d), ["x", "y", "intensity", "return_no"]), "x double, y double, intensity int, return_no int"), "SELECT x, y, intensity, return_no FROM lidar")
_FLAT = lambda s, d: lidar(s, d).select("x", "y", "intensity")
_INL = _IN.replace("p.x", "l.x").replace("p.y", "l.y")
_cloud("clip_to_polygon", lambda s, d: cloud.clip_to_polygons(_FLAT(s, d), _diamonds(s, d), 64.0), f"SELECT x, y, intensity FROM lidar l WHERE EXISTS (SELECT 1 FROM ({_BOXES}) b WHERE {_INL})")
_cloud("erase_polygon", lambda s, d: cloud.erase_polygons(_FLAT(s, d), _diamonds(s, d), 64.0), f"SELECT x, y, intensity FROM lidar l WHERE NOT EXISTS (SELECT 1 FROM ({_BOXES}) b WHERE {_INL})")
_cloud("classify_subset", lambda s, d: cloud.classify_subset(lidar(s, d), lidar(s, d).filter("return_no = 2"), 9, 1).groupBy("classification").agg(F.count(F.lit(1)).alias("n")), "SELECT c AS classification, count(*) AS n FROM (SELECT CASE WHEN EXISTS (SELECT 1 FROM lidar b WHERE b.return_no = 2 AND b.x = a.x AND b.y = a.y AND b.z = a.z) THEN 9 ELSE 1 END AS c FROM lidar a) q GROUP BY 1")
_cloud(
    "kappa_index",
    lambda s, d: cloud.kappa(lidar(s, d).dropDuplicates(["x", "y", "z"]).withColumn("classification", F.when(F.col("x") % 7 == 0, 1).otherwise(F.when(F.col("y") % 2 == 0, 2).otherwise(5))), lidar(s, d).dropDuplicates(["x", "y", "z"]).withColumn("classification", F.when(F.col("y") % 2 == 0, 2).otherwise(5))),
    f"SELECT n, {_r('same / n', 'agreement', 4)}, {_r('(same - rc / n) / (n - rc / n)', 'kappa', 4)} FROM (SELECT count(*) AS n, sum(CASE WHEN a = b THEN 1 ELSE 0 END) AS same, sum(CASE WHEN a = 2 THEN 1 ELSE 0 END) * sum(CASE WHEN b = 2 THEN 1 ELSE 0 END) + sum(CASE WHEN a = 5 THEN 1 ELSE 0 END) * sum(CASE WHEN b = 5 THEN 1 ELSE 0 END) + 0.0 AS rc FROM k) q",
    more="k AS (SELECT DISTINCT x, y, z, CASE WHEN x % 7 = 0 THEN 1 WHEN y % 2 = 0 THEN 2 ELSE 5 END AS a, CASE WHEN y % 2 = 0 THEN 2 ELSE 5 END AS b FROM lidar)",
)
_NEAR = "p.x BETWEEN l.x - 3 AND l.x + 3 AND p.y BETWEEN l.y - 3 AND l.y + 3 AND sqrt(power(l.x - p.x, 2) + power(l.y - p.y, 2)) <= 3"
_cloud("ground_point_filter", lambda s, d: cloud.ground_point_filter(lidar(s, d), 3.0, 45.0, 100.0).select("x", "y", "z", "off_terrain"), f"SELECT x, y, {_r('z', 'z', 4)}, EXISTS (SELECT 1 FROM lidar p WHERE {_NEAR} AND l.z - p.z > 100 AND l.z - p.z > sqrt(power(l.x - p.x, 2) + power(l.y - p.y, 2))) AS off_terrain FROM lidar l")
_cloud("find_flightline_edge_points", lambda s, d: cloud.flightline_edge_points(lidar(s, d), 50.0).select("x", "y", "point_source_id"), "SELECT x, y, point_source_id FROM lidar QUALIFY floor(x / 50) = min(floor(x / 50)) OVER g OR floor(x / 50) = max(floor(x / 50)) OVER g WINDOW g AS (PARTITION BY point_source_id, floor(y / 50))".replace(" QUALIFY", " WINDOW g AS (PARTITION BY point_source_id, floor(y / 50)) QUALIFY").replace(" OVER g WINDOW g AS (PARTITION BY point_source_id, floor(y / 50))", " OVER g"))
_cloud("normal_vectors", lambda s, d: cloud.normal_vectors(lidar(s, d).withColumn("z", F.col("z") / 10000), 4.0), None)
_cloud("digital_surface_model", lambda s, d: cloud.digital_surface_model(lidar(s, d), 40.0, 30.0), None)
register("plugin_individual_tree_detection", lambda s, d: rounded(cloud.individual_trees(lidar(s, d), 3.0, 30000.0), 4), with_inputs(f"SELECT x, y, {_r('z', 'z', 4)} FROM q l WHERE NOT EXISTS (SELECT 1 FROM q p WHERE {_NEAR} AND (p.z > l.z OR (p.z = l.z AND (p.x < l.x OR (p.x = l.x AND p.y < l.y)))))", "lidar", more="q AS (SELECT x, y, max(z) AS z FROM lidar WHERE z >= 30000 GROUP BY 1, 2)"))
register("lidar_select_tiles_by_polygon", lambda s, d: cloud.select_tiles(s.range(100).selectExpr("id AS tile", "CAST(id % 10 * 150 AS DOUBLE) AS x0", "CAST(floor(id / 10) * 50 AS DOUBLE) AS y0", "CAST(id % 10 * 150 + 150 AS DOUBLE) AS x1", "CAST(floor(id / 10) * 50 + 50 AS DOUBLE) AS y1"), _diamonds(s, d)).select("tile"), None)


# cost paths
def _cost(s, d):
    return raster(s, d, "dem2").select("row", "col", (F.col("z") + 1).alias("z"))


def _links(s, d):
    total = written(distance.cost_distance(_targets(s, d), _cost(s, d)), "cost")
    return distance.backlink(total, _cost(s, d))


register("gis_cost_allocation", lambda s, d: tidy(distance.cost_allocation(_targets(s, d), _links(s, d))))
register("gis_cost_pathway", lambda s, d: tidy(distance.cost_pathway(raster(s, d, "flags"), _links(s, d))))

# neighbourhoods, trends and profiles
_BOTH = "w AS (SELECT a.\"row\", a.\"col\", c.z AS x, d.z AS y FROM dem a JOIN dem c ON abs(c.\"row\" - a.\"row\") <= 2 AND abs(c.\"col\" - a.\"col\") <= 2 JOIN dem2 d ON d.\"row\" = c.\"row\" AND d.\"col\" = c.\"col\")"
register("stats_image_correlation_neighbourhood_analysis", lambda s, d: tidy(stats.correlation_neighbourhood(raster(s, d, "dem"), raster(s, d, "dem2"), 5), digits=4), with_inputs(tidy_sql(f"SELECT {RC}, CASE WHEN var_pop(x) > 0 AND var_pop(y) > 0 THEN corr(x, y) END AS z FROM w GROUP BY 1, 2", digits=4), "dem", "dem2", more=_BOTH))
register(
    "math_trend_surface_vector_points",
    lambda s, d: tidy(stats.trend_surface_points(points(s, d), raster(s, d, "dem").filter("z IS NOT NULL")), digits=3),
    with_inputs(tidy_sql(f'SELECT {RC}, b0 + b1 * ("col" + 0.5) + b2 * ("row" + 0.5) AS z FROM dem, fit', digits=3), "dem", "points", more="m AS (SELECT avg(x) AS mx, avg(y) AS my, avg(z) AS mz FROM points), c AS (SELECT mx, my, mz, sum((x - mx) * (x - mx)) AS xx, sum((y - my) * (y - my)) AS yy, sum((x - mx) * (y - my)) AS xy, sum((x - mx) * (z - mz)) AS xz, sum((y - my) * (z - mz)) AS yz FROM points, m GROUP BY 1, 2, 3), s AS (SELECT *, (xz * yy - yz * xy) / (xx * yy - xy * xy) AS b1, (yz * xx - xz * xy) / (xx * yy - xy * xy) AS b2 FROM c), fit AS (SELECT b1, b2, mz - b1 * mx - b2 * my AS b0 FROM s)"),
)
register("plugin_convergence_index", lambda s, d: tidy(terrain.convergence_index(raster(s, d, "dem").select("row", "col", (F.col("z") / 10000).alias("z")))))


def _rays(s):
    p = lambda x, y: F.struct(F.expr(f"CAST({x} AS DOUBLE)").alias("x"), F.expr(f"CAST({y} AS DOUBLE)").alias("y"))
    return s.range(0, 40, 7).select(F.col("id").alias("fid"), F.array(F.array(p("id + 0.25", "2.25"), p("id + 0.25", "14.25"))).alias("parts"))


register("terrain_profile", lambda s, d: rounded(terrain.profile(_rays(s), raster(s, d, "dem")).filter("z IS NOT NULL")), with_inputs(f'SELECT i AS fid, CAST(k AS DOUBLE) AS distance, {_r("z", "z")} FROM range(0, 40, 7) r(i), range(0, 12) q(k), dem WHERE "row" = k + 2 AND "col" = i AND z IS NOT NULL', "dem"))
register("data_vector_lines_to_raster", lambda s, d: tidy(vec.rasterize_lines(_rays(s), raster(s, d, "dem"))), with_inputs(tidy_sql('SELECT DISTINCT "row", "col", CAST(i AS DOUBLE) AS z FROM range(0, 40, 7) r(i), g WHERE "col" = i AND "row" BETWEEN 2 AND 14'), "dem", more='g AS (SELECT CAST(r.i AS INT) AS "row", CAST(c.i AS INT) AS "col" FROM (SELECT unnest(range((SELECT min("row") FROM dem), (SELECT max("row") FROM dem) + 1)) AS i) r, (SELECT unnest(range((SELECT min("col") FROM dem), (SELECT max("col") FROM dem) + 1)) AS i) c)'))
register("plugin_split_vector_lines", lambda s, d: rounded(vec.split_lines(_rays(s), 5.0).select("fid", "piece", "y1", "y2")), f"SELECT i AS fid, k AS piece, {_r('2.25 + k * 5', 'y1')}, {_r('least(2.25 + (k + 1) * 5, 14.25)', 'y2')} FROM range(0, 40, 7) r(i), range(0, 3) q(k)")

# lattices and boxes
_SIDE = 7.0 / 3**0.5
register("gis_create_hexagonal_vector_grid", lambda s, d: rounded(vec.measures(vec.hexagonal_grid(0.0, 0.0, 50.0, 30.0, 7.0, s)).join(vec.centroid(vec.hexagonal_grid(0.0, 0.0, 50.0, 30.0, 7.0, s)), "fid").select("fid", "x", "y", "area")), f"SELECT fid, {_r('(fid % 9 + (fid // 9 % 2) * 0.5) * 7', 'x')}, {_r(f'(fid // 9) * 1.5 * {_SIDE!r}', 'y')}, {_r(f'1.5 * sqrt(3) * {_SIDE * _SIDE!r}', 'area')} FROM range(0, 54) t(fid)")
register("gis_minimum_bounding_box", lambda s, d: rounded(vec.minimum_bounding_box(polygons(s, d)).select("fid", "long", "short")))
for _name, _col in (("elongation_ratio", "elongation"), ("shape_complexity_index", "complexity"), ("related_circumscribing_circle", "circumscribing"), ("patch_orientation", "orientation")):
    register(f"gis_{_name}", lambda s, d, c=_col: rounded(vec.shape_indices(polygons(s, d)).select("fid", c)))
for _name in ("long", "short"):
    register(f"gis_polygon_{_name}_axis", lambda s, d, w=_name: rounded(vec.vertices(vec.polygon_axes(polygons(s, d), w)).select("fid", "vertex", "x", "y")))
register("gis_deviation_from_regional_direction", lambda s, d: rounded(vec.deviation_from_regional_direction(polygons(s, d), 0.2)))


def _csv(s, d):
    from geoloom.plans.lineage import shared_folder

    path = f"{shared_folder(s)}/nations.csv"
    table(s, d, "nation").select("n_nationkey", "n_regionkey").write.mode("overwrite").csv(path, header=True)
    return path


register("data_merge_table_with_csv", lambda s, d: vec.merge_with_csv(table(s, d, "customer").select("c_custkey", "c_nationkey"), "c_nationkey", _csv(s, d), "n_nationkey", ["n_regionkey"], ["n_regionkey"]).select("c_custkey", F.col("n_regionkey").cast("long").alias("region")), "SELECT c_custkey, CAST(n_regionkey AS BIGINT) AS region FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey")
_PTS = "p.x BETWEEN l.x - 20 AND l.x + 20 AND p.y BETWEEN l.y - 20 AND l.y + 20 AND sqrt(power(l.x - p.x, 2) + power(l.y - p.y, 2)) <= 20"
register("stats_attribute_correlation_neighbourhood_analysis", lambda s, d: rounded(cloud.attribute_correlation_neighbourhood(points(s, d), "y", "x", 20.0), 4).filter("n > 3"), with_inputs(f"SELECT fid, n, {_r('r', 'r', 4)} FROM (SELECT l.fid, count(*) AS n, corr(p.y, p.x) AS r FROM points l JOIN points p ON {_PTS} GROUP BY 1) q WHERE n > 3", "points"))
_cloud("hillshade", lambda s, d: cloud.hillshade(lidar(s, d).withColumn("z", F.col("z") / 10000), 4.0), None)
_cloud("segmentation", lambda s, d: cloud.segmentation(lidar(s, d).withColumn("z", F.col("z") / 10000), 4.0, 20.0, 2.0), None)
register("terrain_map_off_terrain_objects", lambda s, d: tidy(hydro.map_off_terrain_objects(raster(s, d, "dem").select("row", "col", (F.col("z") / 10000).alias("z")), 60.0, 5)))
_CORNER = "sq AS (SELECT a.\"row\" AS r, a.\"col\" AS c, a.z AS z0, b.z AS z1, e.z AS z2, g.z AS z3 FROM dem a LEFT JOIN dem b ON b.\"row\" = a.\"row\" AND b.\"col\" = a.\"col\" + 1 LEFT JOIN dem e ON e.\"row\" = a.\"row\" + 1 AND e.\"col\" = a.\"col\" + 1 LEFT JOIN dem g ON g.\"row\" = a.\"row\" + 1 AND g.\"col\" = a.\"col\"), tri AS (SELECT 0 AS ax, 0 AS ay, z0 AS az, 1 AS bx, 0 AS by_, z1 AS bz, 1 AS cx, 1 AS cy, z2 AS cz FROM sq UNION ALL SELECT 0, 0, z0, 1, 1, z2, 0, 1, z3 FROM sq), lv AS (SELECT tri.*, CAST(k * 20000 AS DOUBLE) AS v FROM tri, range(0, 8) t(k) WHERE az IS NOT NULL AND bz IS NOT NULL AND cz IS NOT NULL), cr AS (SELECT v, list_filter([CASE WHEN (az >= v) <> (bz >= v) THEN {'x': ax + (v - az) / (bz - az) * (bx - ax), 'y': ay + (v - az) / (bz - az) * (by_ - ay)} END, CASE WHEN (bz >= v) <> (cz >= v) THEN {'x': bx + (v - bz) / (cz - bz) * (cx - bx), 'y': by_ + (v - bz) / (cz - bz) * (cy - by_)} END, CASE WHEN (az >= v) <> (cz >= v) THEN {'x': ax + (v - az) / (cz - az) * (cx - ax), 'y': ay + (v - az) / (cz - az) * (cy - ay)} END], lambda e: e IS NOT NULL) AS e FROM lv)"
register(
    "terrain_contours_from_raster",
    lambda s, d: rounded(contours.contours(raster(s, d, "dem"), 20000.0).groupBy("level").agg(F.sum("segments").alias("segments"), F.sum("length").alias("length")), 4),
    with_inputs(f"SELECT v AS level, count(*) AS segments, {_r('sum(sqrt(power(e[1].x - e[2].x, 2) + power(e[1].y - e[2].y, 2)))', 'length', 4)} FROM cr WHERE len(e) = 2 GROUP BY 1", "dem", more=_CORNER),
)
