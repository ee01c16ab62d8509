"""Queries of map algebra."""

from __future__ import annotations

from pyspark.sql import functions as F

from geoloom.functions.cells import BINARY, UNARY
from geoloom.operators import local as op
from geoloom.queries.base import bands, local, local2, raster, register, tidy, tidy_sql, with_inputs

RC = '"row", "col"'

for _name, _sql in UNARY.items():
    _source = "flags" if _name == "negate_boolean" else "unit" if _name in ("arc_cos", "arc_sin", "artanh", "exp", "exp2", "sinh", "cosh", "tanh", "cos", "sin", "tan", "arsinh", "arc_tan", "to_degrees", "to_radians") else "dem2" if _name in ("arcosh", "reciprocal", "square") else "dem_gappy"
    if _name in ("is_nodata", "convert_nodata_to_zero"):
        # NULL in, value out: the SQL sees the whole grid
        _grid = f'full_grid AS (SELECT r.i::INT AS "row", c.i::INT AS "col" FROM (SELECT unnest(range(min("row"), max("row") + 1)) AS i FROM dem_gappy) r, (SELECT unnest(range(min("col"), max("col") + 1)) AS i FROM dem_gappy) c)'
        register(f"math_{_name}", lambda s, d, n=_name: tidy(op.unary(raster(s, d, "dem_gappy"), n)), with_inputs(tidy_sql(f'SELECT g."row", g."col", {_sql} AS z FROM full_grid g LEFT JOIN dem_gappy e ON e."row" = g."row" AND e."col" = g."col"'), "dem_gappy", more=_grid))
    else:
        local(f"math_{_name}", _source, lambda r, n=_name: op.unary(r, n), f"SELECT {RC}, {_sql} AS z FROM {_source}")

_FLAGS = {"logical_and", "logical_or", "logical_xor", "logical_not"}
for _name, _sql in BINARY.items():
    _a, _b = ("flags", "flags2") if _name in _FLAGS else ("unit", "dem2") if _name == "power" else ("dem_gappy", "dem2") if _name == "update_nodata_cells" else ("dem", "dem2")
    if _name == "update_nodata_cells":
        register(f"gis_{_name}", lambda s, d: tidy(op.binary(raster(s, d, "dem_gappy"), raster(s, d, "dem2"), "update_nodata_cells")), with_inputs(tidy_sql('SELECT p."row", p."col", coalesce(a.z, p.z) AS z FROM dem2 p LEFT JOIN dem_gappy a ON a."row" = p."row" AND a."col" = p."col"'), "dem_gappy", "dem2"))
        continue
    _kind = {"wetness_index": "terrain", "stream_power_index": "terrain", "sediment_transport_index": "terrain", "normalized_difference_index": "image"}.get(_name, "math")
    local2(f"{_kind}_{_name}", _a, _b, lambda a, b, n=_name: op.binary(a, b, n), f"SELECT {RC}, {_sql} AS z FROM p")

local("math_add_constant", "dem", lambda r: op.binary(r, 12.5, "add"), f"SELECT {RC}, z + 12.5 AS z FROM dem")
local("math_truncate", "dem", lambda r: op.truncate(r, 1), f"SELECT {RC}, sign(z) * floor(abs(z) * 10.0) / 10.0 AS z FROM dem")
local("data_set_nodata_value", "zones", lambda r: op.set_nodata_value(r, 3.0), f"SELECT {RC}, nullif(z, 3.0) AS z FROM zones")
local("data_modify_nodata_value", "dem_gappy", lambda r: r, f"SELECT {RC}, z FROM dem_gappy")
local("math_rescale_value_range", "dem", lambda r: op.rescale_value_range(r, 0.0, 255.0, 20000.0, 90000.0), f"SELECT {RC}, (least(greatest(z, 20000.0), 90000.0) - 20000.0) / 70000.0 * 255.0 AS z FROM dem")
local("gis_reclass", "dem2", lambda r: op.reclass(r, [(1, 0, 2), (2, 2, 5), (9, 4, 30)]), f"SELECT {RC}, CASE WHEN z >= 0 AND z < 2 THEN 1.0 WHEN z >= 2 AND z < 5 THEN 2.0 WHEN z >= 4 AND z < 30 THEN 9.0 ELSE z END AS z FROM dem2")
local("gis_reclass_assign", "zones", lambda r: op.reclass_assign(r, [(10, 1), (20, 2)]), f"SELECT {RC}, CASE z WHEN 1 THEN 10.0 WHEN 2 THEN 20.0 ELSE z END AS z FROM zones")
local("gis_reclass_equal_interval", "dem", lambda r: op.reclass_equal_interval(r, 2500.0, 10000.0, 80000.0), f"SELECT {RC}, CASE WHEN z BETWEEN 10000.0 AND 80000.0 THEN floor(z / 2500.0) * 2500.0 ELSE z END AS z FROM dem")
register(
    "gis_reclass_from_file",
    lambda s, d: tidy(op.reclass_from_table(raster(s, d, "zones"), s.createDataFrame([(100.0, 0.0, 2.0), (200.0, 2.0, 5.0)], "new double, low double, high double"))),
    with_inputs(tidy_sql(f"SELECT {RC}, CASE WHEN z < 2 THEN 100.0 WHEN z < 5 THEN 200.0 ELSE z END AS z FROM zones"), "zones"),
)
local("plugin_conditional_evaluation", "dem", lambda r: op.conditional(r, "value > 50000 AND row < 25", "value * 2", "-1"), f'SELECT {RC}, CASE WHEN z > 50000 AND "row" < 25 THEN z * 2 ELSE -1.0 END AS z FROM dem')
local("gis_aggregate_raster", "dem", lambda r: op.aggregate_raster(r, 5, "range"), 'SELECT "row" // 5 AS "row", "col" // 5 AS "col", max(z) - min(z) AS z FROM dem GROUP BY 1, 2')
local("gis_aggregate_raster_mean", "dem", lambda r: op.aggregate_raster(r, 4, "mean"), 'SELECT "row" // 4 AS "row", "col" // 4 AS "col", avg(z) AS z FROM dem GROUP BY 1, 2')
for _how, _r, _c in (("vertical", "(SELECT min(\"row\") + max(\"row\") FROM dem) - \"row\"", '"col"'), ("both", "(SELECT min(\"row\") + max(\"row\") FROM dem) - \"row\"", "(SELECT min(\"col\") + max(\"col\") FROM dem) - \"col\"")):
    local(f"image_flip_{_how}", "dem", lambda r, h=_how: op.flip_image(r, h), f'SELECT {_r} AS "row", {_c} AS "col", z FROM dem')
local("data_new_raster_from_base", "dem", lambda r: op.new_raster(r.filter("z IS NOT NULL"), 7.0), f"SELECT {RC}, 7.0 AS z FROM dem")
local("gis_create_plane", "dem", lambda r: op.create_plane(r.filter("z IS NOT NULL"), 15.0, 90.0, 3.0), f'SELECT {RC}, tan(radians(15.0)) * sin(radians(270.0)) * "col" - tan(radians(15.0)) * cos(radians(270.0)) * "row" + 3.0 AS z FROM dem')
local("gis_raster_cell_assignment", "dem", lambda r: op.cell_assignment(r.filter("z IS NOT NULL"), "y"), f'SELECT {RC}, -("row" + 0.5) AS z FROM dem')
local2("gis_clip_raster_to_raster", "dem", "flags", op.clip_to_raster, f"SELECT {RC}, a AS z FROM p WHERE b <> 0")


def _stack(name: str, op_, sql: str) -> None:
    register(name, lambda s, d: tidy(op_(bands(s, d), s, d), digits=4), with_inputs(tidy_sql(sql, digits=4), "bands", "dem", "zones"))


for _name, _agg in {"sum": "sum(z)", "mean": "avg(z)", "max": "max(z)", "min": "min(z)", "max_absolute": "max(abs(z))", "min_absolute": "min(abs(z))"}.items():
    _stack(f"gis_{_name}_overlay", lambda b, s, d, n=_name: op.overlay(b, n), f"SELECT {RC}, {_agg} AS z FROM bands GROUP BY 1, 2")
_stack("gis_multiply_overlay", lambda b, s, d: op.overlay(b.withColumn("z", F.col("z") / 100000.0), "product"), f"SELECT {RC}, product(z / 100000.0) AS z FROM bands GROUP BY 1, 2")
_stack("gis_highest_position", lambda b, s, d: op.position(b, True), f"SELECT {RC}, min(band)::DOUBLE AS z FROM (SELECT *, max(z) OVER (PARTITION BY \"row\", \"col\") AS m FROM bands) q WHERE z = m GROUP BY 1, 2")
_stack("gis_lowest_position", lambda b, s, d: op.position(b, False), f"SELECT {RC}, min(band)::DOUBLE AS z FROM (SELECT *, min(z) OVER (PARTITION BY \"row\", \"col\") AS m FROM bands) q WHERE z = m GROUP BY 1, 2")
_stack("gis_count_if", lambda b, s, d: op.count_if(b.withColumn("z", F.floor(F.col("z") / 10000)), 5.0), f"SELECT {RC}, nullif(count(*) FILTER (floor(z / 10000) = 5), 0)::DOUBLE AS z FROM bands GROUP BY 1, 2")
for _name, _o in {"equal_to": "=", "greater_than": ">", "less_than": "<"}.items():
    _stack(f"gis_percent_{_name}", lambda b, s, d, o=_o: op.percent(b, raster(s, d, "dem"), o), f'SELECT b."row", b."col", 100.0 * count(*) FILTER (b.z {_o} c.z) / count(b.z) AS z FROM bands b JOIN dem c ON c."row" = b."row" AND c."col" = b."col" GROUP BY 1, 2')
_stack("gis_pick_from_list", lambda b, s, d: op.pick_from_list(b, raster(s, d, "zones")), 'SELECT b."row", b."col", b.z FROM bands b JOIN zones p ON p."row" = b."row" AND p."col" = b."col" AND CAST(p.z AS INT) = b.band')
_W = [1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0]
_stack("gis_weighted_sum", lambda b, s, d: op.weighted_sum(b, _W), f"SELECT {RC}, CASE WHEN count(z) = 7 THEN sum(z * (band + 1) / 28.0) END AS z FROM bands GROUP BY 1, 2")
_stack(
    "gis_weighted_overlay",
    lambda b, s, d: op.weighted_overlay(b, _W, [i % 2 == 1 for i in range(7)], [raster(s, d, "zones")], 100.0),
    f'SELECT o."row", o."col", o.z * c.z AS z FROM (SELECT {RC}, CASE WHEN count(p) = 7 THEN sum(100.0 * (CASE WHEN band % 2 = 1 THEN 1 - p ELSE p END) * (band + 1) / 28.0) END AS z FROM (SELECT *, (z - min(z) OVER b) / (max(z) OVER b - min(z) OVER b) AS p FROM bands WINDOW b AS (PARTITION BY band)) q GROUP BY 1, 2) o JOIN zones c ON c."row" = o."row" AND c."col" = o."col"',
)
register(
    "gis_extract_raster_values_at_points",
    lambda s, d: op.extract_values_at_points(bands(s, d), s.range(0, 3000, 7).selectExpr("id AS fid", "CAST(id % 50 AS INT) AS row", "CAST(id DIV 60 AS INT) AS col")),
    with_inputs('SELECT i AS fid, ' + ", ".join(f"max(CASE WHEN band = {b} THEN z END) AS value{b}" for b in range(7)) + ' FROM range(0, 3000, 7) r(i) LEFT JOIN bands b ON b."row" = i % 50 AND b."col" = i // 60 GROUP BY 1', "bands"),
)


def _rgb(s, d):
    r = raster(s, d, "dem").filter("z IS NOT NULL")
    part = lambda k: r.select("row", "col", F.floor(F.col("z") / k).cast("long").__mod__(256).cast("double").alias("z"))
    return part(1), part(7), part(31)


_BAND = lambda k: f"CAST(floor(z / {k}) AS BIGINT) % 256"
register("image_create_colour_composite", lambda s, d: tidy(op.compose(*_rgb(s, d))), with_inputs(tidy_sql(f"SELECT {RC}, CAST(255::BIGINT * 16777216 + ({_BAND(31)}) * 65536 + ({_BAND(7)}) * 256 + {_BAND(1)} AS DOUBLE) AS z FROM dem"), "dem"))
register("image_split_colour_composite", lambda s, d: tidy(op.split(op.compose(*_rgb(s, d)), "green")), with_inputs(tidy_sql(f"SELECT {RC}, CAST({_BAND(7)} AS DOUBLE) AS z FROM dem"), "dem"))


def _three(s, d):
    r, g, b = _rgb(s, d)
    j = r.withColumnRenamed("z", "r").join(g.withColumnRenamed("z", "g"), ["row", "col"])
    return j.join(b.withColumnRenamed("z", "b"), ["row", "col"])


_RGB = f"SELECT {RC}, ({_BAND(1)}) / 255.0 AS r, ({_BAND(7)}) / 255.0 AS g, ({_BAND(31)}) / 255.0 AS b FROM dem"
register(
    "image_rgb_to_ihs",
    lambda s, d: tidy(op.rgb_to_ihs(_three(s, d)), "i", "h", "s"),
    with_inputs(
        tidy_sql(
            f"SELECT {RC}, (r + g + b) / 3 AS i, 2 * pi() / 3 * CASE WHEN r = g AND g = b THEN 0 WHEN least(r, g, b) = b THEN (g - b) / (r + g - 2 * b) WHEN least(r, g, b) = r THEN (b - r) / (g + b - 2 * r) + 1 ELSE (r - g) / (r + b - 2 * g) + 2 END AS h, CASE WHEN r = g AND g = b THEN 0 ELSE 1 - 3 * least(r, g, b) / (r + g + b) END AS s FROM ({_RGB}) q",
            "i", "h", "s",
        ),
        "dem",
    ),
)
register("image_ihs_to_rgb", lambda s, d: tidy(op.ihs_to_rgb(op.rgb_to_ihs(_three(s, d))), "r", "g", "b", digits=3), with_inputs(tidy_sql(f"SELECT {RC}, r * 255 AS r, g * 255 AS g, b * 255 AS b FROM ({_RGB}) q", "r", "g", "b", digits=3), "dem"))
