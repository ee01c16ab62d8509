"""Queries of image enhancement, lines in Boolean rasters and patches."""

from __future__ import annotations

from pyspark.sql import functions as F

from geoloom.operators import colour as op
from geoloom.operators import hydro, lines, patches
from geoloom.operators import local as loc
from geoloom.queries.base import local, neighbours_sql, raster, register, tidy, tidy_sql, with_inputs
from geoloom.queries.local import _BAND, _rgb
from geoloom.queries.stats import _CDF, _HIST, _r, rounded

RC = '"row", "col"'
_B = "(h * h * 100.0 - s * 255.0 + l * l * 155.0) / (2 * (h * 100.0 - e * 255.0 + l * 155.0))"
local(
    "image_balance_contrast_enhancement", "dem2", op.balance_contrast_enhancement,
    f"SELECT {RC}, a * (z - b) * (z - b) - a * (l - b) * (l - b) AS z FROM (SELECT *, 255.0 / ((h - l) * (h + l - 2 * b)) AS a FROM (SELECT *, {_B} AS b FROM (SELECT *, min(z) OVER () AS l, max(z) OVER () AS h, avg(z) OVER () AS e, avg(z * z) OVER () AS s FROM dem2) x) y) q",
)
_TONES = "rgb AS (SELECT {0}, r - floor(least(r, g, b) * 0.5 + (0.0)) AS r0, r, g, b FROM (SELECT {0}, CAST({1} AS DOUBLE) AS r, CAST({2} AS DOUBLE) AS g, CAST({3} AS DOUBLE) AS b FROM dem) x)".format(RC, _BAND(1), _BAND(7), _BAND(31))
_LESS = lambda c: f"floor({c} - 0.5 * least(r, g, b))"
_CUT = ", ".join(["d AS (SELECT {0}, {1} AS r, {2} AS g, {3} AS b FROM rgb)".format(RC, _LESS("r"), _LESS("g"), _LESS("b"))] + [f"e{c} AS (SELECT min(v) FILTER (cdf > 0.01) AS lo, min(v) FILTER (cdf >= 0.99) AS hi FROM (SELECT {c} AS v, sum(count(*)) OVER (ORDER BY {c}) / sum(count(*)) OVER () AS cdf FROM d GROUP BY {c}) x)" for c in "rgb"])
_STRETCHED = lambda c: f"CAST(least(greatest(floor(({c} - e{c}.lo) / (e{c}.hi - e{c}.lo) * 255), 0), 255) AS BIGINT)"
register(
    "image_direct_decorrelation_stretch",
    lambda s, d: tidy(op.direct_decorrelation_stretch(loc.compose(*_rgb(s, d)))),
    with_inputs(tidy_sql(f"SELECT {RC}, CAST(255::BIGINT * 16777216 + {_STRETCHED('b')} * 65536 + {_STRETCHED('g')} * 256 + {_STRETCHED('r')} AS DOUBLE) AS z FROM d, er, eg, eb"), "dem", more=f"{_TONES}, {_CUT}"),
)
_NORMAL = "ref AS (SELECT CAST(i AS DOUBLE) AS value, sum(exp(-power(-3.0 + i * 6.0 / 255, 2) / 2)) OVER (ORDER BY i) / sum(exp(-power(-3.0 + i * 6.0 / 255, 2) / 2)) OVER () AS cdf FROM range(0, 256) t(i))"
_PLACE = "SELECT h.\"row\", h.\"col\", coalesce((SELECT min(value) FROM ref WHERE ref.cdf >= c.cdf), (SELECT max(value) FROM ref)) AS z FROM h JOIN c USING (bin)"
register("image_gaussian_contrast_stretch", lambda s, d: tidy(op.gaussian_contrast_stretch(raster(s, d, "dem"))), with_inputs(tidy_sql(_PLACE), "dem", more=_HIST.format(2048) + _CDF + ", " + _NORMAL))
register(
    "image_histogram_matching",
    lambda s, d: tidy(op.histogram_matching(raster(s, d, "dem"), s.range(1, 51).selectExpr("CAST(id AS DOUBLE) AS value", "id * (51 - id) AS frequency"))),
    with_inputs(tidy_sql(_PLACE), "dem", more=_HIST.format(2048) + _CDF + ", ref AS (SELECT CAST(i AS DOUBLE) AS value, sum(i * (51 - i)) OVER (ORDER BY i) / sum(i * (51 - i)) OVER () AS cdf FROM range(1, 51) t(i))"),
)
_TONE = lambda t: f"(SELECT {RC}, CAST(floor((z - min(z) OVER ()) / (max(z) OVER () - min(z) OVER ()) * 255) AS BIGINT) AS v FROM {t})"
register(
    "image_write_function_memory_insertion",
    lambda s, d: tidy(op.write_function_memory_insertion([raster(s, d, "dem"), raster(s, d, "dem2")])),
    with_inputs(tidy_sql(f"SELECT {RC}, CAST(255::BIGINT * 16777216 + b.v * 65536 + b.v * 256 + a.v AS DOUBLE) AS z FROM {_TONE('dem')} a JOIN {_TONE('dem2')} b USING ({RC})"), "dem", "dem2"),
)


def _coarse(s, d):
    return [loc.aggregate_raster(b, 2, "maximum") for b in _rgb(s, d)]


def _pan(s, d):
    return raster(s, d, "dem2").select("row", "col", (F.col("z") * 5).alias("z"))


_SHARP = f"lo AS (SELECT CAST(floor(\"row\" / 2) AS INT) AS r2, CAST(floor(\"col\" / 2) AS INT) AS c2, max(CAST({_BAND(1)} AS DOUBLE)) AS r, max(CAST({_BAND(7)} AS DOUBLE)) AS g, max(CAST({_BAND(31)} AS DOUBLE)) AS b FROM dem GROUP BY 1, 2)"
_SHARPENED = lambda c: f"CAST(CASE WHEN r + g + b > 0 THEN least(floor({c} / ((r + g + b) / 3) * (z * 5)), 255) ELSE 0 END AS BIGINT)"
register(
    "image_panchromatic_sharpening",
    lambda s, d: tidy(op.panchromatic_sharpening(*_coarse(s, d), _pan(s, d), 2)),
    with_inputs(tidy_sql(f'SELECT {RC}, CAST(255::BIGINT * 16777216 + {_SHARPENED("b")} * 65536 + {_SHARPENED("g")} * 256 + {_SHARPENED("r")} AS DOUBLE) AS z FROM dem2 JOIN lo ON r2 = CAST(floor("row" / 2) AS INT) AND c2 = CAST(floor("col" / 2) AS INT)'), "dem", "dem2", more=_SHARP),
)
register("image_panchromatic_sharpening_ihs", lambda s, d: tidy(op.panchromatic_sharpening(*_coarse(s, d), _pan(s, d), 2, "ihs")), None)
_INWARD = lambda name, t, where: f"{name} AS (SELECT a.\"row\", a.\"col\", a.z, power((SELECT min(sqrt(power(a.\"row\" - y, 2) + power(a.\"col\" - x, 2))) FROM out_{name}), 4.0) AS w FROM (SELECT * FROM {t} WHERE z IS NOT NULL AND {where}) a)"
_OUT = lambda name, t, where: f"out_{name} AS (SELECT y, x FROM (SELECT unnest(range((SELECT min(\"row\") FROM {t} WHERE {where}) - 1, (SELECT max(\"row\") FROM {t} WHERE {where}) + 2)) AS y) r, (SELECT unnest(range((SELECT min(\"col\") FROM {t} WHERE {where}) - 1, (SELECT max(\"col\") FROM {t} WHERE {where}) + 2)) AS x) c WHERE NOT EXISTS (SELECT 1 FROM {t} q WHERE q.\"row\" = y AND q.\"col\" = x AND q.z IS NOT NULL AND {where}))"
_LEFT, _RIGHT = '"row" < 12 AND "col" < 14', '"row" > 4 AND "row" < 18 AND "col" > 6 AND "col" < 20'
register(
    "image_mosaic_with_feathering",
    lambda s, d: tidy(op.mosaic_with_feathering(raster(s, d, "dem").filter("row < 12 AND col < 14"), raster(s, d, "dem2").filter("row > 4 AND row < 18 AND col > 6 AND col < 20")), digits=3),
    with_inputs(
        tidy_sql(f"SELECT {RC}, CASE WHEN a.z IS NULL THEN b.z WHEN b.z IS NULL THEN a.z ELSE (a.z * a.w + b.z * b.w) / (a.w + b.w) END AS z FROM a FULL JOIN b USING ({RC})", digits=3), "dem", "dem2",
        more=", ".join([_OUT("a", "dem", _LEFT), _INWARD("a", "dem", _LEFT), _OUT("b", "dem2", _RIGHT), _INWARD("b", "dem2", _RIGHT)]),
    ),
)
register("terrain_hypsometrically_tinted_hillshade", lambda s, d: tidy(op.hypsometrically_tinted_hillshade(raster(s, d, "dem"))), None)
_DEV = lambda t: f"CAST(floor(least(abs(z) * 1.2, 3.096) / 3.096 * 255) AS BIGINT)"
_SMALL = lambda s, d, t, k: raster(s, d, t).select("row", "col", (F.col("z") / k).alias("z"))
register(
    "terrain_multiscale_topographic_position_image",
    lambda s, d: tidy(op.multiscale_topographic_position_image(_SMALL(s, d, "dem2", 20.0), _SMALL(s, d, "unit", 0.4), _SMALL(s, d, "zones", 3.0))),
    with_inputs(tidy_sql(f"SELECT {RC}, CAST(255::BIGINT * 16777216 + l.v * 65536 + m.v * 256 + b.v AS DOUBLE) AS z FROM (SELECT {RC}, {_DEV('')} AS v FROM (SELECT {RC}, z / 20.0 AS z FROM dem2) x) l JOIN (SELECT {RC}, {_DEV('')} AS v FROM (SELECT {RC}, z / 0.4 AS z FROM unit) x) m USING ({RC}) JOIN (SELECT {RC}, {_DEV('')} AS v FROM (SELECT {RC}, z / 3.0 AS z FROM zones) x) b USING ({RC})"), "dem2", "unit", "zones"),
)

# lines: places of the neighbours in the list n are NE 3, E 6, SE 9, S 8, SW 7, W 4, NW 1, N 2
_N8 = [3, 6, 9, 8, 7, 4, 1, 2]
_SET = lambda i: f"coalesce(n[{_N8[i % 8]}], 0) > 0"
_CORNER = " OR ".join(f"({_SET(q + 1)} AND {_SET(q + 7)} AND NOT {_SET(q + 3)} AND NOT {_SET(q + 4)} AND NOT {_SET(q + 5)})" for q in range(0, 8, 2))
register("image_corner_detection", lambda s, d: tidy(lines.corner_detection(raster(s, d, "flags"))), with_inputs(tidy_sql(f"SELECT {RC}, CASE WHEN z > 0 AND ({_CORNER}) THEN 1.0 ELSE 0.0 END AS z FROM nb"), "flags", more=neighbours_sql("flags", 1)))
_AT = lambda i: f"coalesce(n[{i + 1}], 0)"
register(
    "image_thicken_raster_line",
    lambda s, d: tidy(lines.thicken_raster_line(raster(s, d, "flags"))),
    with_inputs(tidy_sql(f"SELECT {RC}, CASE WHEN z <= 0 AND {_AT(5)} > 0 AND {_AT(7)} > 0 AND {_AT(8)} <= 0 THEN {_AT(5)} WHEN z <= 0 AND {_AT(3)} > 0 AND {_AT(7)} > 0 AND {_AT(6)} <= 0 THEN {_AT(3)} ELSE z END AS z FROM nb WHERE z IS NOT NULL"), "flags", more=neighbours_sql("flags", 1)),
)
register("image_line_thinning", lambda s, d: tidy(lines.line_thinning(raster(s, d, "flags"), 16)), None)
register("image_remove_spurs", lambda s, d: tidy(lines.remove_spurs(lines.line_thinning(raster(s, d, "flags"), 16), 3, 16)), None)

# patches: the classes of zones
_P = f"pc AS (SELECT {RC}, CAST(round(z) AS BIGINT) AS patch FROM zones WHERE z IS NOT NULL AND round(z) <> 0)"
_CLUMPED = lambda s, d: hydro.clump(raster(s, d, "flags2"), zero_background=True)
register("gis_filter_raster_features_by_area", lambda s, d: tidy(patches.filter_by_area(raster(s, d, "zones"), 300)), with_inputs(tidy_sql(f"SELECT {RC}, CASE WHEN z <> 0 AND count(*) OVER (PARTITION BY z) < 300 THEN 0.0 ELSE z END AS z FROM zones"), "zones"))
_BLOCKS = _P + ", bl AS (SELECT patch, \"row\" + a AS r, \"col\" + b AS c, count(*) AS n, sum(CASE WHEN a = b THEN 1 ELSE 10 END) AS m FROM pc, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) k(a, b) GROUP BY 1, 2, 3), pm AS (SELECT patch, sum(CASE WHEN n = 4 THEN 0 WHEN n = 2 AND m = 11 THEN 1 WHEN n = 2 THEN sqrt(2) ELSE sqrt(2) / 2 END) AS v FROM bl GROUP BY 1)"
register("gis_raster_perimeter", lambda s, d: tidy(patches.raster_perimeter(raster(s, d, "zones")), digits=4), with_inputs(tidy_sql(f"SELECT {RC}, v AS z FROM pc JOIN pm USING (patch)", digits=4), "zones", more=_BLOCKS))
_RUNS = _P + ", rn AS (SELECT patch, \"row\" AS line, sum(new) AS runs FROM (SELECT *, CASE WHEN \"col\" - lag(\"col\") OVER (PARTITION BY patch, \"row\" ORDER BY \"col\") = 1 THEN 0 ELSE 1 END AS new FROM pc) x GROUP BY 1, 2 UNION ALL SELECT patch, \"col\", sum(new) FROM (SELECT *, CASE WHEN \"row\" - lag(\"row\") OVER (PARTITION BY patch, \"col\" ORDER BY \"row\") = 1 THEN 0 ELSE 1 END AS new FROM pc) x GROUP BY 1, 2)"
register("gis_shape_complexity_index_raster", lambda s, d: tidy(patches.shape_complexity_index(raster(s, d, "zones"))), with_inputs(tidy_sql(f"SELECT {RC}, v AS z FROM pc JOIN (SELECT patch, avg(runs) AS v FROM rn GROUP BY 1) q USING (patch)"), "zones", more=_RUNS))
_E = ", eg AS (SELECT p.patch, p.\"row\", p.\"col\", count(q.patch) < 9 AS edge FROM pc p LEFT JOIN pc q ON q.patch = p.patch AND abs(q.\"row\" - p.\"row\") <= 1 AND abs(q.\"col\" - p.\"col\") <= 1 GROUP BY 1, 2, 3), nw AS (SELECT patch, count(*) AS area, max((SELECT min(sqrt(power(e.\"row\" - g.\"row\", 2) + power(e.\"col\" - g.\"col\", 2))) FROM eg g WHERE g.edge)) + 1 AS d FROM eg e GROUP BY 1)"
register("gis_narrowness_index", lambda s, d: tidy(patches.narrowness_index(raster(s, d, "flags2"))), with_inputs(tidy_sql(f"SELECT {RC}, area / (pi() * d * d) AS z FROM pc JOIN nw USING (patch)"), "flags2", more=_P.replace("zones", "flags2") + _E))
register("gis_boundary_shape_complexity", lambda s, d: tidy(patches.boundary_shape_complexity(raster(s, d, "flags2"))), None)
register("data_raster_to_vector_polygons", lambda s, d: rounded(patches.polygons(raster(s, d, "zones")).groupBy("cls").agg(F.abs(F.sum("area")).alias("area"))), with_inputs(f"SELECT patch AS cls, {_r('count(*)', 'area')} FROM pc GROUP BY 1", "zones", more=_P))
