"""Map algebra: functions of a cell, of two rasters, and of stacks of rasters.

Rasters are DataFrames (row, col, z); NULL is NoData. One raster needs no shuffle;
two meet in an equi-join on (row, col), stacks in one aggregation.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom.functions.cells import BINARY, UNARY

Raster = DataFrame


def unary(raster: Raster, name: str) -> Raster:
    """A function of :data:`geoloom.functions.cells.UNARY` on every cell."""
    return raster.select("row", "col", F.expr(UNARY[name]).alias("z"))


def pair(a: Raster, b: Raster | float) -> DataFrame:
    """row, col, a, b; ``b`` may be a number."""
    left = a.select("row", "col", F.col("z").alias("a"))
    if not isinstance(b, DataFrame):
        return left.withColumn("b", F.lit(float(b)))
    return left.join(b.select("row", "col", F.col("z").alias("b")), ["row", "col"])


def binary(a: Raster, b: Raster | float, name: str) -> Raster:
    """A function of :data:`geoloom.functions.cells.BINARY` on every pair of cells."""
    return pair(a, b).select("row", "col", F.expr(BINARY[name]).alias("z"))


def truncate(raster: Raster, decimals: int = 0) -> Raster:
    f = float(10**decimals)
    return raster.select("row", "col", (F.signum("z") * F.floor(F.abs(F.col("z")) * f) / f).alias("z"))


def set_nodata_value(raster: Raster, back: float = 0.0) -> Raster:
    return raster.select("row", "col", F.when(F.col("z") != back, F.col("z")).alias("z"))


def rescale_value_range(raster: Raster, out_min: float, out_max: float, clip_min: float, clip_max: float) -> Raster:
    part = (F.least(F.greatest(F.col("z"), F.lit(clip_min)), F.lit(clip_max)) - clip_min) / (clip_max - clip_min)
    return raster.select("row", "col", F.when(F.col("z").isNotNull(), out_min + part * (out_max - out_min)).alias("z"))


def reclass(raster: Raster, ranges: Sequence[tuple[float, float, float]]) -> Raster:
    """(new, from, to) with from <= z < to; the first range wins, unmatched values stay."""
    out = F.when(F.lit(False), F.lit(0.0))
    for new, low, high in ranges:
        out = out.when((F.col("z") >= low) & (F.col("z") < high), F.lit(float(new)))
    return raster.select("row", "col", out.otherwise(F.col("z")).alias("z"))


def reclass_assign(raster: Raster, pairs: Sequence[tuple[float, float]]) -> Raster:
    """(new, old): values that equal old to four decimals are replaced."""
    out = F.when(F.lit(False), F.lit(0.0))
    for new, old in pairs:
        out = out.when(F.round(F.col("z") * 10000) == round(old * 10000), F.lit(float(new)))
    return raster.select("row", "col", out.otherwise(F.col("z")).alias("z"))


def reclass_from_table(raster: Raster, ranges: DataFrame) -> Raster:
    """Ranges as a table (new, low, high) that fits the driver, all read there: the first range wins, unmatched values stay.

    The ranges are cut at all their ends into pieces that do not overlap, sorted, and a cell finds its piece by search.
    """
    kept = ranges.select(*[F.col(c).cast("double") for c in ("new", "low", "high")]).toArrow().drop_null()
    new, low, high = (kept.column(c).to_numpy() for c in ("new", "low", "high"))
    edges = np.unique(np.concatenate([low, high]))
    value, matched = np.zeros(len(edges)), np.zeros(len(edges), bool)
    for v, a, b in zip(new[::-1], np.searchsorted(edges, low)[::-1], np.searchsorted(edges, high)[::-1], strict=True):
        value[a:b], matched[a:b] = v, True
    shared = raster.sparkSession.sparkContext.broadcast((edges, value, matched))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges, value, matched = shared.value
        for batch in batches:
            z = batch.column("z")
            x = z.to_numpy(zero_copy_only=False).astype(np.float64)
            at = np.searchsorted(edges, x, "right") - 1
            hit = (at >= 0) & ~np.isnan(x)
            hit[hit] = matched[at[hit]]
            out = x.copy()
            out[hit] = value[at[hit]]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("col"), pa.array(out, mask=z.is_null().to_numpy(zero_copy_only=False))], ["row", "col", "z"])

    cells = raster.select("row", "col", F.col("z").cast("double").alias("z"))
    return cells.mapInArrow(run, cells.schema)


def reclass_equal_interval(raster: Raster, interval: float = 10.0, start: float | None = None, end: float | None = None) -> Raster:
    z = F.col("z")
    inside = F.lit(True) if start is None else z >= start
    inside = inside if end is None else inside & (z <= end)
    return raster.select("row", "col", F.when(inside, F.floor(z / interval) * interval).otherwise(z).alias("z"))


def conditional(raster: Raster, condition: str, true: str, false: str) -> Raster:
    """If-then-else with SQL text over value, row and col; NoData stays unless the condition asks for it."""
    named = raster.withColumn("value", F.col("z"))
    out = F.when(F.expr(condition), F.expr(true)).otherwise(F.expr(false)).cast("double")
    return named.select("row", "col", (out if "null" in condition.lower() else F.when(F.col("z").isNotNull(), out)).alias("z"))


# stacks


def stack(rasters: Sequence[Raster]) -> DataFrame:
    """row, col, band (from 0), z of all rasters: one union, no n-way join."""
    return reduce(DataFrame.unionByName, [r.select("row", "col", F.lit(i).alias("band"), "z") for i, r in enumerate(rasters)])


def _by_cell(bands: DataFrame, value: Column) -> Raster:
    return bands.groupBy("row", "col").agg(value.alias("z"))


def overlay(bands: DataFrame, kind: str) -> Raster:
    """sum, mean, max, min, product, max_absolute or min_absolute of a stack (row, col, band, z); NULLs are passed over."""
    z = F.col("z")
    how = {"sum": F.sum, "mean": F.avg, "max": F.max, "min": F.min, "product": F.product}
    if kind in how:
        return _by_cell(bands, how[kind](z))
    return _by_cell(bands, {"max_absolute": F.max, "min_absolute": F.min}[kind](F.abs(z)))


def position(bands: DataFrame, highest: bool) -> Raster:
    """The band (from 0) that holds the largest or least value; the first on a tie."""
    key = F.struct(F.col("z") if not highest else -F.col("z"), F.col("band"))
    return _by_cell(bands.filter("z IS NOT NULL"), F.min(key)["band"].cast("double"))


def count_if(bands: DataFrame, value: float) -> Raster:
    """How many bands equal ``value``; cells without any stay NoData."""
    return _by_cell(bands, F.nullif(F.count_if(F.col("z") == value), F.lit(0)).cast("double"))


def percent(bands: DataFrame, comparison: Raster, op: str) -> Raster:
    """Percentage of valid bands that are ``=``, ``>`` or ``<`` the comparison raster; 0 without valid bands."""
    c = comparison.select("row", "col", F.col("z").alias("c"))
    hit = F.expr(f"z {op} c")
    n = F.count("z")
    share = F.when(n > 0, 100.0 * F.count_if(hit & F.col("z").isNotNull()) / n).otherwise(0.0)
    return _by_cell(bands.join(c, ["row", "col"]), F.when(F.max("c").isNotNull(), share))


def pick_from_list(bands: DataFrame, positions: Raster) -> Raster:
    """The value of the band (from 0) that the position raster names."""
    p = positions.select("row", "col", F.col("z").cast("int").alias("band"))
    return bands.join(p, ["row", "col", "band"]).select("row", "col", "z")


def weighted_sum(bands: DataFrame, weights: Sequence[float]) -> Raster:
    """Σ z·w with the weights scaled to sum to 1; NoData if any band has none."""
    total = float(sum(weights))
    w = F.lit([x / total for x in weights])[F.col("band")]
    return _by_cell(bands, F.when(F.count("z") == len(weights), F.sum(F.col("z") * w)))


def weighted_overlay(factors: DataFrame, weights: Sequence[float], costs: Sequence[bool], constraints: Sequence[Raster] = (), scale_max: float = 1.0) -> Raster:
    """Multi-criteria evaluation: factors scaled to 0..1 (costs reversed), weighted, times the constraints."""
    span = factors.groupBy("band").agg(F.min("z").alias("lo"), F.max("z").alias("hi"))  # a row for each factor
    f = factors.join(F.broadcast(span), "band")
    part = (F.col("z") - F.col("lo")) / (F.col("hi") - F.col("lo"))
    flip = F.lit(list(costs))[F.col("band")]
    scaled = f.withColumn("z", F.when(flip, 1 - part).otherwise(part) * scale_max)
    out = weighted_sum(scaled, weights)
    for c in constraints:
        out = binary(out, c, "multiply")
    return out


def extract_values_at_points(bands: DataFrame, points: DataFrame) -> DataFrame:
    """fid and one value column for each band, at the points' cells (points: fid, row, col)."""
    hit = points.select("fid", "row", "col").join(bands, ["row", "col"], "left")
    n = [r[0] for r in bands.select("band").distinct().orderBy("band").collect()]  # the bands
    return hit.groupBy("fid").agg(*[F.max(F.when(F.col("band") == b, F.col("z"))).alias(f"value{b}") for b in n])


def aggregate_raster(raster: Raster, factor: int = 2, kind: str = "mean") -> Raster:
    """A raster ``factor`` times as coarse: mean, sum, maximum, minimum or range of each block."""
    z = F.col("z")
    value = {"mean": F.avg(z), "sum": F.sum(z), "maximum": F.max(z), "minimum": F.min(z), "range": F.max(z) - F.min(z)}[kind]
    block = [F.floor(F.col(c) / factor).cast("int").alias(c) for c in ("row", "col")]
    return raster.groupBy(*block).agg(value.alias("z"))


def flip_image(raster: Raster, direction: str = "vertical") -> Raster:
    """Mirror image: vertical (top to bottom), horizontal or both."""
    size = raster.agg((F.min("row") + F.max("row")).alias("_r"), (F.min("col") + F.max("col")).alias("_c"))
    r = F.col("_r") - F.col("row") if direction in ("vertical", "both") else F.col("row")
    c = F.col("_c") - F.col("col") if direction in ("horizontal", "both") else F.col("col")
    return raster.crossJoin(F.broadcast(size)).select(r.alias("row"), c.alias("col"), "z")


def new_raster(base: Raster, value: float | None = None) -> Raster:
    return base.select("row", "col", F.lit(value).cast("double").alias("z"))


def create_plane(base: Raster, gradient: float = 15.0, aspect: float = 90.0, constant: float = 0.0, resolution: float = 1.0) -> Raster:
    """z of a plane that slopes ``gradient`` degrees towards ``aspect``."""
    rise, toward = F.tan(F.radians(F.lit(gradient))), F.radians(F.lit((aspect - 180.0) % 360.0))
    x, y = F.col("col") * resolution, -F.col("row") * resolution
    return base.select("row", "col", (rise * F.sin(toward) * x + rise * F.cos(toward) * y + constant).alias("z"))


def cell_assignment(base: Raster, what: str = "column", resolution: float = 1.0) -> Raster:
    """Row, column, x or y of every cell."""
    value = {"row": F.col("row"), "column": F.col("col"), "x": (F.col("col") + 0.5) * resolution, "y": -(F.col("row") + 0.5) * resolution}[what]
    return base.select("row", "col", value.cast("double").alias("z"))


def clip_to_raster(raster: Raster, mask: Raster) -> Raster:
    return raster.join(mask.filter("z IS NOT NULL AND z <> 0"), ["row", "col"], "left_semi")


# colours: red, green and blue in one number, red lowest


def compose(red: Raster, green: Raster, blue: Raster) -> Raster:
    """A colour composite of three 0..255 bands, opaque."""
    names = {"a": red, "b": green, "c": blue}
    j = reduce(lambda x, y: x.join(y, ["row", "col"]), [r.select("row", "col", F.col("z").cast("long").alias(k)) for k, r in names.items()])
    return j.select("row", "col", (F.lit(255).cast("long") * (1 << 24) + F.col("c") * (1 << 16) + F.col("b") * (1 << 8) + F.col("a")).cast("double").alias("z"))


def split(composite: Raster, band: str) -> Raster:
    """The red, green or blue band of a composite."""
    shift = {"red": 0, "green": 8, "blue": 16}[band]
    return composite.select("row", "col", F.shiftright(F.col("z").cast("long"), shift).bitwiseAND(F.lit(255)).cast("double").alias("z"))


def rgb_to_ihs(rgb: DataFrame) -> DataFrame:
    """i, h (radians), s of r, g, b (0..255)."""
    r, g, b = (F.col(c) / 255.0 for c in "rgb")
    i = r + g + b
    low = F.least(r, g, b)
    grey = (r == g) & (g == b)
    h = F.when(grey, 0.0).when(low == b, (g - b) / (i - 3 * b)).when(low == r, (b - r) / (i - 3 * r) + 1).otherwise((r - g) / (i - 3 * g) + 2)
    s = F.when(grey, 0.0).otherwise(1 - 3 * low / i)
    return rgb.select("row", "col", (i / 3).alias("i"), (h * F.lit(2 * 3.141592653589793 / 3)).alias("h"), s.alias("s"))


def ihs_to_rgb(ihs: DataFrame) -> DataFrame:
    """The reverse of :func:`rgb_to_ihs`."""
    i, s = F.col("i") * 3, F.col("s")
    h = F.col("h") / F.lit(2 * 3.141592653589793 / 3)
    sector = F.floor(h)
    f = h - sector
    low = i * (1 - s) / 3
    up = f * (i - 3 * low) + low
    rest = i - low - up
    pick = lambda order: F.when(sector == 0, order[0]).when(sector == 1, order[1]).otherwise(order[2])
    r, g, b = pick([rest, low, up]), pick([up, rest, low]), pick([low, up, rest])
    return ihs.select("row", "col", *[F.round(x * 255, 6).alias(k) for k, x in (("r", r), ("g", g), ("b", b))])
