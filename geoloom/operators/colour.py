"""Enhancement and merging of images and colour composites.

Bands are rasters; a composite holds red, green and blue of a cell in one number
(:func:`geoloom.operators.local.compose`). Statistics that an enhancement needs are one
row of aggregates or a table of tones, joined to the cells.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoloom.functions.cells import quotient
from geoloom.operators.local import compose, ihs_to_rgb, rgb_to_ihs, split
from geoloom.operators.stats import _with_cdf

Raster = DataFrame
BANDS = ("red", "green", "blue")


def _bands(composite: Raster) -> DataFrame:
    """row, col, r, g, b of a composite."""
    z = F.col("z").cast("long")
    return composite.select("row", "col", *[F.shiftright(z, k).bitwiseAND(F.lit(255)).cast("double").alias(c) for k, c in ((0, "r"), (8, "g"), (16, "b"))])


def _packed(rgb: DataFrame) -> Raster:
    """A composite of r, g, b (0..255); NoData where one is."""
    r, g, b = (F.col(c).cast("long") for c in "rgb")
    return rgb.select("row", "col", (F.lit(255).cast("long") * (1 << 24) + b * (1 << 16) + g * (1 << 8) + r).cast("double").alias("z"))


def _clamped(value: Column, high: float = 255.0) -> Column:
    return F.when(value.isNotNull(), F.least(F.greatest(value, F.lit(0.0)), F.lit(high)))


def balance_contrast_enhancement(band: Raster, mean: float = 100.0) -> Raster:
    """A parabola that takes the band's least value to 0, its largest to 255 and its mean to ``mean``; NaN where the band does not vary."""
    z = F.col("z")
    s = band.agg(F.min(z).alias("l"), F.max(z).alias("h"), F.avg(z).alias("e"), F.avg(z * z).alias("s"))
    b = quotient(F.expr(f"h * h * {mean} - s * 255.0 + l * l * (255.0 - {mean})"), F.expr(f"2 * (h * {mean} - e * 255.0 + l * (255.0 - {mean}))"))
    s = s.withColumn("b", b).withColumn("a", quotient(F.lit(255.0), F.expr("(h - l) * (h + l - 2 * b)"))).withColumn("c", F.expr("-a * (l - b) * (l - b)"))
    return band.crossJoin(F.broadcast(s)).select("row", "col", F.expr("a * (z - b) * (z - b) + c").alias("z"))


def balance_contrast_enhancement_composite(composite: Raster, mean: float = 100.0) -> Raster:
    """:func:`balance_contrast_enhancement` of each band of a composite."""
    bands = [balance_contrast_enhancement(split(composite, b), mean) for b in BANDS]
    return compose(*[b.select("row", "col", _clamped(F.floor("z")).alias("z")) for b in bands])


def direct_decorrelation_stretch(composite: Raster, k: float = 0.5, clip: float = 0.01) -> Raster:
    """Each band less ``k`` times the least of the three, then stretched between its tones at ``clip`` and 1 - ``clip``.

    The tones are counted first, 256 at most for each band.
    """
    low = F.least("r", "g", "b")
    rgb = _bands(composite).filter("r IS NOT NULL").select("row", "col", *[F.floor(F.col(c) - k * low).cast("double").alias(c) for c in "rgb"])
    long = rgb.select(F.explode(F.array(*[F.struct(F.lit(c).alias("band"), F.col(c).alias("v")) for c in "rgb"])).alias("x")).select("x.*")
    tones = long.groupBy("band", "v").agg(F.count(F.lit(1)).alias("n"))
    up, every = Window.partitionBy("band").orderBy("v"), Window.partitionBy("band")
    share = tones.withColumn("cdf", F.sum("n").over(up) / F.sum("n").over(every))
    ends = share.groupBy("band").agg(F.min(F.when(F.col("cdf") > clip, F.col("v"))).alias("lo"), F.min(F.when(F.col("cdf") >= 1 - clip, F.col("v"))).alias("hi"))
    ends = ends.groupBy().pivot("band", list("rgb")).agg(F.first("lo").alias("lo"), F.first("hi").alias("hi"))  # one row
    stretch = lambda c: _clamped(F.floor((F.col(c) - F.col(f"{c}_lo")) / F.nullif(F.col(f"{c}_hi") - F.col(f"{c}_lo"), F.lit(0.0)) * 255))
    return _packed(rgb.crossJoin(F.broadcast(ends)).select("row", "col", *[F.coalesce(stretch(c), F.col(c)).alias(c) for c in "rgb"]))


def match_distribution(raster: Raster, reference: DataFrame, bins: int = 2048) -> Raster:
    """Values of ``reference`` (value, cdf: rising) at each cell's place in the distribution of ``raster``.

    A cell takes the first reference value whose share is at least its own. The
    reference is a table of tones; it is joined by the few distinct shares of the bins, not by cells.
    """
    cells = _with_cdf(raster, bins)
    shares = cells.select("cdf").distinct()  # ``bins`` rows at most
    pool = shares.select("cdf", F.lit(1).alias("own"), F.lit(None).cast("double").alias("value")).union(reference.select("cdf", F.lit(0).alias("own"), F.col("value").cast("double")))
    # the next reference share at or above: reference rows sort before own ones when reading down from the top
    down = Window.orderBy(F.desc("cdf"), "own").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    top = reference.agg(F.max("value").cast("double").alias("top"))
    # equal shares in the reference: the least value stands for them
    found = pool.groupBy("cdf", "own").agg(F.min("value").alias("value")).withColumn("found", F.last("value", ignorenulls=True).over(down)).filter("own = 1")
    table = found.crossJoin(top).select(F.col("cdf").alias("_c"), F.coalesce("found", "top").alias("z"))
    return cells.select("row", "col", "cdf").join(F.broadcast(table), F.col("cdf") == F.col("_c")).select("row", "col", "z")


def histogram_matching(raster: Raster, pdf: DataFrame, bins: int = 2048) -> Raster:
    """Gives ``raster`` the distribution of a table (value, frequency)."""
    up, every = Window.orderBy("value"), Window.partitionBy()
    return match_distribution(raster, pdf.select("value", (F.sum("frequency").over(up) / F.sum("frequency").over(every)).alias("cdf")), bins)


def gaussian_contrast_stretch(raster: Raster, tones: int = 256, bins: int = 2048) -> Raster:
    """Tones 0..``tones`` - 1 with a normal distribution over -3 to 3 deviations."""
    x = -3.0 + F.col("id") * (6.0 / (tones - 1))
    pdf = raster.sparkSession.range(tones).select(F.col("id").cast("double").alias("value"), F.exp(-x * x / 2).alias("frequency"))
    return histogram_matching(raster, pdf, bins)


def write_function_memory_insertion(dates: Sequence[Raster]) -> Raster:
    """Two or three dates of a band as red, green and blue, each stretched to 0..255; of two dates the second is green and blue.

    A date that does not vary is 0 throughout.
    """

    def tone(r: Raster) -> Raster:
        s = r.agg(F.min("z").alias("lo"), F.max("z").alias("hi"))
        part = F.when(F.col("hi") > F.col("lo"), (F.col("z") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(F.col("z") * 0)
        return r.crossJoin(F.broadcast(s)).select("row", "col", F.floor(part * 255).cast("double").alias("z"))

    bands = [tone(r) for r in dates]
    return compose(bands[0], bands[1], bands[-1])


def panchromatic_sharpening(red: Raster, green: Raster, blue: Raster, pan: Raster, factor: int, method: str = "brovey") -> Raster:
    """A composite on the cells of ``pan`` (0..255), ``factor`` times as fine as the bands (0..255).

    brovey: each band by pan over the bands' mean; ihs: pan replaces the intensity.
    """
    names = {"r": red, "g": green, "b": blue}
    coarse = reduce(lambda a, b: a.join(b, ["_r", "_c"]), [x.select(F.col("row").alias("_r"), F.col("col").alias("_c"), F.col("z").alias(c)) for c, x in names.items()])
    fine = pan.select("row", "col", F.col("z").alias("pan"), F.floor(F.col("row") / factor).cast("int").alias("_r"), F.floor(F.col("col") / factor).cast("int").alias("_c"))
    j = fine.join(coarse, ["_r", "_c"]).drop("_r", "_c")
    if method == "brovey":
        mean = (F.col("r") + F.col("g") + F.col("b")) / 3
        out = j.select("row", "col", *[_clamped(F.when(mean > 0, F.floor(F.col(c) / mean * F.col("pan"))).otherwise(mean * 0)).alias(c) for c in "rgb"])
    else:
        ihs = rgb_to_ihs(j)
        swapped = ihs.join(pan.select("row", "col", (F.col("z") / 255.0).alias("i2")), ["row", "col"]).select("row", "col", F.col("i2").alias("i"), "h", "s")
        out = ihs_to_rgb(swapped).select("row", "col", *[_clamped(F.floor(c)).alias(c) for c in "rgb"])
    return _packed(out)


def mosaic_with_feathering(first: Raster, second: Raster, weight: float = 4.0) -> Raster:
    """Both images; where they overlap, their mean weighted by each one's distance to its own edge to the power ``weight``."""
    from geoloom.operators.distance import euclidean_distance
    from geoloom.plans.stencil import dense

    def inward(r: Raster) -> DataFrame:
        box = dense(r)
        padded = box.select("row", "col", F.when(F.col("z").isNull(), 1.0).otherwise(0.0).alias("z"))
        e = r.agg((F.min("row") - 1).alias("r0"), (F.max("row") + 1).alias("r1"), (F.min("col") - 1).alias("c0"), (F.max("col") + 1).alias("c1"))
        rim = e.select(F.explode(F.sequence("r0", "r1")).alias("row"), "r0", "r1", F.explode(F.array("c0", "c1")).alias("col")).select("row", "col")
        rim = rim.union(e.select(F.explode(F.array("r0", "r1")).alias("row"), F.col("c0"), F.col("c1")).select("row", F.explode(F.sequence("c0", "c1")).alias("col"))).distinct()
        away = euclidean_distance(padded.union(rim.select("row", "col", F.lit(1.0).alias("z"))))
        return r.join(away.withColumnRenamed("z", "d"), ["row", "col"]).filter("z IS NOT NULL")

    a = inward(first).select("row", "col", F.col("z").alias("za"), F.pow("d", F.lit(weight)).alias("wa"))
    b = inward(second).select("row", "col", F.col("z").alias("zb"), F.pow("d", F.lit(weight)).alias("wb"))
    mixed = (F.col("za") * F.col("wa") + F.col("zb") * F.col("wb")) / (F.col("wa") + F.col("wb"))
    return a.join(b, ["row", "col"], "full").select("row", "col", F.coalesce(mixed, "za", "zb").alias("z"))


#: Colours of a palette from low to high, as (red, green, blue).
PALETTES = {
    "grey": [(0, 0, 0), (255, 255, 255)],
    "relief": [(0, 97, 71), (232, 214, 125), (130, 30, 30), (161, 161, 161), (255, 255, 255)],
}


def tinted(values: Raster, palette: str | Sequence[tuple[int, int, int]] = "relief") -> DataFrame:
    """row, col, r, g, b: each cell's colour between the least and the largest value."""
    colours = PALETTES[palette] if isinstance(palette, str) else list(palette)
    s = values.agg(F.min("z").alias("lo"), F.max("z").alias("hi"))
    part = F.when(F.col("hi") > F.col("lo"), (F.col("z") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(F.col("z") * 0) * (len(colours) - 1)
    t = values.filter("z IS NOT NULL").crossJoin(F.broadcast(s)).withColumn("t", part).withColumn("k", F.least(F.floor("t"), F.lit(len(colours) - 2)).cast("int"))

    def channel(i: int) -> Column:
        steps = F.lit([float(c[i]) for c in colours])
        low, high = F.get(steps, F.col("k")), F.get(steps, F.col("k") + 1)
        return low + (high - low) * (F.col("t") - F.col("k"))

    return t.select("row", "col", *[channel(i).alias(c) for i, c in enumerate("rgb")])


def hypsometrically_tinted_hillshade(dem: Raster, altitude: float = 45.0, weight: float = 0.5, brightness: float = 0.5, palette: str = "relief") -> Raster:
    """Colours of elevation, ``weight`` of them shaded by light from several azimuths; a composite."""
    from geoloom.operators.terrain import multidirectional_hillshade

    shade = multidirectional_hillshade(dem, altitude).select("row", "col", (F.col("z") / 32767.0).alias("s"))
    j = tinted(dem, palette).join(shade, ["row", "col"])
    lit = (weight * F.col("s") + (1 - weight)) * (0.5 + brightness)
    return _packed(j.select("row", "col", *[_clamped(F.floor(F.col(c) * lit)).alias(c) for c in "rgb"]))


def multiscale_topographic_position_image(local: Raster, meso: Raster, broad: Raster, lightness: float = 1.2, hillshade: Raster | None = None) -> Raster:
    """A composite of |deviation| at three scales: broad red, meso green, local blue; 2.58 and more is full tone."""

    def tone(r: Raster) -> Raster:
        cut = 2.58 * lightness
        part = F.least(F.abs("z") * lightness, F.lit(cut)) / cut
        return r.select("row", "col", F.when(F.col("z").isNotNull(), F.floor(part * 255)).cast("double").alias("z"))

    bands = [tone(r) for r in (broad, meso, local)]
    if hillshade is not None:
        top = hillshade.agg(F.max("z").alias("top"))
        light = hillshade.crossJoin(F.broadcast(top)).select("row", "col", (F.col("z") / F.col("top")).alias("s"))
        bands = [b.join(light, ["row", "col"]).select("row", "col", F.floor(F.col("z") * F.col("s")).cast("double").alias("z")) for b in bands]
    return compose(*bands)
