"""Stream networks on a grid: a pointer raster and the cells that are streams (z > 0)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.operators.hydro import _by_id, _sum, cell_id, forest
from geoloom.operators.vector import rasterize_lines
from geoloom.plans.graph import downstream, upstream
from geoloom.plans.lifting import jumps, paths
from geoloom.plans.lineage import written
from geoloom.plans.ranking import ranked
from geoloom.plans.stencil import neighbourhood, window_values

Raster = DataFrame


def network(pointer: Raster, streams: Raster) -> DataFrame:
    """id, next, step among stream cells, n_in (stream cells that flow in) and main: whether the
    cell is on the longest branch into its receiver (the least id on a tie)."""
    cells = streams.filter("z > 0").select(cell_id().alias("_c"))
    f = forest(pointer).join(cells, F.col("id") == F.col("_c"), "left_semi")
    on = cells.withColumnRenamed("_c", "_n")
    f = f.join(on, F.col("next") == F.col("_n"), "left").select("id", F.col("_n").alias("next"), F.when(F.col("_n").isNotNull(), F.col("step")).otherwise(0.0).alias("step"))
    f = written(f, "network")
    far = upstream(f.withColumn("far", F.lit(0.0)), [], {"far": "step"}).select(F.col("id").alias("_f"), "far")
    f = f.join(far, F.col("id") == F.col("_f")).drop("_f")
    into = f.filter("next IS NOT NULL").groupBy(F.col("next").alias("_t")).agg(F.count(F.lit(1)).alias("n_in"), F.min(F.struct(-(F.col("far") + F.col("step")), F.col("id"))).alias("best"))
    best = into.select(F.col("best.id").alias("_m"))
    f = f.join(into.select("_t", "n_in"), F.col("id") == F.col("_t"), "left").join(best, F.col("id") == F.col("_m"), "left")
    return written(f.select("id", "next", "step", "far", F.coalesce("n_in", F.lit(0)).alias("n_in"), F.col("_m").isNotNull().alias("main")), "network")


def stream_junctions(pointer: Raster, streams: Raster) -> Raster:
    """Number of inflowing stream cells."""
    return _by_id(network(pointer, streams), F.col("n_in"))


def distance_to_outlet(pointer: Raster, streams: Raster) -> Raster:
    return _by_id(downstream(network(pointer, streams), {"step": _sum}), F.col("step"))


def farthest_channel_head(pointer: Raster, streams: Raster) -> Raster:
    return _by_id(network(pointer, streams), F.col("far"))


def length_of_upstream_channels(pointer: Raster, streams: Raster) -> Raster:
    n = network(pointer, streams)
    own = n.select(F.col("id").alias("_i"), F.col("step").alias("own"))
    total = upstream(n.withColumnRenamed("step", "length"), ["length"])
    return _by_id(total.join(own, F.col("id") == F.col("_i")), F.col("length") - F.col("own"))


def shreve_magnitude(pointer: Raster, streams: Raster) -> Raster:
    """Channel heads upstream."""
    n = network(pointer, streams).withColumn("heads", (F.col("n_in") == 0).cast("long"))
    return _by_id(upstream(n, ["heads"]), F.col("heads"))


def links(n: DataFrame) -> DataFrame:
    """id and link: the cell where the link of a stream cell begins (a head or a confluence)."""
    feeder = n.filter("next IS NOT NULL").select(F.col("next").alias("_t"), F.col("id").alias("_u"))
    single = n.filter("n_in = 1").select("id").join(feeder, F.col("id") == F.col("_t")).select(F.col("id").alias("_s"), "_u")
    up = n.select("id").join(single, F.col("id") == F.col("_s"), "left").select("id", F.col("_u").alias("next"))
    return downstream(up, {}).select("id", F.col("last").alias("link"))


def _numbered(df: DataFrame, key: str) -> Raster:
    rank = ranked(df.select(F.col(key).alias("_k")).distinct(), [F.col("_k")])
    return _by_id(df.join(rank, F.col(key) == F.col("_k")), F.col("n"))


def stream_link_identifier(pointer: Raster, streams: Raster) -> Raster:
    """A number for each link, in the order of the cells where they begin."""
    return _numbered(links(network(pointer, streams)), "link")


def stream_link_class(pointer: Raster, streams: Raster) -> Raster:
    """1 exterior link, 2 interior link, 3 source, 4 confluence, 5 outlet."""
    n = network(pointer, streams)
    at = links(n).select(F.col("id").alias("_i"), F.col("link"))
    head = n.filter("n_in = 0").select(F.col("id").alias("_h"))
    j = n.join(at, F.col("id") == F.col("_i")).join(head, F.col("link") == F.col("_h"), "left")
    value = F.when(F.col("next").isNull(), 5).when(F.col("n_in") == 0, 3).when(F.col("n_in") > 1, 4).when(F.col("_h").isNotNull(), 1).otherwise(2)
    return _by_id(j, value)


def _per_link(pointer: Raster, streams: Raster, dem: Raster | None = None) -> DataFrame:
    n = network(pointer, streams)
    at = links(n).select(F.col("id").alias("_i"), F.col("link"))
    j = n.join(at, F.col("id") == F.col("_i")).drop("_i")
    return j if dem is None else j.join(dem.select(cell_id().alias("_d"), "z"), F.col("id") == F.col("_d")).drop("_d")


def stream_link_length(pointer: Raster, streams: Raster) -> Raster:
    """Length of each cell's link, up to the cell it flows into."""
    j = _per_link(pointer, streams)
    total = j.groupBy(F.col("link").alias("_l")).agg(F.sum("step").alias("length"))
    return _by_id(j.join(total, F.col("link") == F.col("_l")), F.col("length"))


def stream_link_slope(pointer: Raster, streams: Raster, dem: Raster) -> Raster:
    """Fall of each cell's link over its length, percent; 0 for links of no length."""
    j = _per_link(pointer, streams, dem)
    total = j.groupBy(F.col("link").alias("_l")).agg(F.sum("step").alias("length"), (F.max("z") - F.min("z")).alias("fall"))
    return _by_id(j.join(total, F.col("link") == F.col("_l")), F.when(F.col("length") > 0, F.col("fall") / F.col("length") * 100).otherwise(0.0))


def stream_slope_continuous(pointer: Raster, streams: Raster, dem: Raster) -> Raster:
    """Slope from a stream cell to the next, percent; 0 at outlets."""
    n = network(pointer, streams)
    z = dem.select(cell_id().alias("_d"), F.col("z").alias("own"))
    low = dem.select(cell_id().alias("_e"), F.col("z").alias("low"))
    j = n.join(z, F.col("id") == F.col("_d")).join(low, F.col("next") == F.col("_e"), "left")
    return _by_id(j, F.when(F.col("step") > 0, (F.col("own") - F.col("low")) / F.col("step") * 100).otherwise(0.0))


def strahler_order(pointer: Raster, streams: Raster) -> Raster:
    """Strahler order: on the network of links, round by round until nothing changes."""
    return _by_id(_strahler(network(pointer, streams)), F.col("order"))


def _strahler(n: DataFrame) -> DataFrame:
    at = written(links(n), "links")
    to = at.select(F.col("id").alias("_n"), F.col("link").alias("to"))
    ends = n.join(at.select(F.col("id").alias("_i"), "link"), F.col("id") == F.col("_i")).join(to, F.col("next") == F.col("_n"), "left").filter("to IS NULL OR to <> link")
    graph = written(ends.select("link", "to"), "graph")  # a row for each link
    state = written(graph.select("link", "to", F.lit(1).alias("order")), "orders")
    while True:
        top = state.filter("to IS NOT NULL").groupBy(F.col("to").alias("_t"), F.col("order").alias("o")).agg(F.count(F.lit(1)).alias("k"))
        top = top.groupBy("_t").agg(F.max(F.struct("o", "k")).alias("m")).select("_t", (F.col("m.o") + F.when(F.col("m.k") > 1, 1).otherwise(0)).alias("new"))
        now = written(state.join(top, F.col("link") == F.col("_t"), "left").select("link", "to", F.coalesce("new", F.lit(1)).alias("order"), (F.coalesce("new", F.lit(1)) != F.col("order")).alias("moved")), "orders")
        if not now.filter("moved").limit(1).count():
            order = now.select(F.col("link").alias("_l"), "order")
            return at.join(order, F.col("link") == F.col("_l")).select("id", "order")
        state = now.drop("moved")


def hack_order(pointer: Raster, streams: Raster) -> Raster:
    """1 on the main stem, one more on each tributary."""
    n = network(pointer, streams).withColumn("k", (F.col("next").isNotNull() & ~F.col("main")).cast("int"))
    return _by_id(downstream(n, {"k": _sum}), F.col("k") + 1)


def main_stem(pointer: Raster, streams: Raster) -> Raster:
    h = hack_order(pointer, streams)
    return h.select("row", "col", F.when(F.col("z") == 1, 1.0).alias("z"))


def _stems(n: DataFrame) -> DataFrame:
    """id and last: the lowest cell of the stem (main branches joined) a cell is on."""
    return downstream(n.select("id", F.when(F.col("main"), F.col("next")).alias("next")), {})


def tributary_identifier(pointer: Raster, streams: Raster) -> Raster:
    """A number for each tributary, in the order of their lowest cells."""
    return _numbered(_stems(network(pointer, streams)), "last")


def horton_order(pointer: Raster, streams: Raster) -> Raster:
    """Strahler order of the lowest cell of a cell's stem, all along it."""
    n = network(pointer, streams)
    s = _strahler(n).select(F.col("id").alias("_s"), "order")
    return _by_id(_stems(n).join(s, F.col("last") == F.col("_s")), F.col("order"))


def topological_order(pointer: Raster, streams: Raster) -> Raster:
    """1 on the link at the outlet, one more beyond each confluence."""
    n = network(pointer, streams)
    into = n.filter("n_in > 1").select(F.col("id").alias("_c"))
    k = n.join(into, F.col("next") == F.col("_c"), "left").withColumn("k", F.col("_c").isNotNull().cast("int"))
    return _by_id(downstream(k, {"k": _sum}), F.col("k") + 1)


def remove_short_streams(pointer: Raster, streams: Raster, min_length: float) -> Raster:
    """Streams without the exterior links shorter than ``min_length``."""
    j = _per_link(pointer, streams)
    total = j.groupBy(F.col("link").alias("_l")).agg(F.sum("step").alias("length"), F.min(F.when(F.col("id") == F.col("link"), F.col("n_in"))).alias("at_head"), F.max(F.col("next").isNull().cast("int")).alias("ends"))
    keep = j.join(total, F.col("link") == F.col("_l")).filter(~((F.col("at_head") == 0) & (F.col("length") < min_length) & (F.col("ends") == 0)))
    return _by_id(keep, F.lit(1.0))


def hillslopes_to_links(pointer: Raster, streams: Raster) -> Raster:
    """Sub-basins: every cell gets the number of the first link downstream."""
    from geoloom.operators.hydro import watershed

    return watershed(pointer, stream_link_identifier(pointer, streams))


def strahler_order_basins(pointer: Raster, streams: Raster) -> Raster:
    from geoloom.operators.hydro import watershed

    return watershed(pointer, strahler_order(pointer, streams))


def long_profile(pointer: Raster, streams: Raster, dem: Raster) -> DataFrame:
    """row, col, distance to the outlet and elevation of every stream cell."""
    d = distance_to_outlet(pointer, streams).withColumnRenamed("z", "distance")
    return d.join(dem.withColumnRenamed("z", "elevation"), ["row", "col"])


def extract_streams(accumulation: Raster, threshold: float, zero_background: bool = False) -> Raster:
    """1 where the accumulation is over ``threshold``; elsewhere NoData, or 0 where there is data."""
    rest = F.when(F.col("z").isNotNull(), 0.0) if zero_background else F.lit(None)
    return accumulation.select("row", "col", F.when(F.col("z") > threshold, 1.0).otherwise(rest).alias("z"))


def prune_strahler_order(orders: Raster, lowest: int) -> Raster:
    """Streams without those of an order below ``lowest``; the others count from 1 again."""
    return orders.select("row", "col", F.when(F.col("z") >= lowest, F.col("z") - (lowest - 1)).alias("z"))


def extract_valleys(dem: Raster, variant: str = "lower quartile", size: int = 5) -> Raster:
    """1 at valley cells, else 0.

    lower quartile: at or below the lower quartile of a window of ``size``; johnston rosenfeld: lower than
    both side neighbours on one axis.
    """
    if variant == "lower quartile":
        w = window_values(dem, size // 2, size // 2)
        low = F.array_sort("v")
        return w.select("row", "col", F.when(F.col("z").isNotNull(), (F.col("z") <= F.get(low, F.floor((F.size("v") - 1) * 0.25).cast("int"))).cast("double")).alias("z"))
    n = neighbourhood(dem)
    at = lambda i: F.get("n", F.lit(i))
    low = ((at(1) > F.col("z")) & (at(7) > F.col("z"))) | ((at(3) > F.col("z")) & (at(5) > F.col("z")))
    return n.select("row", "col", F.when(F.col("z").isNotNull(), F.coalesce(low, F.lit(False)).cast("double")).alias("z"))


def long_profile_from_points(pointer: Raster, dem: Raster, points: DataFrame) -> DataFrame:
    """fid, distance, elevation along the flow path of each point (fid, row, col)."""
    starts = points.select(F.col("fid").alias("key"), cell_id().alias("at"))
    z = dem.select(cell_id().alias("_z"), F.col("z").alias("elevation"))
    walked = paths(jumps(forest(pointer)), starts)
    return walked.join(z, F.col("id") == F.col("_z")).select(F.col("key").alias("fid"), F.col("len").alias("distance"), "elevation")


def streams_to_vector(pointer: Raster, streams: Raster) -> DataFrame:
    """fid, parts: a line for each link, from its first cell to the first cell of the next link (cell centres)."""
    n = network(pointer, streams)
    at = links(n).select(F.col("id").alias("_i"), "link")
    far = downstream(n, {"step": _sum}).select(F.col("id").alias("_d"), F.col("step").alias("left"))
    cells = n.join(at, F.col("id") == F.col("_i")).join(far, F.col("id") == F.col("_d")).select("id", "next", "link", "left")
    # the receiver of the link's last cell ends its line
    into = at.select(F.col("_i").alias("_n"), F.col("link").alias("_l"))
    tails = cells.join(into, F.col("next") == F.col("_n")).filter("_l <> link").join(far.select(F.col("_d").alias("_e"), F.col("left").alias("_left")), F.col("next") == F.col("_e"))
    points = cells.select("id", "link", "left").union(tails.select("next", "link", "_left"))
    centre = F.struct((F.col("id").bitwiseAND(F.lit((1 << 32) - 1)) + 0.5).alias("x"), (F.shiftright("id", 32) + 0.5).alias("y"))
    line = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("left")).alias("o"), centre.alias("p")))), lambda s: s["p"])
    return points.groupBy(F.col("link").alias("fid")).agg(line.alias("line")).filter("size(line) > 1").select("fid", F.array("line").alias("parts"))


def rasterize_streams(lines: DataFrame, base: Raster, feature_id: bool = False) -> Raster:
    """Cells that the lines touch: 1 or the line's fid (the last one); 0 elsewhere."""
    hit = rasterize_lines(lines, base).withColumnRenamed("z", "f")
    value = F.when(F.col("f").isNull(), 0.0).otherwise(F.col("f") if feature_id else F.lit(1.0))
    return base.select("row", "col").join(hit, ["row", "col"], "left").select("row", "col", value.alias("z"))
