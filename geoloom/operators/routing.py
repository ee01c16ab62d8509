"""What the flow paths of a pointer raster tell about basins, hillslopes and outlets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.functions.grids import AROUND
from geoloom.operators.hydro import _by_id, _spread, _sum, cell_id, d8_pointer, fd8_edges, fill_depressions, forest, watershed
from geoloom.operators.streams import links, network
from geoloom.plans.flow import settle
from geoloom.plans.graph import downstream, upstream
from geoloom.plans.lifting import first_below, jumps, meetings, paths
from geoloom.plans.lineage import written
from geoloom.plans.ranking import ranked
from geoloom.plans.stencil import neighbourhood

Raster = DataFrame


def _from_heads(dem: Raster) -> DataFrame:
    """id, n (divide cells upstream or the cell itself if it is one), length and drop: totals over their paths to the cell."""
    f = written(forest(d8_pointer(dem)), "forest")
    z = dem.select(cell_id().alias("_z"), F.col("z").alias("own"))
    far = downstream(f, {"step": _sum}).select(F.col("id").alias("_d"), F.col("step").alias("left"))
    fed = f.filter("next IS NOT NULL").select(F.col("next").alias("_n")).distinct()
    v = f.select("id", "next").join(z, F.col("id") == F.col("_z")).join(far, F.col("id") == F.col("_d")).join(fed, F.col("id") == F.col("_n"), "left")
    head = F.col("_n").isNull()
    v = written(v.select("id", "next", "own", "left", *[F.when(head, x).otherwise(0.0).alias(k) for k, x in (("n", F.lit(1.0)), ("lefts", F.col("left")), ("owns", F.col("own")))]), "heads")
    up = upstream(v.select("id", "next", "n", "lefts", "owns"), ["n", "lefts", "owns"])
    j = v.select(F.col("id").alias("_i"), "own", "left").join(up, F.col("_i") == F.col("id"))
    return j.select("id", "n", (F.col("lefts") - F.col("n") * F.col("left")).alias("length"), (F.col("owns") - F.col("n") * F.col("own")).alias("drop"))


def average_upslope_flowpath_length(dem: Raster) -> Raster:
    """Mean length of the paths from all divide cells upstream."""
    return _by_id(_from_heads(dem), F.when(F.col("n") > 0, F.col("length") / F.col("n")).otherwise(0.0))


def average_flowpath_slope(dem: Raster) -> Raster:
    """Slope in degrees of the paths from all divide cells upstream: their whole drop over their whole length."""
    return _by_id(_from_heads(dem), F.when(F.col("length") > 0, F.degrees(F.atan(F.col("drop") / F.col("length")))).otherwise(0.0))


def longest_flowpath(dem: Raster, basins: Raster) -> DataFrame:
    """basin, row, col, steps, length for every cell of the longest path inside each basin (the least cell on a tie)."""
    b = basins.filter("z IS NOT NULL AND z <> 0").select(cell_id().alias("_b"), F.col("z").alias("basin"))
    f = forest(d8_pointer(dem)).join(b, F.col("id") == F.col("_b")).drop("_b")
    on = b.select(F.col("_b").alias("_n"), F.col("basin").alias("_same"))
    f = f.join(on, (F.col("next") == F.col("_n")) & (F.col("basin") == F.col("_same")), "left")
    inside = F.col("_n").isNotNull()
    f = written(f.select("id", "basin", F.when(inside, F.col("next")).alias("next"), F.when(inside, F.col("step")).otherwise(0.0).alias("step")), "forest")
    far = downstream(f.select("id", "next", "step"), {"step": _sum}).select(F.col("id").alias("_i"), F.col("step").alias("left"))
    start = f.join(far, F.col("id") == F.col("_i")).groupBy("basin").agg(F.min_by("id", F.struct(-F.col("left"), F.col("id"))).alias("at"))
    walked = paths(jumps(f), start.select(F.col("basin").alias("key"), "at"))
    return walked.select(F.col("key").alias("basin"), F.shiftright("id", 32).cast("int").alias("row"), F.col("id").bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("col"), "steps", F.col("len").alias("length"))


def downslope_index(dem: Raster, drop: float = 2.0, out: str = "tangent") -> Raster:
    """``drop`` over the distance along the flow path at which the path has fallen by it.

    A path that ends before counts with what it has. out: tangent, degrees, radians or distance.
    """
    f = written(forest(d8_pointer(dem)), "forest")
    values = dem.filter(F.col("z").isNotNull()).select(cell_id().alias("id"), F.col("z").alias("v"))
    levels = jumps(f)
    hit = first_below(levels, values.select(F.col("id").alias("key"), F.col("id").alias("at"), (F.col("v") - drop).alias("bar")), values)
    ends = downstream(f, {"step": _sum}).select(F.col("id").alias("_e"), "last", F.col("step").alias("whole"))
    low = values.select(F.col("id").alias("_l"), F.col("v").alias("low"))
    far = values.select(F.col("id").alias("_h"), F.col("v").alias("here"))
    j = values.select("id", "v").join(hit, F.col("id") == F.col("key"), "left").join(ends, F.col("id") == F.col("_e")).join(low, F.col("last") == F.col("_l")).join(far, F.col("at") == F.col("_h"), "left")
    length = F.coalesce("len", "whole")
    fall = F.col("v") - F.coalesce("here", "low")
    tangent = F.when(length > 0, fall / length).otherwise(0.0)
    return _by_id(j, {"tangent": tangent, "degrees": F.degrees(F.atan(tangent)), "radians": F.atan(tangent), "distance": length}[out])


def max_branch_length(dem: Raster) -> Raster:
    """Largest distance along the paths of a cell and a neighbour (of the eight) to where they meet, or end."""
    f = written(forest(d8_pointer(dem)), "forest")
    ids = f.select("id")
    later = [(0, 1), (1, -1), (1, 0), (1, 1)]  # each pair once
    to = F.explode(F.array(*[F.col("id") + ((dr << 32) + dc) for dr, dc in later]))
    pairs = ids.select(F.col("id").alias("a"), to.alias("b")).join(ids.withColumnRenamed("id", "_k"), F.col("b") == F.col("_k"), "left_semi")
    depth = downstream(f.withColumn("step", F.when(F.col("next").isNotNull(), 1).otherwise(0).cast("long")), {"step": _sum}).select("id", F.col("step").alias("d"))
    m = meetings(jumps(f), pairs, written(depth, "depth"))
    both = m.select(F.col("a").alias("id"), F.greatest("la", "lb").alias("v")).union(m.select("b", F.greatest("la", "lb")))
    best = both.groupBy(F.col("id").alias("_i")).agg(F.max("v").alias("v"))
    return _by_id(ids.join(best, F.col("id") == F.col("_i"), "left"), F.coalesce("v", F.lit(0.0)))


def isobasins(dem: Raster, size: int) -> Raster:
    """Basins of about ``size`` cells, numbered by their outlets.

    Each round cuts the forest below the first cell of each path that ``size`` cells drain through, and
    counts again what is left; a cell that has too many at once becomes an outlet with what it has.
    """
    f = written(forest(d8_pointer(dem)).select("id", "next"), "forest")
    while True:
        acc = written(upstream(f.withColumn("n", F.lit(1).cast("long")), ["n"]), "sizes")
        large = acc.filter(F.col("n") >= size).select(F.col("id").alias("_l"))
        j = f.join(large, F.col("id") == F.col("_l"), "left_semi").filter("next IS NOT NULL")
        fed = f.join(large, F.col("id") == F.col("_l"), "left_semi").select(F.col("next").alias("_n")).distinct()
        cut = written(j.join(fed, F.col("id") == F.col("_n"), "left_anti").select(F.col("id").alias("_c")), "cuts")
        if not cut.limit(1).count():
            break
        f = written(f.join(cut, F.col("id") == F.col("_c"), "left").select("id", F.when(F.col("_c").isNull(), F.col("next")).alias("next")), "forest")
    ends = downstream(f, {})
    number = ranked(ends.select(F.col("last").alias("_l")).distinct(), [F.col("_l")])
    return _by_id(ends.join(number, F.col("last") == F.col("_l")), F.col("n"))


def unnest_basins(pointer: Raster, outlets: Raster) -> DataFrame:
    """row, col, order, z: the whole basin of every outlet (a value not 0).

    Outlets with none downstream have order 1, those that drain to them order 2, and so on; basins of
    one order don't overlap, so each order is a raster.
    """
    m = outlets.filter("z IS NOT NULL AND z <> 0").select(cell_id().alias("_m"), F.col("z").alias("mark"))
    f = written(forest(pointer).join(m, F.col("id") == F.col("_m"), "left").select("id", "next", F.col("_m").isNotNull().cast("long").alias("marks"), "mark"), "forest")
    order = downstream(f.select("id", "next", "marks"), {"marks": _sum}).select(F.col("id").alias("_o"), F.col("marks").alias("order"))
    most = order.agg(F.max("order")).first()[0] or 0
    known = written(f.filter("marks = 1").select("id", "mark").join(order, F.col("id") == F.col("_o")).select("id", "mark", "order"), "outlets")
    out = None
    for k in range(1, most + 1):  # as many as outlets lie on one path
        own = known.filter(F.col("order") == k)
        w = watershed(pointer, _by_id(own, F.col("mark"))).filter("z IS NOT NULL").select("row", "col", F.lit(k).alias("order"), "z")
        out = w if out is None else out.union(w)
    return out if out is not None else pointer.limit(0).select("row", "col", F.lit(0).alias("order"), "z")


def hillslopes(pointer: Raster, streams: Raster) -> Raster:
    """Cells by the link they drain to and the side they come from: three numbers for a link, head, left and right; stream cells 0.

    A cell takes the side of the first stream cell it reaches: between the channel's
    inflow and its outflow, turning clockwise, is left of the flow; a link's first cell without inflow has a head slope.
    """
    n = written(network(pointer, streams), "network")
    at = links(n).select(F.col("id").alias("_k"), "link")
    number = ranked(at.select(F.col("link").alias("_l")).distinct(), [F.col("_l")], "k")
    f = written(forest(pointer).join(pointer.select(cell_id().alias("_p"), F.col("z").alias("code")), F.col("id") == F.col("_p")).select("id", "next", "step", "code"), "forest")
    main = n.filter("main").select(F.col("next").alias("_t"), F.col("id").alias("_u"))
    ways = f.select(F.col("id").alias("_w"), F.log2("code").cast("int").alias("way"))
    stream = n.select("id").join(main, F.col("id") == F.col("_t"), "left").join(ways.withColumnsRenamed({"way": "out"}), F.col("id") == F.col("_w"), "left").drop("_w")
    # where the channel comes from, as seen from the cell: opposite to the way of the cell upstream
    stream = stream.join(ways.select(F.col("_w").alias("_x"), ((F.col("way") + 4) % 8).alias("from")), F.col("_u") == F.col("_x"), "left").select(F.col("id").alias("_s"), "out", "from")
    # the last cell before the stream and the way it enters
    last = f.join(n.select(F.col("id").alias("_s")), F.col("id") == F.col("_s"), "left_anti")
    on = n.select(F.col("id").alias("_n"))
    last = last.join(on, F.col("next") == F.col("_n"), "left").select("id", F.when(F.col("_n").isNull(), F.col("next")).alias("next"), F.col("_n").alias("to"), ((F.log2("code").cast("int") + 4) % 8).alias("enters"))
    ends = downstream(last.select("id", "next"), {})
    entry = last.filter("to IS NOT NULL").select(F.col("id").alias("_e"), "to", "enters")
    j = ends.join(entry, F.col("last") == F.col("_e")).join(stream, F.col("to") == F.col("_s")).join(at, F.col("to") == F.col("_k")).join(number, F.col("link") == F.col("_l"))
    # directions run clockwise from NE: turning on from the inflow, what comes before the outflow lies on the left bank
    turn = lambda a, b: ((F.col(a) - F.col(b)) % 8 + 8) % 8
    side = F.when(F.col("from").isNull() | F.col("out").isNull(), 0).when(turn("enters", "from") < turn("out", "from"), 1).otherwise(2)
    slopes = _by_id(j, (F.col("k") - 1) * 3 + side + 1)
    return slopes.union(_by_id(n.select("id"), F.lit(0.0)))


def find_outlet(pointer: Raster, streams: Raster, mask: Raster) -> DataFrame:
    """row, col, cells: the stream cell by which most of the watershed (mask > 0) leaves it; the first on a tie.

    Candidates are stream cells in the mask whose receiver is outside or missing; ``cells`` counts the mask's cells that drain there.
    """
    m = mask.filter("z > 0").select(cell_id().alias("_m"))
    f = forest(pointer).join(m, F.col("id") == F.col("_m"), "left_semi")
    on = m.withColumnRenamed("_m", "_n")
    f = written(f.join(on, F.col("next") == F.col("_n"), "left").select("id", F.col("_n").alias("next")), "forest")
    s = streams.filter("z > 0").select(cell_id().alias("_s"))
    out = downstream(f, {}).groupBy("last").agg(F.count(F.lit(1)).alias("cells")).join(s, F.col("last") == F.col("_s"), "left_semi")
    return out.orderBy(F.desc("cells"), "last").limit(1).select(F.shiftright("last", 32).cast("int").alias("row"), F.col("last").bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("col"), "cells")


def flood_order(dem: Raster) -> Raster:
    """The order in which water that rises inward from the edges reaches the cells, from 1.

    That is by spill level; cells with the same one are ordered by elevation and then by row and column.
    """
    level = fill_depressions(dem).withColumnRenamed("z", "level").join(dem, ["row", "col"])
    order = ranked(level.filter("level IS NOT NULL"), [F.col("level"), F.col("z"), F.col("row"), F.col("col")])
    return order.select("row", "col", F.col("n").cast("double").alias("z"))


def upslope_depression_storage(dem: Raster) -> Raster:
    """Mean depth of the depressions of all cells that drain through a cell of the filled surface."""
    filled = written(fill_depressions(dem, 1e-5), "filled")
    f = forest(d8_pointer(filled))
    depth = dem.join(fill_depressions(dem).withColumnRenamed("z", "f"), ["row", "col"]).select(cell_id().alias("_d"), (F.col("f") - F.col("z")).alias("depth"))
    up = upstream(f.join(depth, F.col("id") == F.col("_d")).select("id", "next", "depth", F.lit(1.0).alias("n")), ["depth", "n"])
    return _by_id(up, F.col("depth") / F.col("n"))


def edge_contamination(dem: Raster, flow: str = "d8") -> Raster:
    """1 where the upslope area reaches the edge of the data, else 0; flow: d8 or mfd."""
    n = neighbourhood(dem).filter(F.col("z").isNotNull())
    edge = F.exists("n", lambda v: v.isNull()).cast("double")
    cells = written(n.select(cell_id().alias("id"), edge.alias("start")), "edge")
    if flow == "d8":
        f = forest(d8_pointer(dem)).join(cells.withColumnRenamed("id", "_c"), F.col("id") == F.col("_c"))
        reached = upstream(f.select("id", "next", F.col("start").cast("long").alias("x")), ["x"])
    else:
        ones = fd8_edges(dem).select("src", "dst", F.lit(1.0).alias("w"))
        reached = settle(cells.select("id", "start", F.lit(0.0).alias("loss"), F.lit(0.125).alias("eff")), ones)
    return _by_id(reached, (F.col("x") > 0).cast("double"))


def mdinf_flow_accumulation(dem: Raster, exponent: float = 1.0) -> Raster:
    """Flow dealt to all facets that fall away from the cell, by the steepness of each to the power ``exponent``; in a facet by angle.

    A facet lies between a side and a diagonal neighbour; its flow is dealt between the two as in D-infinity.
    """
    n = neighbourhood(dem).filter(F.col("z").isNotNull())
    z = F.col("z")
    order = [1, 2, 5, 8, 7, 6, 3, 0]  # around, from N
    step = {at: (dr, dc) for dr, dc, at in AROUND}
    facets = []
    for i in range(8):
        a, b = (order[i], order[(i + 1) % 8])
        side, corner = (a, b) if i % 2 == 0 else (b, a)
        e1, e2 = F.get("n", F.lit(side)), F.get("n", F.lit(corner))
        s1, s2 = z - e1, e1 - e2
        r = F.atan2(s2, s1)
        angle = F.when(r < 0, 0.0).when(r > F.lit(0.7853981633974483), 0.7853981633974483).otherwise(r)
        fall = F.when(r < 0, s1).when(r > F.lit(0.7853981633974483), (z - e2) / F.sqrt(F.lit(2.0))).otherwise(F.sqrt(s1 * s1 + s2 * s2))
        part = angle / 0.7853981633974483
        weight = F.pow(fall, F.lit(exponent))
        for at, share in ((side, 1 - part), (corner, part)):
            dr, dc = step[at]
            facets.append(F.when((fall > 0) & (share > 0), F.struct(cell_id(F.col("row") + dr, F.col("col") + dc).alias("dst"), (weight * share).alias("w"), F.get("n", F.lit(at)).alias("to"))))
    lower = n.select(cell_id().alias("src"), "z", F.filter(F.array(*facets), lambda x: x.isNotNull() & (x["to"] < z)).alias("to"))
    total = F.aggregate("to", F.lit(0.0), lambda acc, x: acc + x["w"])
    each = lower.withColumn("total", total).select("src", F.explode("to").alias("e"), "total")
    edges = each.groupBy("src", F.col("e.dst").alias("dst")).agg((F.sum("e.w") / F.first("total")).alias("w"))
    return _spread(dem, edges)


def hillslopes_topaz(dem: Raster, pointer: Raster, streams: Raster) -> DataFrame:
    """link, topaz, kind, cells: channels and hillslopes of one network with numbers that end in 4 (channel), 1 (top), 2 (left), 3 (right).

    Links are numbered upstream from the outlet: the outlet's is 24, and further ones follow in
    the order of their distance from it (ties by cell), ten apart.
    """
    n = written(network(pointer, streams), "network")
    at = links(n).select(F.col("id").alias("_k"), "link")
    far = downstream(n, {"step": _sum}).select(F.col("id").alias("_d"), F.col("step").alias("left"))
    first = at.filter("_k = link").join(far, F.col("link") == F.col("_d")).select("link", "left")
    order = ranked(first, [F.col("left"), F.col("link")], "k").select("link", (F.col("k") * 10 + 14).alias("channel"))
    number = ranked(at.select(F.col("link").alias("_l")).distinct(), [F.col("_l")], "j")
    named = order.join(number, F.col("link") == F.col("_l")).select("link", "channel", "j")
    side = hillslopes(pointer, streams).filter("z > 0").groupBy(((F.col("z") - 1) / 3).cast("long").alias("g"), ((F.col("z") - 1) % 3).cast("int").alias("s")).agg(F.count(F.lit(1)).alias("cells"))
    slopes = side.join(named, F.col("g") == F.col("j") - 1).select("link", (F.col("channel") - 3 + F.col("s")).alias("topaz"), F.get(F.lit(["top", "left", "right"]), F.col("s")).alias("kind"), "cells")
    channels = at.groupBy("link").agg(F.count(F.lit(1)).alias("cells")).join(named, "link").select("link", F.col("channel").alias("topaz"), F.lit("channel").alias("kind"), "cells")
    return channels.union(slopes)
