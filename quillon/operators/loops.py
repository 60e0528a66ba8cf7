"""Loops of a network: bridges, parts that hold together without any one edge, terminal loops, and rings cut in two; doubled stretches of a path.

Edges are (edge, u, v); two edges may join the same nodes.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.geo import haversine
from quillon.operators.assembly import sampled
from quillon.operators.gaps import spanning_forest
from quillon.operators.graph import _key, components
from quillon.operators.joins import cut
from quillon.operators.network import M, near_segments

#: Fixed values. Terminal loops: least length, and how near a station must be to keep one, in metres.
LOOP, STATION = 500.0, 65.0
#: Fixed values of doubled stretches, in metres: how close the copies lie; least length; longest parting that they go on over; how far apart they may get there;
#: how near an end of the run; least length in the middle of one; cuts are made where copies are no farther apart than usual and this; between samples.
APART, LEAST, GAP, WANDER, END, MIDDLE, CLOSE, STEP = 10.0, 100.0, 150.0, 20.0, 50.0, 300.0, 1.5, 2.0


#: Edges that a task searches at once.
NEAR_EDGES = 1 << 17


def _searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """edge, u, v, batch, part (a number within it), bridge: every NEAR_EDGES edges, with their parts that hold together and the bridges there are if no other edge were."""
    base, count, held = TaskContext.get().partitionId() << 32, 0, []

    def done() -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        first: dict[int, int] = {}
        for at, e in enumerate(table.column("edge").to_pylist()):
            first.setdefault(e, at)
        table = table.take(pa.array(list(first.values()), pa.int64())) if len(first) < table.num_rows else table
        names: dict = {}
        nodes = lambda c: [names.setdefault(_key(x), len(names)) for x in table.column(c).to_pylist()]
        us, vs = nodes("u"), nodes("v")
        near: list[list[tuple[int, int]]] = [[] for _ in names]
        for e, (u, v) in enumerate(zip(us, vs, strict=True)):
            near[u].append((v, e))
            near[v].append((u, e))
        seen, low, part, bridge = [0] * len(near), [0] * len(near), [0] * len(near), [False] * len(us)
        turn = 0
        for root in range(len(near)):
            if seen[root]:
                continue
            turn += 1
            seen[root] = low[root] = turn
            part[root] = root
            todo = [(root, -1, iter(near[root]))]
            while todo:
                u, came, rest = todo[-1]
                for v, e in rest:
                    if e == came:
                        continue
                    if seen[v]:
                        low[u] = min(low[u], seen[v])
                        continue
                    turn += 1
                    seen[v] = low[v] = turn
                    part[v] = root
                    todo.append((v, e, iter(near[v])))
                    break
                else:
                    todo.pop()
                    if todo:
                        p = todo[-1][0]
                        low[p] = min(low[p], low[u])
                        bridge[came] = low[u] > seen[p]
        more = [pa.array([base + count] * len(us), pa.int64()), pa.array([part[u] for u in us], pa.int32()), pa.array(bridge, pa.bool_())]
        held.clear()
        return pa.RecordBatch.from_arrays([*[table.column(c).combine_chunks() for c in ("edge", "u", "v")], *more], names=["edge", "u", "v", "batch", "part", "bridge"])

    for b in batches:
        held.append(b)
        if sum(x.num_rows for x in held) >= NEAR_EDGES:
            yield done()
            count += 1
    if sum(x.num_rows for x in held):
        yield done()


def bridges(edges: DataFrame) -> DataFrame:
    """edge, u, v (the smaller first) of the edges without which their ends would fall apart. An id stands for one pair of ends; rows that repeat count once.

    Tasks search what they hold. Parts none of whose nodes are in another batch are whole, and settled by that; only the edges of others go through ``_bridges``.
    """
    own = edges.select("edge", "u", "v").where("u <> v")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in own.schema)
    found = cut(own.mapInArrow(_searched, f"{kinds}, batch long, part int, bridge boolean"))
    ordered = ["edge", F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")]
    ends = found.select(F.explode(F.array("u", "v")).alias("node"), "batch", "part")
    open_ = ends.groupBy("node").agg(F.collect_set(F.struct("batch", "part")).alias("parts")).where(F.size("parts") > 1)
    open_ = cut(open_.select(F.explode("parts").alias("p")).select("p.batch", "p.part").distinct())
    if not open_.limit(1).count():
        return found.where("bridge").select(*ordered)
    settled = found.where("bridge").join(open_, ["batch", "part"], "left_anti").select(*ordered)
    return settled.unionByName(_bridges(found.join(open_, ["batch", "part"], "left_semi")))


def _bridges(edges: DataFrame) -> DataFrame:
    """``bridges`` of edges wherever their neighbours are.

    Every edge outside a spanning forest has a random number (two of 64 bits, by its id), and every node holds what its own add up to, bit by
    bit. Over one side of a forest edge these cancel out exactly if no other edge leads across. Both sides are stretches of the
    tour round the tree, so the sums come from one list that is added up by doubling: rounds grow with the logarithm of its length, however deep the tree.
    """
    own = cut(edges.select("edge", "u", "v").where("u <> v").dropDuplicates(["edge"]))
    pairs = own.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "edge")
    tree = spanning_forest(pairs.select("u", "v", F.lit(1).alias("w"))).select("u", "v")
    tree = cut(pairs.join(tree, ["u", "v"]).groupBy("u", "v").agg(F.min("edge").alias("edge")))
    across = pairs.join(tree.select("edge"), "edge", "left_anti")
    numbers = across.select(F.explode(F.array("u", "v")).alias("node"), F.xxhash64("edge", F.lit(1)).alias("x"), F.xxhash64("edge", F.lit(2)).alias("y"))
    held = numbers.groupBy("node").agg(F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"))
    arcs = cut(tree.select("edge", F.col("u").alias("a"), F.col("v").alias("b")).unionByName(tree.select("edge", F.col("v").alias("a"), F.col("u").alias("b"))))
    out = Window.partitionBy("a").orderBy("b")
    whole = out.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # the tour goes from a to b, and from b to the neighbour that comes after a there
    turns = arcs.select(F.col("b").alias("t_a"), F.col("a").alias("t_b"), F.struct("a", "b").alias("arc"))
    following = arcs.withColumn("then", F.coalesce(F.lead("b").over(out), F.first("b").over(whole))).select(F.col("a").alias("t_a"), F.col("b").alias("t_b"), F.struct(F.col("t_a"), F.col("then")).alias("next"))
    tour = turns.join(following, ["t_a", "t_b"]).select("arc", F.struct(F.col("next.t_a").alias("a"), F.col("next.then").alias("b")).alias("next"))
    one = components(tree.select("u", "v")).withColumnRenamed("node", "a")
    starts = arcs.join(one, "a").groupBy("component").agg(F.min(F.struct("a", "b")).alias("next")).select("next", F.lit(True).alias("start"))
    own_arc = arcs.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).join(held, "node").select(F.struct(F.col("node").alias("a"), "b").alias("arc"), "x", "y")  # one arc out of each node bears its number
    zero = F.lit(0).cast("long")
    rows = tour.join(own_arc, "arc", "left").join(starts, "next", "left").select("arc", F.when(F.col("start").isNull(), F.col("next")).alias("next"), F.coalesce("x", zero).alias("x"), F.coalesce("y", zero).alias("y"))
    rows = cut(rows.withColumns({"sx": F.col("x"), "sy": F.col("y")}))
    while rows.where("next IS NOT NULL").limit(1).count():
        ahead = rows.select(F.col("arc").alias("next"), F.col("next").alias("n_next"), F.col("sx").alias("n_sx"), F.col("sy").alias("n_sy"))
        rows = rows.join(ahead, "next", "left")
        rows = cut(rows.select("arc", F.col("n_next").alias("next"), "x", "y", F.col("sx").bitwiseXOR(F.coalesce("n_sx", zero)).alias("sx"), F.col("sy").bitwiseXOR(F.coalesce("n_sy", zero)).alias("sy")))
    sums = rows.select(F.least("arc.a", "arc.b").alias("u"), F.greatest("arc.a", "arc.b").alias("v"), F.col("sx").bitwiseXOR(F.col("x")).alias("x"), F.col("sy").bitwiseXOR(F.col("y")).alias("y"))
    sides = sums.groupBy("u", "v").agg(F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y")).where("x = 0 AND y = 0")
    return tree.join(sides.select("u", "v"), ["u", "v"]).select("edge", "u", "v")


def blocks(edges: DataFrame) -> DataFrame:
    """node, block (its least node): the parts that stay together whichever edge goes; a node that only bridges meet at is one by itself."""
    nodes = edges.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    rest = edges.join(bridges(edges).select("edge"), "edge", "left_anti").where("u <> v")
    return nodes.join(components(rest.select("u", "v")), "node", "left").select("node", F.coalesce("component", "node").alias("block"))


def terminal_loops(edges: DataFrame, stations: DataFrame, least: float = LOOP) -> DataFrame:
    """edge, block: the edges (edge, u, v, metres, owned) of loops at the end of a branch: parts without a bridge that one bridge ties to the rest, at least
    ``least`` long, with no owned edge and no station (node) on them. The approach stays."""
    of = cut(blocks(edges))
    side = lambda c: of.select(F.col("node").alias(c), F.col("block").alias(f"b_{c}"))
    rows = cut(edges.join(side("u"), "u").join(side("v"), "v"))
    ties = rows.where("b_u <> b_v").select(F.explode(F.array("b_u", "b_v")).alias("block")).groupBy("block").agg(F.count(F.lit(1)).alias("ties")).where("ties = 1")
    inner = rows.where("b_u = b_v").withColumnRenamed("b_u", "block")
    stopped = of.join(stations.select("node").distinct(), "node").select("block").distinct()
    loops = inner.groupBy("block").agg(F.sum("metres").alias("length"), F.max("owned").alias("kept")).where((F.col("length") >= least) & ~F.col("kept"))
    found = loops.join(ties, "block").join(stopped, "block", "left_anti")
    return inner.join(found.select("block"), "block").select("edge", "block")


def ring_arcs(rings: DataFrame, cuts: DataFrame) -> DataFrame:
    """ring, seq (from 1), lon, lat: of each closed ring (ring, seq, lon, lat; its last vertex is its first) the longer of the two ways between the vertices
    nearest two places (ring, a_lon, a_lat, b_lon, b_lat)."""
    w = Window.partitionBy("ring").orderBy("seq")
    rows = rings.withColumns({"k": F.row_number().over(w), "n": F.count(F.lit(1)).over(Window.partitionBy("ring"))})
    step = F.coalesce(haversine(F.lag("lon").over(w), F.lag("lat").over(w), F.col("lon"), F.col("lat")), F.lit(0.0))
    rows = cut(rows.withColumn("step", step).withColumn("along", F.sum("step").over(w)))
    open_ = rows.where("k < n").join(cuts, "ring")
    far = lambda p: F.struct(haversine(F.col("lon"), F.col("lat"), F.col(f"{p}_lon"), F.col(f"{p}_lat")), "k", "along")
    near = open_.groupBy("ring").agg(F.min(far("a")).alias("a"), F.min(far("b")).alias("b"))
    place = lambda x: F.struct(F.col(f"{x}.k").alias("k"), F.col(f"{x}.along").alias("along"))
    ends = near.select("ring", F.least(place("a"), place("b")).alias("lo"), F.greatest(place("a"), place("b")).alias("hi"))
    length = rows.groupBy("ring").agg(F.max("along").alias("length"))
    ends = ends.join(length, "ring").withColumn("inner", F.col("hi.along") - F.col("lo.along") >= F.col("length") / 2)
    # the way round the seam goes from the later place on over the last vertex, and from the first to the earlier place
    k, n = F.col("k"), F.col("n")
    turns = F.when(F.col("inner"), F.array(F.when(k.between(F.col("lo.k"), F.col("hi.k")), k))).otherwise(F.array(F.when(k >= F.col("hi.k"), k), F.when(k <= F.col("lo.k"), k + n)))
    met = rows.where("k < n").join(ends, "ring").withColumn("turn", F.explode(turns)).where("turn IS NOT NULL")
    return met.select("ring", F.row_number().over(Window.partitionBy("ring").orderBy("turn")).alias("seq"), "lon", "lat")


# --- doubled stretches ------------------------------------------------------------------------------------------------


def _may_fold(paths: DataFrame, least: float, gap: float, step: float) -> DataFrame:
    """The lines (line) that can have a doubled stretch at all. The later copy is a row of samples at most ``gap`` apart that is ``least`` long, so a line whose
    samples lie farther apart all along has none, whatever lies beside it. That is known from its legs, with room for rounding: lines in doubt stay."""
    w = Window.partitionBy("line").orderBy("seq")
    legs = paths.withColumns({f"n_{c}": F.lead(c).over(w) for c in ("lon", "lat")}).where("n_lon IS NOT NULL")
    metres = haversine(F.col("lon"), F.col("lat"), F.col("n_lon"), F.col("n_lat"))
    parts = F.greatest(F.lit(1), F.ceil(F.floor(metres + 0.5) / step))  # as ``resample`` cuts them, evenly by degrees
    across, up = F.abs(F.col("n_lon") - F.col("lon")), F.abs(F.col("n_lat") - F.col("lat"))
    fewest = M * F.hypot(across * F.cos(F.radians(F.greatest(F.abs("lat"), F.abs("n_lat")))), up)
    far = (0.99 * fewest / parts > gap) & (F.greatest(across, up) / parts < 0.5)
    legs = legs.select("line", "seq", far.alias("far"), (1.01 * M * F.hypot(across, up)).alias("most"))
    legs = legs.withColumn("run", F.sum(F.col("far").cast("int")).over(w))
    return legs.where("NOT far").groupBy("line", "run").agg(F.sum("most").alias("most")).where(F.col("most") >= least).select("line").distinct()


def folds(paths: DataFrame, apart: float = APART, least: float = LEAST, gap: float = GAP, wander: float = WANDER, step: float = STEP, close: float = CLOSE) -> DataFrame:
    """line, turn, e_low, e_high, l_low, l_high, l_near, e_near, length: where a path (line, seq, lon, lat) comes back beside itself heading the other way.

    In metres along it: the earlier and the later copy, and where they first come as near each other as they usually are. Places of the two copies mirror each other
    about the turn, so the sum of their distances along the path stays about the same over one turn; sums that lie apart are different turns. A
    stretch goes on where the copies part for at most ``gap`` metres and ``wander`` aside.
    """
    rows = sampled(paths.join(_may_fold(paths, least, gap, step), "line", "left_semi"), step)
    k = F.cos(F.radians(F.col("lat")))
    dx, dy = (F.col("b_lon") - F.col("lon")) * k, F.col("b_lat") - F.col("lat")
    size = F.hypot(dx, dy)
    rows = cut(rows.withColumns({"hx": F.when(size > 0, dx / size).otherwise(0.0), "hy": F.when(size > 0, dy / size).otherwise(0.0)}))
    spots = rows.select(F.struct("line", "k").alias("id"), "line", "lon", "lat")
    dots = rows.select(F.struct("line", "k").alias("seg"), "line", F.col("lon").alias("a_lon"), F.col("lat").alias("a_lat"), F.col("lon").alias("b_lon"), F.col("lat").alias("b_lat"))  # samples again, as points
    met = near_segments(spots, dots, max(apart, wander), by=("line",)).select("line", F.col("id.k").alias("j"), F.col("seg.k").alias("i"), "metres").where("i < j")
    side = lambda c: rows.select("line", F.col("k").alias(c), F.col("along").alias(f"s_{c}"), F.col("hx").alias(f"x_{c}"), F.col("hy").alias(f"y_{c}"))
    met = cut(met.join(side("i"), ["line", "i"]).join(side("j"), ["line", "j"]))
    pairs = met.where((F.col("metres") <= apart) & (F.col("s_j") - F.col("s_i") > 3 * apart) & (F.col("x_i") * F.col("x_j") + F.col("y_i") * F.col("y_j") < -0.8))
    total = F.col("s_i") + F.col("s_j")
    w = Window.partitionBy("line").orderBy("total", "j", "i")
    pairs = pairs.withColumn("total", total).withColumn("new", F.coalesce(F.col("total") - F.lag("total").over(w) > 10 * step, F.lit(True)))
    pairs = cut(pairs.withColumn("turn", F.sum(F.col("new").cast("int")).over(w)).select("line", "turn", "i", "j", "s_i", "s_j", "metres"))
    # later places of a turn in order; those more than a gap apart are stretches of their own
    late = pairs.groupBy("line", "turn", "j", "s_j").agg(F.min("s_i").alias("low"), F.max("s_i").alias("high"))
    w = Window.partitionBy("line", "turn").orderBy("j")
    late = late.withColumns({"p_j": F.lag("j").over(w), "p_s": F.lag("s_j").over(w)})
    late = cut(late.withColumn("run", F.sum(F.coalesce(F.col("s_j") - F.col("p_s") > gap, F.lit(True)).cast("int")).over(w)))
    reach = late.groupBy("line", "turn", "run").agg((F.min("low") - gap).alias("from"), (F.max("high") + gap).alias("to"))
    # within a gap, every place must have an earlier one of the stretch within wander
    partings = late.where(F.col("s_j") - F.col("p_s") > 4 * step).where(F.col("s_j") - F.col("p_s") <= gap).join(reach, ["line", "turn", "run"])
    between = partings.select("line", "turn", "run", F.col("j").alias("after"), "from", "to", F.explode(F.sequence("p_j", F.col("j") - 1)).alias("j"))
    beside = met.where(F.col("metres") <= wander).select("line", "j", "s_i")
    seen = between.join(beside, ["line", "j"]).where("s_i >= from AND s_i <= to").select("line", "turn", "run", "after", "j").distinct()
    lost = between.join(seen, ["line", "turn", "run", "after", "j"], "left_anti").select("line", "turn", F.col("after").alias("j")).distinct().withColumn("lost", F.lit(True))
    late = late.join(lost, ["line", "turn", "j"], "left")
    late = late.withColumn("part", F.sum(F.coalesce(F.col("lost"), F.lit(False)).cast("int")).over(Window.partitionBy("line", "turn", "run").orderBy("j")))
    parts = pairs.join(late.select("line", "turn", "j", "run", "part"), ["line", "turn", "j"])
    own = ["line", "turn", "run", "part"]
    middle = Window.partitionBy(*own)
    parts = parts.withColumn("near", F.col("metres") <= F.percentile("metres", 0.5).over(middle) + close)
    found = parts.groupBy(*own).agg(
        F.min("s_i").alias("e_low"), F.max("s_i").alias("e_high"), F.min("s_j").alias("l_low"), F.max("s_j").alias("l_high"), F.min(F.when(F.col("near"), F.col("s_j"))).alias("l_near"), F.max(F.when(F.col("near"), F.col("s_i"))).alias("e_near"),
    )
    length = rows.groupBy("line").agg(F.max("along").alias("length"))
    found = found.where((F.col("l_high") - F.col("l_low") >= least) & (F.col("e_high") <= F.col("l_low")))
    return found.join(length, "line").select("line", "turn", "e_low", "e_high", "l_low", "l_high", "l_near", "e_near", "length")


def one_copy(paths: DataFrame, apart: float = APART, least: float = LEAST, end: float = END, middle: float = MIDDLE, step: float = STEP, gap: float = GAP, wander: float = WANDER) -> DataFrame:
    """line, part (from 1), low, high: the parts of each path, in metres along it, that stay when the second copy of every doubled stretch goes.

    A stretch counts if it begins or ends the path (within ``end`` metres) or is ``middle`` long. Of all stretches of a turn the later copy goes, or the earlier
    where one of them begins the path and none ends it: the turn itself stays whole. Slivers between two stretches that go, go with them.
    Samples farther apart than ``gap`` are in no stretch together: with a wide ``step`` it must be wide too, or nothing is found.
    """
    found = folds(paths, apart, least, gap, wander, step)
    at_end, at_begin = F.col("length") - F.col("l_high") <= end, F.col("e_low") <= end
    found = cut(found.where(at_end | at_begin | (F.col("l_high") - F.col("l_low") >= middle)))
    w = Window.partitionBy("line", "turn")
    found = found.withColumn("first", F.max(at_begin).over(w) & ~F.max(at_end).over(w))
    drop = F.when(
        ~F.col("first"), F.when(at_end, F.struct(F.col("l_near").alias("low"), F.col("length").alias("high"))).otherwise(F.struct(F.col("l_near").alias("low"), F.col("l_high").alias("high")))
    ).otherwise(F.when(at_begin, F.struct(F.lit(0.0).alias("low"), F.col("e_near").alias("high"))).otherwise(F.struct(F.col("e_low").alias("low"), F.col("e_near").alias("high"))))
    drops = found.select("line", "length", drop.alias("d")).select("line", "length", "d.low", "d.high")
    order = Window.partitionBy("line").orderBy("low", "high")
    before = F.max("high").over(order.rowsBetween(Window.unboundedPreceding, -1))
    drops = drops.withColumn("new", F.coalesce(F.col("low") > before, F.lit(True))).withColumn("group", F.sum(F.col("new").cast("int")).over(order))
    drops = drops.groupBy("line", "group", "length").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    edge = Window.partitionBy("line").orderBy("low")
    kept = drops.select("line", F.coalesce(F.lag("high").over(edge), F.lit(0.0)).alias("k_low"), F.col("low").alias("k_high"), "length")
    last = drops.groupBy("line", "length").agg(F.max("high").alias("k_low")).select("line", "k_low", F.col("length").alias("k_high"), "length")
    kept = kept.unionByName(last).where((F.col("k_high") > F.col("k_low")) & ((F.col("k_high") - F.col("k_low") > 2 * apart) | (F.col("k_low") == 0) | (F.col("k_high") == F.col("length"))))
    untouched = sampled(paths, step).groupBy("line").agg(F.max("along").alias("k_high")).join(found.select("line").distinct(), "line", "left_anti").select("line", F.lit(0.0).alias("k_low"), "k_high")
    every = kept.select("line", "k_low", "k_high").unionByName(untouched)
    return every.select("line", F.row_number().over(Window.partitionBy("line").orderBy("k_low")).alias("part"), F.col("k_low").alias("low"), F.col("k_high").alias("high"))
