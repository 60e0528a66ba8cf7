"""Graph operators over edge tables (u, v, metres): components, turnouts, label adoption, contraction, shortest paths, walks.

Iterations cut their lineage with a checkpoint in the shared folder of the session.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.operators.joins import cut as _cut
from quillon.operators.joins import first_at_place, within


def _both(edges: DataFrame, *more: str) -> DataFrame:
    return edges.select("u", "v", *more).unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"), *more)).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, component (its least node). Labels spread along edges and jump along themselves, so rounds grow with log n."""
    both = _cut(_both(edges))
    roots = _cut(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.first("u")).alias("component")))
    while True:
        near = both.join(roots.withColumnRenamed("node", "v"), "v").groupBy(F.col("u").alias("node")).agg(F.min("component").alias("near"))
        step = roots.join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        far = roots.select(F.col("node").alias("component"), F.col("component").alias("far"))
        step = _cut(step.join(far, "component", "left").select("node", "old", F.least("component", F.coalesce("far", "component")).alias("component")))
        roots = step.select("node", "component")
        if not step.where("component < old").limit(1).count():
            return roots


#: Edges that a task joins up at once.
NEAR_EDGES = 1 << 17


def _key(x):
    """A node as Arrow gives it, as something that can be hashed and compared: structs, of structs too, become tuples."""
    return tuple(map(_key, x.values())) if isinstance(x, dict) else x


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, root: the nodes of every NEAR_EDGES edges (u, v), with the least node that these edges join them to."""
    held: list[pa.RecordBatch] = []

    def done() -> pa.RecordBatch:
        nodes = pa.concat_arrays([b.column(i) for b in held for i in (0, 1)])
        keys = [_key(x) for x in nodes.to_pylist()]
        first: dict = {}
        for at, k in enumerate(keys):
            first.setdefault(k, at)
        root = {k: k for k in first}

        def top(x):
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x

        at = 0
        for n in [b.num_rows for b in held]:
            for a, b in zip(keys[at : at + n], keys[at + n : at + 2 * n], strict=True):
                a, b = top(a), top(b)
                if a != b:
                    root[max(a, b)] = min(a, b)
            at += 2 * n
        own = [nodes.take(pa.array(x, pa.int64())) for x in ([*first.values()], [first[top(k)] for k in first])]
        held.clear()
        return pa.RecordBatch.from_arrays(own, names=["node", "root"])

    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= NEAR_EDGES:
            yield done()
    if held:
        yield done()


def components_nearby(edges: DataFrame) -> DataFrame:
    """``components`` of edges whose neighbours mostly lie in one partition: each task joins up its own, and only what is left goes through rounds."""
    own = edges.select("u", "v")
    kind = own.schema["u"].dataType.simpleString()
    found = _cut(own.mapInArrow(_joined, f"node {kind}, root {kind}").groupBy("node").agg(F.min("root").alias("root"), F.collect_set("root").alias("roots")))
    ties = found.where(F.size("roots") > 1).select(F.col("root").alias("u"), F.explode("roots").alias("v")).where("u <> v")
    far = components(ties).select(F.col("node").alias("root"), F.col("component").alias("far"))
    return found.select("node", "root").join(far, "root", "left").select("node", F.coalesce("far", "root").alias("component"))


def degrees(edges: DataFrame) -> DataFrame:
    return _both(edges).groupBy(F.col("u").alias("node")).agg(F.count(F.lit(1)).alias("degree"))


def turnouts(edges: DataFrame) -> DataFrame:
    """Nodes at which three track ends or more meet."""
    return degrees(edges).where("degree >= 3")


def branchings(paths: DataFrame, node: str = "node") -> DataFrame:
    """The nodes of paths (line, seq, node) at which a train can change track. Counted are path ends and passages: three ends, two passages, or one
    of each make a branching; two ends alone are a seam. Paths of a single point are left aside."""
    own = Window.partitionBy("line")
    rows = paths.withColumns({"first": F.min("seq").over(own), "last": F.max("seq").over(own)}).where("first < last")
    end = (F.col("seq") == F.col("first")) | (F.col("seq") == F.col("last"))
    counts = rows.groupBy(node).agg(F.sum(end.cast("long")).alias("ends"), F.sum((~end).cast("long")).alias("inner"))
    return counts.where("ends >= 3 OR inner >= 2 OR (inner >= 1 AND ends >= 1)").select(node)


def track_nodes(paths: DataFrame) -> DataFrame:
    """Points (line, mode, node) with the graph node they stand for: the place itself on a railway, the place on its line for a metro, so
    that metro lines never join between stations."""
    return paths.withColumn("graph_node", F.when(F.col("mode") == "metro", F.concat_ws("@", F.col("node").cast("string"), F.col("line").cast("string"))).otherwise(F.col("node").cast("string")))


def changes(stations: DataFrame, reach: float, other_mode: int = 3, same_mode: int = 2) -> DataFrame:
    """a, b, metres: walks between stations (id, name, mode, lon, lat): each rail station to its nearest metro stations, and to its nearest
    rail stations of other names, a few each, once for each pair."""
    other = stations.select(F.col("id").alias("b"), F.col("name").alias("r_name"), F.col("mode").alias("r_mode"), F.col("lon").alias("r_lon"), F.col("lat").alias("r_lat"))
    # stations of one name at one place have the same changes; of those that they change to, the first few of each place count, of rail the first
    # few of as many names that one of them may be left out
    metro = first_at_place(other.where("r_mode = 'metro'"), ["b"], other_mode)
    named = first_at_place(other.where("r_mode <> 'metro'"), ["b"], same_mode, by=("r_mode", "r_name"))
    place = ["r_lon", "r_lat", "r_mode", "r_name"]
    names = first_at_place(named.groupBy(*place).agg(F.min("b").alias("b")), ["b"], same_mode + 1, by=("r_mode",)).select(*place)
    named = named.join(names, place, "left_semi")
    rail = stations.where("mode = 'rail'")
    groups = rail.select("name", "lon", "lat").distinct()
    pairs = within(groups, _cut(metro.unionByName(named.select(*metro.columns))), reach).where("r_mode = 'metro' OR name <> r_name")
    rank = F.row_number().over(Window.partitionBy("name", "lon", "lat", "r_mode").orderBy("metres", "b"))
    few = pairs.withColumn("turn", rank).where(F.col("turn") <= F.when(F.col("r_mode") == "metro", other_mode).otherwise(same_mode))
    few = few.select(F.col("name").alias("g_name"), "lon", "lat", "b", "metres").join(rail.select(F.col("id").alias("a"), "name", "lon", "lat"), ["lon", "lat"]).where(F.col("g_name").eqNullSafe(F.col("name")))
    walk = F.greatest(F.lit(120), F.floor(F.col("metres") * F.lit(1.4) + 0.5)).cast("long")
    return few.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), walk.alias("metres")).distinct()


def adopt(edges: DataFrame, labels: DataFrame, rounds: int | None = None) -> DataFrame:
    """node, label, round: unlabelled nodes take the label that most of their neighbours have (ties: the smaller), until none is left to take one or for some rounds."""
    both = _cut(_both(edges))
    known = _cut(labels.select("node", "label", F.lit(0).alias("round")))
    best = Window.partitionBy("node").orderBy(F.desc("n"), "label")
    for r in itertools.count(1) if rounds is None else range(1, rounds + 1):
        votes = both.join(known.select(F.col("node").alias("v"), "label"), "v").groupBy(F.col("u").alias("node"), "label").agg(F.count(F.lit(1)).alias("n"))
        votes = votes.join(known.select("node"), "node", "left_anti")
        new = _cut(votes.withColumn("turn", F.row_number().over(best)).where("turn = 1").select("node", "label", F.lit(r).alias("round")))
        if not new.limit(1).count():
            break
        known = _cut(known.unionByName(new))
    return known


def adopt_from_components(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """node, label: an unlabelled component takes a label if it touches exactly one."""
    free = edges.join(labels.select(F.col("node").alias("u")), "u", "left_anti").join(labels.select(F.col("node").alias("v")), "v", "left_anti")
    comps = components(free.select("u", "v"))
    touch = _both(edges).join(comps.withColumnRenamed("node", "u"), "u").join(labels.withColumnRenamed("node", "v"), "v")
    one = touch.groupBy("component").agg(F.count_distinct("label").alias("n"), F.min("label").alias("label")).where("n = 1")
    return comps.join(one, "component").select("node", "label")


def shortest(edges: DataFrame, sources: DataFrame, cost: str, most: int, rounds: int | None = None) -> DataFrame:
    """node, cost: least cost from any source node, up to ``most`` and, if given, in ``rounds`` hops. Only nodes that improved in the last round push on."""
    both = _cut(_both(edges, cost).groupBy("u", "v").agg(F.min(cost).alias("w")))
    best = _cut(sources.select("node", F.lit(0).cast("long").alias("cost")).distinct())
    front = best
    for _ in itertools.count() if rounds is None else range(rounds):
        step = front.join(both, F.col("node") == F.col("u")).select(F.col("v").alias("node"), (F.col("cost") + F.col("w")).alias("cost")).where(F.col("cost") <= most)
        step = step.groupBy("node").agg(F.min("cost").alias("new"))
        front = _cut(step.join(best, "node", "left").where("cost IS NULL OR new < cost").select("node", F.col("new").alias("cost")))
        if not front.limit(1).count():
            break
        best = _cut(best.unionByName(front).groupBy("node").agg(F.min("cost").alias("cost")))
    return best


def contract(edges: DataFrame, forced: DataFrame | None = None) -> DataFrame:
    """u, v, metres, pieces: chains through nodes of degree two (unless forced) as one edge between the nodes that stay."""
    edges = _cut(edges.select("u", "v", "metres"))  # read several times
    stay = degrees(edges).where("degree <> 2").select("node")
    stay = _cut(stay.unionByName(forced.select("node")).distinct() if forced is not None else stay)
    own = edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "metres").withColumn("edge", F.xxhash64("u", "v"))
    ends = own.select("edge", F.explode(F.array("u", "v")).alias("node"))
    inner = ends.join(stay, "node", "left_anti")
    pairs = inner.groupBy("node").agg(F.min("edge").alias("u"), F.max("edge").alias("v")).where("u <> v").select("u", "v")
    pairs = _cut(pairs)
    chains = components(pairs) if pairs.limit(1).count() else None
    of = own.join(chains.withColumnRenamed("node", "edge"), "edge", "left") if chains is not None else own.withColumn("component", F.lit(None).cast("long"))
    of = of.withColumn("chain", F.coalesce("component", "edge"))
    tips = of.select("chain", F.explode(F.array("u", "v")).alias("node")).join(stay, "node", "left_semi")
    bounds = tips.groupBy("chain").agg(F.min("node").alias("u"), F.max("node").alias("v"))
    return of.groupBy("chain").agg(F.sum("metres").alias("metres"), F.count(F.lit(1)).alias("pieces")).join(bounds, "chain").select("u", "v", "metres", "pieces")


def walks(stations: DataFrame, reach: float, most: int = 3) -> DataFrame:
    """a, b, metres: walks between stations (id, lon, lat) within reach, each station's nearest few, once for each pair."""
    other = stations.select(F.col("id").alias("b"), F.col("lon").alias("r_lon"), F.col("lat").alias("r_lat"))
    # stations at one place have the same nearest ones, but for themselves: one more than are needed are found for each place
    other = _cut(first_at_place(other, ["b"], most + 1))
    pairs = within(stations.select("lon", "lat").distinct(), other, reach)
    near = pairs.withColumn("turn", F.row_number().over(Window.partitionBy("lon", "lat").orderBy("metres", "b"))).where(F.col("turn") <= most + 1)
    own = near.select("lon", "lat", "b", "metres").join(stations.select(F.col("id").alias("a"), "lon", "lat"), ["lon", "lat"]).where("a <> b")
    few = own.withColumn("turn", F.row_number().over(Window.partitionBy("a").orderBy("metres", "b"))).where(F.col("turn") <= most)
    walk = F.greatest(F.lit(120), F.floor(F.col("metres") * F.lit(1.4) + 0.5)).cast("long")
    return few.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), walk.alias("metres")).distinct()
