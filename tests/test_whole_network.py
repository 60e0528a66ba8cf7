"""Network queries over whole small tables, against brute force in plain Python."""

import heapq
import math
import random
from collections import Counter, defaultdict

from quillon.operators import graph
from quillon.operators import network as operators
from quillon.plans import catalog, network  # noqa: F401  network adds its queries to the catalogue

LINEITEM = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate string"


def saved(spark, folder, trips):
    """Tables of a folder with these trips (each a list of stops)."""
    rows = [(trip, 1, stop, k, 1.0, 1.0, 0.0, 0.0, "N", "O", "1995-01-01") for trip, stops in trips.items() for k, stop in enumerate(stops, 1)]
    stops = sorted({s for way in trips.values() for s in way})
    spark.createDataFrame(rows, LINEITEM).write.parquet(f"{folder}/lineitem.parquet")
    spark.createDataFrame([(s, f"S{s}", 0) for s in stops], "s_suppkey long, s_name string, s_nationkey int").write.parquet(f"{folder}/supplier.parquet")


def test_contracted_edges(spark, tmp_path):
    rng = random.Random(5)
    trips = {t: [rng.randrange(20)] + [100 * t + k for k in range(rng.randrange(6))] + [20 + rng.randrange(20)] for t in range(1, 61)}
    saved(spark, tmp_path, trips)
    near = defaultdict(set)
    for way in trips.values():
        for a, b in zip(way, way[1:], strict=False):
            near[a].add(b)
            near[b].add(a)
    want = Counter()
    for u in near:
        if len(near[u]) == 2:
            continue
        for v in near[u]:
            before, at, n = u, v, 1
            while len(near[at]) == 2:
                before, at, n = at, next(x for x in near[at] if x != before), n + 1
            want[(min(u, at), max(u, at), 1000 * n, n)] += 1  # from either end: twice
    want = {k: n // 2 for k, n in want.items()}
    got = Counter((r.u, r.v, r.metres, r.pieces) for r in catalog.queries()["contracted_edges"](spark, str(tmp_path)).collect())
    assert got == want


def test_smoothed_paths(spark, tmp_path):
    rng = random.Random(6)
    trips = {t: [rng.randrange(400) for _ in range(rng.randrange(1, 9))] for t in range(1, 31)}
    saved(spark, tmp_path, trips)
    want = {}
    for line, stops in trips.items():
        at = [(100.0 + s % 97 * 0.05, 20.0 + s % 53 * 0.05) for s in stops]
        along = [0.0]
        for (a, b), (c, d) in zip(at, at[1:], strict=False):
            h = math.sin(math.radians(d - b) / 2) ** 2 + math.cos(math.radians(b)) * math.cos(math.radians(d)) * math.sin(math.radians(c - a) / 2) ** 2
            along.append(along[-1] + 2 * 6371000.0 * math.asin(math.sqrt(h)))
        for i, point in enumerate(at):
            if 0 < i < len(at) - 1:
                w = [math.exp(-((x - along[i]) ** 2) / (2 * 50_000.0**2)) * (abs(x - along[i]) <= 150_000.0) for x in along]
                point = tuple(sum(p[c] * v for p, v in zip(at, w, strict=True)) / sum(w) for c in (0, 1))
            want[line, i + 1] = point
    rows = catalog.queries()["smoothed_paths"](spark, str(tmp_path)).collect()
    got = {(r.line, r.seq): (r.lon, r.lat) for r in rows}
    assert len(rows) == len(got) and set(got) == set(want)
    assert all(math.dist(got[k], want[k]) < 1e-9 for k in want)


def cheapest(costs, start, most):
    best, todo = {}, [(0, start)]
    while todo:
        cost, node = heapq.heappop(todo)
        if node in best or cost > most:
            continue
        best[node] = cost
        for to, w in costs[node].items():
            heapq.heappush(todo, (cost + w, to))
    return best


def test_ways_of_many_hops(spark, tmp_path):
    saved(spark, tmp_path, {1: list(range(1, 8)), 2: list(range(7, 14)), 3: [13, 14, 15, 3], 4: [2, 99, 4]})
    metres = {}
    for u, v in [(u, u + 1) for u in range(1, 15)] + [(3, 15), (2, 99), (4, 99)]:
        (a, b), (c, d) = ((100.0 + s % 97 * 0.05, 20.0 + s % 53 * 0.05) for s in (u, v))
        h = math.sin(math.radians(d - b) / 2) ** 2 + math.cos(math.radians(b)) * math.cos(math.radians(d)) * math.sin(math.radians(c - a) / 2) ** 2
        if (m := 2 * 6371000.0 * math.asin(math.sqrt(h))) < 45_000:
            metres[u, v] = math.floor(m + 0.5)
    by_metres, by_seconds = defaultdict(dict), defaultdict(dict)
    for (u, v), m in metres.items():
        by_metres[u][v] = by_metres[v][u] = m
        by_seconds[u][v] = by_seconds[v][u] = math.ceil(m * 36 / 1600) + (0 if u % 5 == v % 5 else 180)
    far, late = cheapest(by_metres, 1, 90_000), cheapest(by_seconds, 1, 3600)
    assert len(far) > 8 and len(late) > 7  # more than the hops that were once allowed
    assert {r.node: r.cost for r in catalog.queries()["shortest_paths"](spark, str(tmp_path)).collect()} == far
    assert {r.node: r.seconds for r in catalog.queries()["route_seconds"](spark, str(tmp_path)).collect()} == late


def test_propagated_to_the_end(spark):
    """A ladder along which one node a round gets its value."""
    edges = spark.createDataFrame([(i, i + k) for i in range(36) for k in (1, 2)], "u long, v long")
    values = spark.createDataFrame([(0, 7), (1, 7)], "node long, value long")
    assert {(r.node, r.value) for r in operators.propagated(edges, values).collect()} == {(i, 7) for i in range(37)}  # 37 has one neighbour


def test_adoption_to_the_end(spark, tmp_path):
    saved(spark, tmp_path, {1: [3, 1, 2, 4, 5, 7, 8]})
    got = {r.node: (r.label, r.round) for r in catalog.queries()["adopt_unlabelled"](spark, str(tmp_path)).collect()}
    assert got == {node: ("L3", k) for k, node in enumerate([3, 1, 2, 4, 5, 7, 8])}


def test_contraction_works_out_its_edges_once(spark, monkeypatch):
    seen, degrees = [], graph.degrees
    monkeypatch.setattr(graph, "degrees", lambda edges: seen.append(edges) or degrees(edges))
    edges = spark.createDataFrame([(1, 2, 10), (2, 3, 10), (3, 4, 10), (3, 5, 10)], "u long, v long, metres long")
    assert sorted(map(tuple, graph.contract(edges).collect())) == [(1, 3, 20, 2), (3, 4, 10, 1), (3, 5, 10, 1)]
    assert seen and all("quillon-cut-" in f for f in seen[0].inputFiles()) and seen[0].inputFiles()
