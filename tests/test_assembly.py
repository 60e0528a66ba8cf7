"""Spanning forests, bridges, joined ends, directions, runs and company against plain versions of the same rules."""

import itertools
import math
import random

import pytest

from quillon.operators import assembly, gaps, network

M = 111_320.0
PIECES = "line string, piece int, seq int, lon double, lat double"


def kruskal(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    out = set()
    for w, u, v in sorted({(w, min(u, v), max(u, v)) for u, v, w in edges if u != v}):
        if find(u) != find(v):
            root[find(u)] = find(v)
            out.add((u, v, w))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_forest_is_kruskals(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(60), rng.randrange(60), rng.randrange(1, 9)) for _ in range(90)] + [(100 + i, 101 + i, 1) for i in range(12)] + [(7, 7, 1)]
    got = gaps.spanning_forest(spark.createDataFrame(edges, "u long, v long, w long")).collect()
    assert sorted(map(tuple, got)) == sorted(kruskal(edges))
    assert gaps.spanning_forest(spark.createDataFrame([], "u long, v long, w long")).count() == 0


def vertices(parts):
    return [(line, piece, i, x, y) for (line, piece), path in parts.items() for i, (x, y) in enumerate(path)]


def test_gaps_and_bridges(spark):
    # line A has three parts along a track, the middle one in two pieces that touch; B's gap has no track; C lies too far apart
    parts = {
        ("A", 1): [(10.0, 50.0), (10.01, 50.0)], ("A", 2): [(10.02, 50.0), (10.03, 50.0)], ("A", 3): [(10.03, 50.0), (10.04, 50.0)], ("A", 4): [(10.05, 50.001), (10.06, 50.0)],
        ("B", 1): [(10.0, 60.0), (10.01, 60.0)], ("B", 2): [(10.02, 60.0), (10.03, 60.0)], ("C", 1): [(10.0, 0.0), (10.01, 0.0)], ("C", 2): [(10.1, 0.0), (10.11, 0.0)],
    }
    pieces = spark.createDataFrame(vertices(parts), PIECES)
    found = {(r.line, r.u, r.v): r.metres for r in gaps.gaps(pieces).collect()}
    k = M * math.cos(math.radians(50))
    # every pair of parts within reach has its gap; the way between the outer parts is the longest
    assert set(found) == {("A", 1, 2), ("A", 1, 4), ("A", 2, 4), ("B", 1, 2)} and found["A", 1, 2] == pytest.approx(0.01 * k, abs=2) and max(found.values()) == found["A", 1, 4]
    nodes = [(10.01, 50.0), (10.015, 50.0005), (10.02, 50.0), (10.04, 50.0), (10.05, 50.001)]
    tracks = [(i, i, i + 1, *nodes[i], *nodes[i + 1]) for i in (0, 1, 3)]
    rows = gaps.bridged(pieces, spark.createDataFrame(tracks, "seg long, u long, v long, a_lon double, a_lat double, b_lon double, b_lat double")).collect()
    ways = {}
    for r in sorted(rows, key=lambda r: r.seq):
        ways.setdefault((r.line, r.u, r.v), []).append((r.lon, r.lat))
    assert {key: sorted(way) for key, way in ways.items()} == {("A", 1, 2): nodes[:3], ("A", 2, 4): nodes[3:]}


def test_ends_are_joined_up(spark):
    # line A stops 1 km short of line B on a track that goes on to B; its other end stands on no track
    drawn = {("A", 1): [(10.0, 50.0), (10.02, 50.0)], ("B", 1): [(10.03, 49.99), (10.03, 50.01)], ("R", 1): [(11.0, 50.0), (11.1, 50.0), (11.1, 50.1), (11.0, 50.0)]}
    tracks = {("T", 7): [(10.01, 50.0), (10.025, 50.0), (10.04, 50.0)], ("T", 8): [(10.02, 50.0), (10.02, 50.05)]}
    make = lambda parts: spark.createDataFrame(vertices(parts), PIECES)
    loose = {(r.id.line, r.id.tip) for r in gaps.loose_tips(make(drawn)).collect()}
    assert loose == {("A", 0), ("A", 1), ("B", 0), ("B", 1)}
    (row,) = gaps.joined_up(make(drawn), make(tracks)).collect()
    k = 6_371_000 * math.pi / 180 * math.cos(math.radians(50))
    assert (row.line, row.piece) == ("T", 7) and row.low == pytest.approx(0.01 * k, abs=1) and 0.01 * k - 60 <= row.high - row.low <= 0.01 * k + 10
    assert gaps.joined_up(make(drawn), make({("T", 8): tracks["T", 8]})).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_directions_equal_two_colouring(spark, seed):
    rng = random.Random(seed)
    edges = [(u, v, rng.random() < 0.5) for u, v in {tuple(sorted(rng.sample(range(5 * g, 5 * g + 5), 2))) for g in range(20) for _ in range(4)}]
    near = {}
    for u, v, same in edges:
        near.setdefault(u, []).append((v, same))
        near.setdefault(v, []).append((u, same))
    want, seen = {}, set()
    for root in sorted(near):
        if root in seen:
            continue
        way, todo, fine = {root: False}, [root], True
        while todo:
            u = todo.pop()
            for v, same in near[u]:
                flipped = way[u] if same else not way[u]
                if v not in way:
                    way[v] = flipped
                    todo.append(v)
                fine &= way[v] == flipped
        seen |= set(way)
        want |= {n: (root, f if fine else None) for n, f in way.items()}
    got = {r.node: (r.component, r.flipped) for r in assembly.oriented(spark.createDataFrame(edges, "u long, v long, same boolean")).collect()}
    assert got == want and any(f is None for _, f in got.values()) and any(f for _, f in got.values())


def closest_first(tips, reach):
    run = {t[:2]: t[:2] for t in tips}
    pairs = sorted((far(tips[a], tips[b]), a, b) for a, b in itertools.combinations(sorted(tips), 2) if a[0] == b[0] and a[1] != b[1] and far(tips[a], tips[b]) <= reach)
    used, out = set(), set()
    for _, a, b in pairs:
        if a in used or b in used or run[a[:2]] == run[b[:2]]:
            continue
        used |= {a, b}
        out.add((a, b))
        old = run[b[:2]]
        run = {k: run[a[:2]] if r == old else r for k, r in run.items()}
    return out


def far(a, b):
    p, q = math.radians(a[1]), math.radians(b[1])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[0] - a[0]) / 2) ** 2
    return 2 * 6_371_000 * math.asin(math.sqrt(h))


@pytest.mark.parametrize("seed", range(3))
def test_links_equal_closest_first(spark, seed):
    rng = random.Random(seed)
    parts = {(line, p): [(rng.uniform(10, 10.03), rng.uniform(50, 50.03)) for _ in range(2)] for line in "AB" for p in range(14)}
    tips = {(line, p, t): path[-t] for (line, p), path in parts.items() for t in (0, 1)}
    got = assembly.links(spark.createDataFrame(vertices(parts), PIECES), 600.0).collect()
    assert {(tuple(r.a), tuple(r.b)) for r in got} == closest_first(tips, 600.0) != set()


def test_runs_rings_and_guides(spark):
    parts = {
        ("A", 1): [(0.0, 0.0), (0.01, 0.0)], ("A", 2): [(0.03, 0.0), (0.02, 0.0)], ("A", 3): [(0.0101, 0.0), (0.02, 0.0)], ("A", 9): [(0.5, 0.5), (0.6, 0.5)],
        ("R", 1): [(1.0, 0.0), (1.01, 0.0)], ("R", 2): [(1.01, 0.01), (1.01, 0.0)], ("R", 3): [(1.01, 0.01), (1.0, 0.0001)], ("S", 4): [(2.0, 0.0), (2.1, 0.0)],
    }
    shared = {("A", 2)}
    rows = [(*v, v[:2] in shared) for v in vertices(parts)]
    got = {(r.line, r.run): r for r in assembly.assembled(spark.createDataFrame(rows, PIECES + ", shared boolean"), 50.0, 100.0).collect()}
    path = lambda key: [(p.lon, p.lat) for p in got[key].path]
    assert set(got) == {("A", 1), ("A", 9), ("R", 1), ("S", 4)}
    assert path(("A", 1)) == [(0.03, 0.0), (0.02, 0.0), (0.0101, 0.0), (0.01, 0.0), (0.0, 0.0)] and got["A", 1].pieces == [2, 3, 1]
    assert got["R", 1].ring and path(("R", 1))[0] == path(("R", 1))[-1] == (1.0, 0.0) and len(path(("R", 1))) == 5 and not got["A", 1].ring


def test_pieces_that_face_each_other(spark):
    parts = {("A", 1): [(0.0, 0.0), (0.05, 0.0)], ("B", 1): [(0.05, 0.0005), (0.0, 0.0005)], ("C", 1): [(0.0, 0.0003), (0.05, 0.0004)], ("X", 1): [(0.02, -0.02), (0.02, 0.02)]}
    dense = {k: [(a[0] + (b[0] - a[0]) * i / 50, a[1] + (b[1] - a[1]) * i / 50) for i in range(51)] for k, (a, b) in parts.items()}
    got = {(r.u.line, r.v.line): r.same for r in assembly.facing(spark.createDataFrame(vertices(dense), PIECES)).collect()}
    assert got == {("A", "B"): False, ("A", "C"): True, ("B", "C"): False}


def sequential(samples, near, loose, least, lost):
    """Line after line, the longest first, over all samples laid so far."""
    unit = lambda s: (lambda x, y: (x / math.hypot(x, y), y / math.hypot(x, y)) if math.hypot(x, y) else (0.0, 0.0))((s.b_lon - s.lon) * math.cos(math.radians(s.lat)), s.b_lat - s.lat)
    order = sorted(samples, key=lambda line: (-samples[line][-1].along, line))
    own, out = {}, {}
    for rank, line in enumerate(order):
        found = []
        for s in samples[line]:
            here, (hx, hy) = {}, unit(s)
            kx = M * math.cos(math.radians(s.lat))
            for other, free in own.items():
                for q in samples[other]:
                    if q.last or q.k not in free:
                        continue
                    dx, dy, px, py = (q.b_lon - q.lon) * kx, (q.b_lat - q.lat) * M, (s.lon - q.lon) * kx, (s.lat - q.lat) * M
                    share = min(1.0, max(0.0, (px * dx + py * dy) / (dx * dx + dy * dy))) if dx or dy else 0.0
                    d = math.hypot(px - share * dx, py - share * dy)
                    ox, oy = unit(q)
                    past = (q.k == 0 and share == 0) or (q.k == len(samples[other]) - 2 and share == 1)
                    if d <= loose and abs(hx * ox + hy * oy) > 0.85 and (d <= 3 or not past) and (other not in here or (d, q.k) < here[other][:2]):
                        here[other] = (d, q.k)
            found.append([(order.index(o), o, k, d < near) for o, (d, k) in here.items()])
        out[line] = assembly.ride([s.along for s in samples[line]], found, least, lost, 0.5)
        own[line] = {s.k for s, r in zip(samples[line], out[line], strict=True) if r is None}
    return {(line, s.k): (r[1], r[2]) if r else (None, None) for line in samples for s, r in zip(samples[line], out[line], strict=True)}


@pytest.mark.parametrize("seed", range(2))
def test_company_equals_the_sequential_rule(spark, seed):
    rng = random.Random(seed)
    rows = []
    for n in range(9):
        y = 0.0
        for i in range(12 + rng.randrange(6)):
            y = y if rng.random() < 0.6 else rng.choice([0.0, 0.0004, 0.0012, 0.01])
            rows.append((f"L{n}", i, 10 + (i + rng.randrange(2)) * 0.003 * (-1 if n == 4 else 1), 50 + y + rng.uniform(0, 0.0001)))
    paths = spark.createDataFrame(rows, "line string, seq int, lon double, lat double")
    samples = {}
    for s in sorted(assembly.sampled(paths, 100.0).collect(), key=lambda s: s.k):
        samples.setdefault(s.line, []).append(s)
    got = assembly.ridden(paths, step=100.0, least=400.0, lost=3)
    found = {(r.line, r.k): (r.ref, r.ref_k) for r in got.collect()}
    want = sequential(samples, 55.0, 175.0, 400.0, 3)
    assert found == want and sum(r[0] is not None for r in want.values()) > 50
    # corridors: each own stretch is covered once, with the lines that ride there
    spans = assembly.corridors(got).collect()
    own = sorted((line, k) for (line, k), (ref, _) in want.items() if ref is None)
    assert sorted((r.ref, k) for r in spans for k in range(r.low, r.high + 1)) == own and all(r.ref in r.lines for r in spans) and any(len(r.lines) > 2 for r in spans)


def test_riding_rules():
    c = lambda rank, line, place, close=True: (rank, line, place, close)
    along = [100.0 * i for i in range(12)]
    keeps = [[c(2, "b", i), c(1, "a", i, i > 3)] for i in range(12)]
    assert [r[1] for r in assembly.ride(along, keeps, 500, 2, 0.5)] == ["b"] * 12  # kept though an earlier line comes near
    gap = [[] if i in (4, 5) else [c(1, "a", i)] for i in range(12)]
    assert [r and r[1] for r in assembly.ride(along, gap, 500, 2, 0.5)] == ["a"] * 4 + [None] * 2 + ["a"] * 6
    assert assembly.ride(along, gap, 500, 1, 0.5)[:4] == [None] * 4  # the first stretch alone is too short
    assert assembly.ride(along, [[c(1, "a", i, i < 3)] for i in range(12)], 500, 2, 0.5) == [None] * 12
    assert assembly.ride([], [], 500, 2, 0.5) == []


def test_chains_in_one_task_need_no_rounds(spark, monkeypatch):
    """Chains and a ring whose edges lie together: only what tasks leave apart goes through rounds, and the components are the same."""
    from quillon.operators import graph

    edges = [(100 * c + i, 100 * c + i + 1) for c in range(40) for i in range(20)] + [(100 * c, 100 * c + 20) for c in range(0, 40, 2)] + [(5000, 4999), (7, 7)]
    rows = spark.createDataFrame(edges, "u long, v long").coalesce(1)
    want = {(x, x // 100 * 100 if x < 4900 else 4999) for e in edges for x in e}
    seen = []
    whole = graph.components
    monkeypatch.setattr(graph, "components", lambda ties: seen.append(ties.count()) or whole(ties))
    assert {(r.node, r.component) for r in graph.components_nearby(rows).collect()} == want
    assert seen == [0]
    assert {(r.node, r.component) for r in graph.components_nearby(rows.repartition(7)).collect()} == want


def test_cells_of_any_size_find_the_same_segments(spark):
    rng = random.Random(3)
    spot = lambda: (100 + rng.random(), 30 + rng.random())
    points = spark.createDataFrame([(i, *spot()) for i in range(60)], "id long, lon double, lat double")
    segments = spark.createDataFrame([(i, *spot(), *spot()) for i in range(30)], "seg long, a_lon double, a_lat double, b_lon double, b_lat double")
    found = [sorted((r.id, r.seg, r.metres) for r in network.near_segments(points, segments, 5_000.0, size=size).collect()) for size in (None, 5_000.0, 2_000.0)]
    assert len(found[0]) > 50 and found[0] == found[1] == found[2]


def test_nodes_of_structs_within_structs():
    """Tips of pieces turned either way: nodes that Arrow gives as dicts in dicts are joined and searched like others."""
    import pyarrow as pa

    from quillon.operators import graph

    node = lambda line, piece, s: {"n": {"line": line, "piece": piece}, "s": s}
    batch = pa.RecordBatch.from_pylist([{"u": node("A", 2, 0), "v": node("A", 1, 1)}, {"u": node("A", 2, 0), "v": node("A", 3, 0)}, {"u": node("B", 1, 0), "v": node("B", 2, 0)}])
    got = {(graph._key(r["node"]), graph._key(r["root"])) for b in graph._joined(iter([batch])) for r in b.to_pylist()}
    assert got == {((("A", p), s), (("A", 1), 1)) for p, s in ((1, 1), (2, 0), (3, 0))} | {((("B", p), 0), (("B", 1), 0)) for p in (1, 2)}
