"""Bridges against a depth-first search, loops at the end of branches, rings cut in two, and doubled stretches of paths."""

import math
import random

import pytest

from quillon.operators import loops

M = 111_320.0


def searched(edges):
    """Bridges by a depth-first search with low points; edges by id, so that parallel ones are told apart."""
    near = {}
    for e, u, v in edges:
        near.setdefault(u, []).append((v, e))
        near.setdefault(v, []).append((u, e))
    seen, low, out = {}, {}, set()
    for root in near:
        if root in seen:
            continue
        seen[root] = low[root] = len(seen)
        todo = [(root, None, iter(near[root]))]
        while todo:
            u, came, rest = todo[-1]
            for v, e in rest:
                if e == came:
                    continue
                if v in seen:
                    low[u] = min(low[u], seen[v])
                    continue
                seen[v] = low[v] = len(seen)
                todo.append((v, e, iter(near[v])))
                break
            else:
                todo.pop()
                if todo:
                    p = todo[-1][0]
                    low[p] = min(low[p], low[u])
                    if low[u] > seen[p]:
                        out.add(came)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_bridges_equal_a_search(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(50), rng.randrange(50)) for _ in range(52)] + [(60, 61), (60, 61), (61, 62), (63, 63), (62, 63)] + [(100 + i, 101 + i) for i in range(40)] + [(200 + i, 200 + (i + 1) % 9) for i in range(9)]
    rows = [(i, u, v) for i, (u, v) in enumerate(edges)]
    frame = spark.createDataFrame(rows, "edge long, u long, v long")
    want = searched(rows)
    assert {r.edge for r in loops.bridges(frame).collect()} == want and len(want) > 40
    rest, block = [(u, v) for e, u, v in rows if e not in want], {}
    for n in {n for _, u, v in rows for n in (u, v)}:
        group, todo = {n}, [n]
        while todo:
            x = todo.pop()
            for u, v in rest:
                for p, q in ((u, v), (v, u)):
                    if p == x and q not in group:
                        group.add(q)
                        todo.append(q)
        block[n] = min(group)
    assert {r.node: r.block for r in loops.blocks(frame).collect()} == block


def test_terminal_loops(spark):
    # a branch 1-2 to a loop 2-3-4; a loop 10-11-12 between two branches; one with a station; one that is owned; one too short
    edges = [(1, 1, 2, 900.0, False), (2, 2, 3, 300.0, False), (3, 3, 4, 300.0, False), (4, 4, 2, 300.0, False)]
    edges += [(10, 1, 10, 50.0, False), (11, 10, 11, 400.0, False), (12, 11, 12, 400.0, False), (13, 12, 10, 400.0, False), (14, 12, 15, 9.0, False)]
    edges += [(20, 15, 20, 9.0, False), (21, 20, 21, 400.0, False), (22, 21, 20, 400.0, False)]
    edges += [(30, 15, 30, 9.0, False), (31, 30, 31, 400.0, False), (32, 31, 30, 400.0, True)]
    edges += [(40, 15, 40, 9.0, False), (41, 40, 41, 100.0, False), (42, 41, 40, 100.0, False)]
    frame = spark.createDataFrame(edges, "edge long, u long, v long, metres double, owned boolean")
    got = loops.terminal_loops(frame, spark.createDataFrame([(21,)], "node long")).collect()
    assert {(r.edge, r.block) for r in got} == {(2, 2), (3, 2), (4, 2)}


@pytest.mark.parametrize("seed", range(2))
def test_ring_arcs(spark, seed):
    rng = random.Random(seed)
    rings, cuts, want = [], [], {}
    for ring in range(8):
        n = rng.randrange(4, 20)
        points = [(rng.uniform(0.5, 1) * math.cos(6.28 * i / n), rng.uniform(0.5, 1) * math.sin(6.28 * i / n)) for i in range(n)]
        a, b = (rng.uniform(-1, 1), rng.uniform(-1, 1)), (rng.uniform(-1, 1), rng.uniform(-1, 1))
        far = lambda p, q: 2 * 6_371_000 * math.asin(math.sqrt(math.sin(math.radians(q[1] - p[1]) / 2) ** 2 + math.cos(math.radians(p[1])) * math.cos(math.radians(q[1])) * math.sin(math.radians(q[0] - p[0]) / 2) ** 2))
        i, j = sorted(min(range(n), key=lambda k: (far(points[k], p), k)) for p in (a, b))
        ways = [points[i : j + 1], points[j:] + points[: i + 1]]
        want[ring] = max(ways, key=lambda w: sum(far(p, q) for p, q in zip(w, w[1:], strict=False)))
        rings += [(ring, k, *p) for k, p in enumerate([*points, points[0]])]
        cuts.append((ring, *a, *b))
    out = {}
    for r in sorted(loops.ring_arcs(spark.createDataFrame(rings, "ring int, seq int, lon double, lat double"), spark.createDataFrame(cuts, "ring int, a_lon double, a_lat double, b_lon double, b_lat double")).collect(), key=lambda r: r.seq):
        out.setdefault(r.ring, []).append((r.lon, r.lat))
    assert out == want


def east(*metres):
    """Places at (metres east, metres north) of a corner on the equator."""
    return [(x / M, y / M) for x, y in metres]


PATHS = {
    "out and back": east((0, 0), (1000, 0), (1010, 2.5), (1000, 5), (0, 5)),
    "straight": east((0, 0), (1500, 0)),
    "two streets": east((0, 0), (1000, 0), (1000, 40), (0, 40)),
    "turning loop": east((0, 0), (800, 0), (900, 60), (1000, 0), (900, -60), (800, 6), (0, 6)),
    "parts around a stop": east((0, 0), (1000, 0), (1010, 3), (1000, 6), (600, 6), (560, 14), (520, 14), (480, 6), (0, 6)),
    "parts too far": east((0, 0), (1000, 0), (1010, 3), (1000, 6), (600, 6), (570, 30), (510, 30), (480, 6), (0, 6)),
    "branch in the middle": east((0, 0), (1000, 0), (1010, 3), (1000, 6), (600, 6), (600, 700)),
    "short": east((0, 0), (60, 0), (65, 2), (60, 4), (0, 4)),
}


def test_doubled_stretches(spark):
    frame = spark.createDataFrame([(n, i, *p) for n, path in PATHS.items() for i, p in enumerate(path)], "line string, seq int, lon double, lat double")
    found = {}
    for r in loops.folds(frame).collect():
        found.setdefault(r.line, []).append((round(r.e_low), round(r.e_high), round(r.l_low), round(r.l_high)))
    assert set(found) == {"out and back", "turning loop", "parts around a stop", "parts too far", "branch in the middle"}
    ((a, b, c, d),) = found["out and back"]
    assert a <= 6 and b >= 985 and c <= 1030 and d >= 2010 and len(found["parts around a stop"]) == 1 and len(found["parts too far"]) == 2
    kept = {}
    for r in sorted(loops.one_copy(frame).collect(), key=lambda r: r.part):
        kept.setdefault(r.line, []).append((r.low, r.high))
    length = {n: sum(math.hypot((q[0] - p[0]) * 6_371_000 * math.pi / 180, (q[1] - p[1]) * 6_371_000 * math.pi / 180) for p, q in zip(path, path[1:], strict=False)) for n, path in PATHS.items()}
    for n in ("straight", "two streets", "short"):
        assert kept[n] == [(0.0, pytest.approx(length[n], rel=1e-6))]
    ((low, high),) = kept["out and back"]
    assert low == 0 and 990 <= high <= 1040
    ((low, high),) = kept["turning loop"]
    assert low == 0 and 1150 <= high <= 1300  # the loop stays whole, the way back goes
    (first, second) = kept["branch in the middle"]
    assert first[0] == 0 and 990 <= first[1] <= 1040 and 1395 <= second[0] <= 1425 and second[1] == pytest.approx(length["branch in the middle"], rel=1e-6)


def test_walks_without_copies_stay_whole(spark):
    rng = random.Random(6)
    rows = []
    for line in range(4):
        x = y = 0.0
        for i in range(20):
            rows.append((line, i, x / M, y / M))
            x, y = x + rng.uniform(50, 120), y + rng.uniform(-60, 60)
    out = loops.one_copy(spark.createDataFrame(rows, "line int, seq int, lon double, lat double"), step=5.0).collect()
    assert sorted((r.line, r.part, r.low) for r in out) == [(line, 1, 0.0) for line in range(4)]


def test_lines_without_close_samples_are_not_measured(spark, monkeypatch):
    """Samples farther apart than a stretch may have gaps: no line is measured against itself; with one that has closer ones, that line is, and gives the same."""
    counts, near = [], loops.near_segments

    def counted(*args, **more):
        out = near(*args, **more)
        counts.append(args[0].select("line").distinct().count())
        return out

    monkeypatch.setattr(loops, "near_segments", counted)
    far = [(1, i, *p) for i, p in enumerate(east((0, 0), (9000, 0), (9000, 40), (0, 40)))]
    close = [(2, i, *p) for i, p in enumerate(east(*[(120 * k, 0) for k in range(60)], *[(120 * k, 40) for k in range(59, -1, -1)]))]
    kept = lambda rows: sorted(tuple(r) for r in loops.one_copy(spark.createDataFrame(rows, "line int, seq int, lon double, lat double"), 100.0, 2_000.0, 1_500.0, 3_000.0, 500.0).collect())
    alone = kept(far)
    assert [r[:2] for r in alone] == [(1, 1)] and counts == [0]
    both = kept(far + close)
    assert counts == [0, 1] and both[:1] == alone and max(r[3] for r in both if r[0] == 2) < 8_000


def test_parts_that_a_task_holds_whole_are_settled_there(spark, monkeypatch):
    """Chains and rings of neighbouring rows: only those cut by the bounds of partitions go through the rounds."""
    sent, rounds = [], loops._bridges

    def counted(edges):
        sent.append(edges.count())
        return rounds(edges)

    monkeypatch.setattr(loops, "_bridges", counted)
    rows = []
    for part in range(300):
        nodes = [10 * part + i for i in range(6)]
        rows += [(100 * part + i, u, v) for i, (u, v) in enumerate(zip(nodes, nodes[1:], strict=False))] + [(100 * part + 9, nodes[5], nodes[0])] * (part % 2)
    rows += [rows[0], rows[0]]
    got = loops.bridges(spark.createDataFrame(rows, "edge long, u long, v long").coalesce(3)).collect()
    assert {r.edge for r in got} == searched(dict.fromkeys(rows)) and len(got) == 150 * 5 and all(r.u < r.v for r in got)
    assert sum(sent) <= 60
