"""Simplified borders: neighbours share every vertex, and no gap opens."""

import random
from collections import Counter

from quillon.operators import borders

RINGS = "area int, ring int, seq int, lon double, lat double"


def wiggly(rng, a, b, n=40):
    """A border between two corners, the same for both sides."""
    out = [a]
    for i in range(1, n):
        out.append((round(a[0] + (b[0] - a[0]) * i / n + rng.uniform(-0.004, 0.004), 6), round(a[1] + (b[1] - a[1]) * i / n + rng.uniform(-0.004, 0.004), 6)))
    return [*out, b]


def shoelace(ring):
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1], strict=True)) / 2


def test_neighbours_share_every_vertex(spark):
    rng = random.Random(1)
    side = {}
    for x in range(4):
        for y in range(4):
            for d in ((1, 0), (0, 1)):
                if x + d[0] < 4 and y + d[1] < 4:
                    side[x, y, d] = wiggly(rng, (float(x), float(y)), (float(x + d[0]), float(y + d[1])))
    rings = {}
    for x in range(3):
        for y in range(3):
            path = side[x, y, (1, 0)] + side[x + 1, y, (0, 1)][1:] + side[x, y + 1, (1, 0)][::-1][1:] + side[x, y, (0, 1)][::-1][1:]
            cut = rng.randrange(len(path) - 1)
            path = path[cut:-1] + path[: cut + 1]  # begins anywhere
            rings[3 * x + y, 0] = path[::-1] if (x + y) % 2 else path
    hole = wiggly(rng, (0.4, 0.4), (0.6, 0.4), 10)[:-1] + wiggly(rng, (0.6, 0.4), (0.5, 0.6), 10)[:-1] + wiggly(rng, (0.5, 0.6), (0.4, 0.4), 10)[:-1]
    rings[0, 1], rings[9, 0] = hole, [*hole[7:], *hole[:8]][::-1]  # an enclave in area 0, closed and turned the other way
    rows = [(a, r, i, *p) for (a, r), path in rings.items() for i, p in enumerate(path)]
    out = {}
    for r in sorted(borders.simplified_borders(spark.createDataFrame(rows, RINGS), 500.0).collect(), key=lambda r: r.seq):
        out.setdefault((r.area, r.ring), []).append((r.lon, r.lat))
    assert out.keys() == rings.keys() and all(p[0] == p[-1] for p in out.values())
    edges = Counter(frozenset(e) for path in out.values() for e in zip(path, path[1:], strict=False))
    assert set(edges.values()) == {1, 2}
    # what is used once is the outer border: a single ring round all corners
    outer = [e for e, n in edges.items() if n == 1]
    assert all(n == 2 for n in Counter(p for e in outer for p in e).values()) and {(0.0, 0.0), (3.0, 3.0)} <= {p for e in outer for p in e}
    assert sum(map(len, out.values())) < 0.7 * len(rows)
    # no gap: the areas add up to what the outer border encloses
    start, path, left = (0.0, 0.0), [(0.0, 0.0)], set(outer)
    while left:
        e = next(e for e in left if path[-1] in e)
        left.remove(e)
        path.append(next(p for p in e if p != path[-1]))
    assert path[-1] == start
    total = sum(abs(shoelace(p)) for (a, r), p in out.items() if r == 0) - abs(shoelace(out[0, 1]))
    assert abs(total - abs(shoelace(path))) < 1e-9


def test_small_rings_stay(spark):
    square = [(0.0, 0.0), (0.001, 0.0), (0.001, 0.001), (0.0, 0.001)]
    rows = [(1, 0, i, *p) for i, p in enumerate(square)]
    out = borders.simplified_borders(spark.createDataFrame(rows, RINGS), 5_000.0).collect()
    assert len(out) == 5 and {(r.lon, r.lat) for r in out} == set(square)
    assert borders.simplified_borders(spark.createDataFrame([], RINGS), 10.0).count() == 0
