"""Centroid clustering against plain Python; screening against exact distances on ties and near ties."""

import hashlib
import math
import random

import numpy as np
import pytest

from quillon.llm import centroids


def brute(rows, k, rounds, width, scale=256, seed=2):
    kept = [(i, [math.floor(scale * y) for y in v]) for i, v in rows if v is not None and len(v) == width and all(y is not None and math.isfinite(y) for y in v)]
    key = lambda r: ((1, "") if r[0] is None else (0, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest()), r[1])
    c = [v for _, v in sorted(kept, key=key)[:k]]
    far = lambda a, b: sum((p - q) ** 2 for p, q in zip(a, b, strict=True))
    near = lambda v: min(range(len(c)), key=lambda j: (far(v, c[j]), j))
    for _ in range(rounds):
        own = [near(v) for _, v in kept]
        for j in range(len(c)):
            mine = [v for (_, v), o in zip(kept, own, strict=True) if o == j]
            if mine:
                c[j] = [sum(col) // len(mine) for col in zip(*mine, strict=True)]
    own = [near(v) for _, v in kept]
    dist = [far(v, c[o]) for (_, v), o in zip(kept, own, strict=True)]
    sums = {j: sum(d for d, o in zip(dist, own, strict=True) if o == j) for j in set(own)}
    return sorted(((i, o, d, sums[o], sum(dist), hashlib.sha256(",".join(map(str, c[o])).encode()).hexdigest()) for (i, _), o, d in zip(kept, own, dist, strict=True)), key=str)


@pytest.mark.parametrize("scale", [1.0, 1e-3, 1e5])
def test_clusters_equal_plain_rounds(spark, scale):
    rng = random.Random(5)
    rows = [(i, [rng.gauss(i % 7, 1) * scale for _ in range(8)]) for i in range(300)]
    rows += [(1000 + i, rows[0][1]) for i in range(40)] + [(3, rows[5][1]), (None, rows[6][1]), (None, rows[7][1])]
    rows += [(7, None), (8, [1.0] * 7), (9, [1.0] * 7 + [None]), (10, [float("nan")] * 8), (11, [float("inf")] + [0.0] * 7), (12, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "'x' AS cluster", "1 AS v")
    got = centroids.cluster(df, k=12, rounds=3, width=8).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows, 12, 3, 8)


def test_few_and_no_vectors(spark):
    kind = "vec_id long, embedding array<float>"
    assert centroids.cluster(spark.createDataFrame([], kind)).collect() == []
    few = [(i, [float(i)] * 64) for i in range(3)]
    got = sorted(tuple(r) for r in centroids.cluster(spark.createDataFrame(few, kind)).collect())
    assert got == brute(few, 40, 5, 64) and [r[2] for r in got] == [0, 0, 0]
    with pytest.raises(ValueError, match="2\\*\\*62"):
        centroids.cluster(spark.createDataFrame([(1, [1e30] * 64)], kind))


@pytest.mark.parametrize("shift", [0, 10**6, 2**40, 2**61])
def test_screening_never_loses_the_nearest(shift):
    """Centroids a unit apart far from the origin can't be told apart in float32: the interval must keep them all."""
    rng = np.random.default_rng(1)
    base = rng.integers(-3, 4, (30, 16)) + shift
    c = np.concatenate((base, base[:5], base[:10] + 1))
    x = np.concatenate((base + rng.integers(-1, 2, base.shape), base))
    want = [min(range(len(c)), key=lambda j, v=v: (sum((int(p) - int(q)) ** 2 for p, q in zip(v, c[j], strict=True)), j)) for v in x]
    assert centroids.nearest(x, c).tolist() == want
    row, at = centroids.screened(x, c)
    assert all(w in set(at[row == i]) for i, w in enumerate(want))
    apart = rng.normal(0, 1000, (9, 16)).astype(np.int64)
    row, _ = centroids.screened(apart + 1, apart)
    assert shift or len(row) == 9  # far apart: one candidate each
