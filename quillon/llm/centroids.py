"""Exact k-means over whole-number vectors: float32 screening with rounding-error intervals.

A task multiplies its vectors with all centroids in float32. Each product stands in an interval that holds the true value whatever the
order of the additions was (the bound of Higham for dot products, widened for the rounding of the inputs), so the nearest centroid is
among those whose interval reaches below the lowest upper end. Where that leaves one centroid, it is nearest; where intervals overlap,
those centroids are measured again in whole numbers and the lowest number wins ties. A round is one narrow pass with a sum for each
centroid and component: what is broadcast and what comes back to the driver is k times the width, at any number of vectors.

Defined results: vectors that are null, of another width, or with a null or non-finite component take no part; repeated rows count each;
rows with a null id are clustered too but are drawn as first centroids last; equal hashes go by the vector itself; fewer vectors than k
give as many centroids; empty centroids stay where they are; an empty table gives no rows; other columns are ignored. Components of 2**62
and more, and distances or sums of them that don't fit a long, are refused with an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, release
from .topk import _matrix, finite, quantised

#: Vectors that a task screens at once, and pairs that it measures again at once.
CHUNK, PAIRS = 4096, 16_384
_UNIT = 2.0**-24
_HALF = 31


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows: int64 where they surely fit, else Python's whole numbers."""
    gap = x - c
    if not gap.size or np.abs(gap).max() < 2**28:
        return np.einsum("ij,ij->i", gap, gap)
    wide = x.astype(object) - c.astype(object)
    return (wide * wide).sum(axis=1)


def screened(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, centroid) pairs, in order, that hold every nearest centroid of each row of ``x``."""
    wide_x, wide_c = x.astype(np.float64), centroids.astype(np.float64)
    n = x.shape[1] + 4
    gamma = n * _UNIT / (1 - n * _UNIT)
    norm_x, norm_c = (np.sqrt((w * w).sum(axis=1)) * (1 + 1e-12) for w in (wide_x, wide_c))
    with np.errstate(over="ignore", invalid="ignore"):
        dots = (x.astype(np.float32) @ centroids.astype(np.float32).T).astype(np.float64)
        reach = norm_x[:, None] * norm_c[None, :]
        square = norm_c * norm_c
        about = square[None, :] - 2 * dots
        radius = 2 * gamma * reach * (1 + 1e-9) + (square[None, :] + 2 * reach) * 1e-11
        low, high = about - radius, about + radius
    unsure = ~np.isfinite(about)
    low[unsure], high[unsure] = -np.inf, np.inf
    return np.nonzero(low <= high.min(axis=1)[:, None])


def nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Number of the nearest centroid of each row; ties go to the lowest number."""
    row, at = screened(x, centroids)
    first = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
    count = np.diff(np.append(first, len(row)))
    out = at[first].astype(np.int64)
    open_ = np.flatnonzero(count > 1)
    step = max(1, PAIRS // max(1, len(centroids)))
    for k in range(0, len(open_), step):
        rows = open_[k : k + step]
        starts = np.concatenate(([0], np.cumsum(count[rows])[:-1]))
        pairs = np.arange(count[rows].sum()) + np.repeat(first[rows] - starts, count[rows])
        far = squared(x[row[pairs]], centroids[at[pairs]])
        least = np.minimum.reduceat(far, starts)
        hit = np.flatnonzero(far == np.repeat(least, count[rows]))
        owner = np.searchsorted(starts, hit, side="right") - 1
        out[rows] = at[pairs[hit[np.concatenate(([True], owner[1:] != owner[:-1]))]]]
    return out


def _chunks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, CHUNK):
            part = batch.slice(at, CHUNK)
            yield part, _matrix(part.column(1), width, np.int64)


def _sums(centroids: np.ndarray):
    """Sums of a task's vectors for each centroid and component, in two halves that cannot run over."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, width = centroids.shape
        high, low, n = np.zeros((k, width), dtype=np.int64), np.zeros((k, width), dtype=np.int64), np.zeros(k, dtype=np.int64)
        for _, x in _chunks(batches, width):
            own = nearest(x, centroids)
            order = np.argsort(own, kind="stable")
            used, first = np.unique(own[order], return_index=True)
            high[used] += np.add.reduceat(x[order] >> _HALF, first)
            low[used] += np.add.reduceat(x[order] & ((1 << _HALF) - 1), first)
            n[used] += np.diff(np.append(first, len(own)))
        c, d = (a.ravel() for a in np.indices((k, width)))
        some = np.repeat(n > 0, width)
        arrays = [c[some], d[some], high.ravel()[some], low.ravel()[some], np.repeat(n, width)[some]]
        yield pa.RecordBatch.from_arrays([pa.array(a.astype(np.int64)) for a in arrays], names=["c", "d", "high", "low", "n"])

    return run


def _assign(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in _chunks(batches, centroids.shape[1]):
            own = nearest(x, centroids)
            far = squared(x, centroids[own])
            if far.dtype == object and max(far, default=0) >= 2**63:
                raise ValueError("squared distances reach 2**63 and don't fit a long: scale the vectors down")
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(own.astype(np.int32)), pa.array(far.astype(np.int64))], names=["vec_id", "cluster", "distance"])

    return run


def moved(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round: floor of the exact mean of their vectors; those without any stay."""
    exact = lambda c: F.sum(F.col(c).cast("decimal(20,0)"))
    found = vectors.mapInArrow(lambda b, c=centroids: _sums(c)(b), "c long, d long, high long, low long, n long").groupBy("c", "d").agg(exact("high").alias("high"), exact("low").alias("low"), F.sum("n").alias("n"))
    out = centroids.copy()
    for r in found.collect():  # k times the width
        out[r.c, r.d] = ((int(r.high) << _HALF) + int(r.low)) // r.n
    return out


def drawn(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors with the smallest hashes of seed and id."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    return np.array([r.v for r in vectors.select(h.alias("h"), "v").orderBy(F.col("h").asc_nulls_last(), "v").limit(k).collect()], dtype=np.int64)


def cluster(vectors: DataFrame, k: int = 40, rounds: int = 5, width: int = 64, scale: int = 256, seed: int = 2) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every vector that takes part."""
    spark, x = vectors.sparkSession, F.col("embedding")
    rows = vectors.where(finite(x) & (F.size(x) == width)).select(F.col("vec_id").cast("long").alias("vec_id"), quantised(x, scale).alias("v"), F.array_max(F.transform(x, lambda y: F.abs(y.cast("double") * scale))).alias("top"))
    rows = materialize(rows, "centroid-vectors")
    if (rows.agg(F.max("top")).first()[0] or 0) >= 2**62:
        raise ValueError("components reach 2**62: scale the vectors down")
    vectors = rows.select("vec_id", "v")
    centroids = drawn(vectors, k, seed)
    if not len(centroids):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    for _ in range(rounds):
        centroids = moved(vectors, centroids)
    out = materialize(vectors.mapInArrow(lambda b, c=centroids: _assign(c)(b), "vec_id long, cluster int, distance long"), "clustered")
    release(rows)
    sums = {r.cluster: int(r.s) for r in out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("s")).collect()}
    total = sum(sums.values())
    if total >= 2**63:
        raise ValueError("the inertia reaches 2**63 and doesn't fit a long: scale the vectors down")
    told = [(c, s, total, hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, s in sums.items()]
    facts = spark.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")  # k rows at most
    return out.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
