"""Exact top-k inner-product search by distributed histogram selection.

Every candidate is scored against every query of a wave (a bounded set of queries, broadcast). A pass counts scores in bins for
each query; the bin that holds the k-th best becomes the next pass's range, until few enough scores stand at or above its lower
edge or it is one score wide. The last pass keeps what reaches that edge, k rows for each query and task at most, and ties go to
the smaller id. Scores are whole numbers: below 2**53 float64 products are exact, from there on they are taken in 64-bit integers (rounding
to float64 keeps their order, so the histograms still hold). Scores of 2**63 and more don't fit the result's type and are refused.
Each wave is written out before the next begins, so neither the plan nor the driver grows with the number of queries.

Defined results: null vectors and those with null or non-finite components, and rows with a null id, take no part; shorter
vectors count as filled up with zeros; repeated rows are candidates each, and rows that share a query's id are its own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

WAVE = 4096
BINS = 256
CHUNK = 2048
#: Scores at or above the edge, as a multiple of k, with which the search for the edge may end.
ENOUGH = 4


def quantised(x: Column, scale: int) -> Column:
    return F.transform(x, lambda v: F.floor(F.lit(float(scale)) * v.cast("double")))


def finite(x: Column) -> Column:
    ok = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf")))
    return x.isNotNull() & F.coalesce(F.forall(x, ok), F.lit(False))


def _matrix(values: pa.ListArray, width: int, kind: type = np.float64) -> np.ndarray:
    values = values if isinstance(values, pa.ListArray) else values.combine_chunks()
    flat = np.asarray(values.flatten()).astype(kind)
    lengths = np.asarray(values.value_lengths())
    out = np.zeros((len(lengths), width), dtype=kind)
    if len(flat) == out.size and (lengths == width).all():
        return flat.reshape(out.shape)
    rows = np.repeat(np.arange(len(lengths)), lengths)
    cols = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out[rows, cols] = flat
    return out


def _scored(batches: Iterator[pa.RecordBatch], ids: np.ndarray, queries: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(candidate ids, float64 scores: queries x candidates, exact scores) in chunks; a query's own rows score -inf."""
    row_of = np.argsort(ids, kind="stable")
    for batch in batches:
        for at in range(0, batch.num_rows, CHUNK):
            part = batch.slice(at, CHUNK)
            own = np.asarray(part.column(0), dtype=np.int64)
            exact = queries @ _matrix(part.column(1), queries.shape[1], queries.dtype.type).T
            scores = exact.astype(np.float64)
            left, right = np.searchsorted(ids[row_of], own, "left"), np.searchsorted(ids[row_of], own, "right")
            for c in np.flatnonzero(right > left):
                scores[row_of[left[c] : right[c]], c] = -np.inf
            yield own, scores, exact


def _histogram(ids, queries, low, high, width, k):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = len(ids)
        counts = np.zeros(q * BINS, dtype=np.int64)
        base = (np.arange(q) * BINS)[:, None]
        for _, scores, _ in _scored(batches, ids, queries):
            bins = np.floor((scores - low[:, None]) / width[:, None])
            inside = (bins >= 0) & (bins < BINS) & (scores < high[:, None])
            counts += np.bincount((np.where(inside, bins, 0).astype(np.int64) + base)[inside], minlength=q * BINS)
        grid = counts.reshape(q, BINS)
        above = np.cumsum(grid[:, ::-1], axis=1)[:, ::-1] - grid
        row, col = np.nonzero((grid > 0) & (above < k * ENOUGH))  # lower bins can't hold the k-th best, nor matter to the edge
        yield pa.RecordBatch.from_arrays([pa.array(row.astype(np.int64)), pa.array(col.astype(np.int64)), pa.array(grid[row, col])], names=["q", "bin", "n"])

    return run


def _survivors(ids, queries, edge, k):
    def best(q, v, s):
        order = np.lexsort((v, -s, q))
        q, v, s = q[order], v[order], s[order]
        first = np.flatnonzero(np.concatenate(([True], q[1:] != q[:-1]))) if len(q) else np.zeros(0, dtype=np.int64)
        rank = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
        return q[rank < k], v[rank < k], s[rank < k]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = (np.zeros(0, dtype=np.int64),) * 3
        for own, scores, exact in _scored(batches, ids, queries):
            row, col = np.nonzero(scores >= edge[:, None])
            held = tuple(np.concatenate((a, b)) for a, b in zip(held, (row, own[col], exact[row, col].astype(np.int64)), strict=True))
            if len(held[0]) > 4 * k * max(1, len(ids)):
                held = best(*held)
        q, v, s = best(*held)
        yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(v), pa.array(s)], names=["query_id", "vec_id", "score"])

    return run


def _edges(rows: DataFrame, ids: np.ndarray, queries: np.ndarray, norm: float, k: int) -> np.ndarray:
    """A score for each query that at least k candidates reach (or all, if fewer), and few more do."""
    spark = rows.sparkSession
    reach = np.floor(np.sqrt((queries.astype(np.float64) ** 2).sum(axis=1)) * norm * (1 + 1e-9)) + 1
    low, width = -reach, np.ceil((2 * reach + 1) / BINS)
    high = low + BINS * width  # a pass counts scores in [low, high) only: those from high on are in `above`
    above = np.zeros(len(ids), dtype=np.int64)
    edge, open_ = low.copy(), np.ones(len(ids), dtype=bool)
    while open_.any():
        at = np.flatnonzero(open_)
        shared = spark.sparkContext.broadcast((ids[at], queries[at], low[at], high[at], width[at]))
        found = rows.mapInArrow(lambda b, s=shared: _histogram(*s.value, k)(b), "q long, bin long, n long").groupBy("q", "bin").agg(F.sum("n").alias("n")).toArrow()
        grid = np.zeros((len(at), BINS), dtype=np.int64)
        grid[np.asarray(found.column(0)), np.asarray(found.column(1))] = np.asarray(found.column(2))
        total = above[at][:, None] + np.cumsum(grid[:, ::-1], axis=1)[:, ::-1]
        enough = total >= k
        bin_ = np.where(enough.any(axis=1), BINS - 1 - np.argmax(enough[:, ::-1], axis=1), 0)
        edge[at] = low[at] + bin_ * width[at]
        here = total[np.arange(len(at)), bin_]
        over = np.where(bin_ + 1 < BINS, total[np.arange(len(at)), np.minimum(bin_ + 1, BINS - 1)], above[at])
        stop = (here <= ENOUGH * k) | (width[at] <= 1) | ~enough.any(axis=1)
        edge[at[~enough.any(axis=1)]] = -np.inf  # fewer than k candidates: all of them
        above[at], low[at], high[at], width[at] = over, edge[at], edge[at] + width[at], np.ceil(width[at] / BINS)
        low[at[~np.isfinite(low[at])]] = 0
        open_[at[stop]] = False
    return np.where(np.isfinite(edge), edge, -1e300)


def search(vectors: DataFrame, k: int = 5, every: int = 50, scale: int = 256, wave: int = WAVE) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of the k best candidates of each row whose vec_id is divisible by ``every``."""
    x = F.col("embedding")
    rows = vectors.where(F.col("vec_id").isNotNull() & finite(x)).select(F.col("vec_id").cast("long").alias("vec_id"), quantised(x, scale).alias("v"))
    rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "vectors")
    square = F.aggregate("v", F.lit(0.0), lambda acc, y: acc + y.cast("double") * y.cast("double"))
    is_query = F.col("vec_id") % every == 0
    facts = rows.agg(F.max(square).alias("square"), F.max(F.size("v")).alias("width"), F.count(F.when(is_query, 1)).alias("queries")).first()
    spark, kinds = vectors.sparkSession, "query_id long, vec_id long, score long"
    norm = float(facts["square"] or 0.0) ** 0.5
    if norm**2 * (1 + 1e-9) >= 2**63:
        raise ValueError("scores reach 2**63 and don't fit a long: scale the vectors down")
    kind = np.float64 if norm**2 < 2**53 else np.int64
    waves, out = -(-facts["queries"] // wave), None
    candidates = rows.select("vec_id", "v")
    for w in range(waves):
        own = rows.where(is_query & (F.pmod(F.xxhash64("row"), F.lit(waves)) == w)).select("vec_id", "v").toArrow()
        ids = np.asarray(own.column(0), dtype=np.int64)
        if not len(ids):
            continue
        queries = _matrix(own.column(1), facts["width"], kind)
        edge = _edges(candidates, ids, queries, norm, k)
        shared = spark.sparkContext.broadcast((ids, queries, edge))
        found = candidates.mapInArrow(lambda b, s=shared: _survivors(*s.value, k)(b), kinds)
        out = found if waves == 1 else materialize(found, "best", out)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    out = spark.createDataFrame([], kinds) if out is None else out
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
