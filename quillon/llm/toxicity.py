"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Unigrams, bigrams and one-word skip-grams of a text are hashed to buckets, and so are the first four and five letters of its words, for
inflected forms that training hasn't met; each counts once. Training visits a bounded sample of
labelled rows on the driver with per-coordinate rates and L1 sparsity, so the weights left over are few and are broadcast as two
short arrays. Scoring is a narrow pass over whole texts.

Labels of rows in the held-out fold (crc32 of the id as text, mod 3 = 1) are never read for training. SAMPLE bounds the labelled rows
that are fitted (those with the smallest hashes of their ids); everything else covers all documents.

Defined results: null and empty texts get the model's bias; rows with a null label aren't trained on; of several labels of an id the larger
counts, and of several texts the least; repeated rows score alike; an
empty label table gives the score 0.5 to all; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of

BITS = 20
SAMPLE = 8_000
_WORD = re.compile(r"[^\W_]+")
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


class WordHash(dict):
    """A bounded cache of word hashes."""

    def __missing__(self, word: str) -> int:
        if len(self) > 400_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


class StemHash(dict):
    """A bounded cache of words: the hashes of the word and of its first four and five letters, as bytes."""

    def __missing__(self, word: str) -> bytes:
        if len(self) > 400_000:
            self.clear()
        h = [xxhash.xxh64_intdigest(word), xxhash.xxh64_intdigest(word[:4], seed=4), xxhash.xxh64_intdigest(word[:5], seed=5)]
        out = self[word] = np.array(h, dtype=np.uint64).tobytes()
        return out


def buckets(text: str, hashes: StemHash, bits: int = BITS) -> np.ndarray:
    """The distinct buckets of a text's unigrams, bigrams, skip-grams and word beginnings."""
    words = _WORD.findall(text.lower())
    if not words:
        return np.zeros(0, dtype=np.int64)
    found = np.frombuffer(b"".join(map(hashes.__getitem__, words)), dtype=np.uint64).reshape(-1, 3)
    h = found[:, 0]
    grams = np.concatenate((h * _A, (h[:-1] * _B) ^ (h[1:] * _A), (h[:-2] * _C) ^ (h[2:] * _A) ^ _B, found[:, 1] * _A, found[:, 2] * _A))
    grams ^= grams >> np.uint64(29)
    return np.unique((grams * _A) >> np.uint64(64 - bits)).astype(np.int64)


def fit(examples: list[tuple[np.ndarray, int]], bits: int = BITS, alpha: float = 2.0, beta: float = 1.0, l1: float = 0.155, l2: float = 0.1, epochs: int = 6, seed: int = 5) -> tuple[np.ndarray, np.ndarray, float]:
    """FTRL-proximal: (bucket numbers, their weights, bias). The L1 bound is ``l1`` times the root of the number of examples."""
    size = 1 << bits
    z, n = np.zeros(size + 1), np.zeros(size + 1)
    if not examples:
        return np.zeros(0, dtype=np.int64), np.zeros(0), 0.0

    def weights(i: np.ndarray) -> np.ndarray:
        zi = z[i]
        w = (np.sign(zi) * l1 - zi) / ((beta + np.sqrt(n[i])) / alpha + l2)
        return np.where(np.abs(zi) <= l1, 0.0, w)

    l1 *= len(examples) ** 0.5
    rng = np.random.default_rng(seed)
    with_bias = [(np.append(i, np.int32(size)), y) for i, y in examples]
    for _ in range(epochs):
        for at in rng.permutation(len(with_bias)):
            i, y = with_bias[at]
            w = weights(i)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -30, 30))) - y
            sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha
            z[i] += g - sigma * w
            n[i] += g * g
    every = np.arange(size + 1)
    w = weights(every)
    used = np.flatnonzero(w[:size])
    return used, w[used], float(w[size])


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 3


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, float]:
    chosen = (
        labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (fold(F.col("doc_id")) != 1))
        .groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    )
    rows = docs.select("doc_id", text_of().alias("text")).join(F.broadcast(chosen), "doc_id")
    rows = rows.groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))  # one row for each id, so that the sample's bound holds

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = StemHash()
        for batch in batches:
            found = [buckets(t, hashes, bits).astype(np.int32) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([f.tobytes() for f in found], pa.binary())], names=["doc_id", "toxic", "found"])

    got = rows.select("doc_id", "text", "toxic").mapInArrow(hashed, "doc_id long, toxic int, found binary").toArrow()
    data = sorted(zip(got.column(0).to_pylist(), got.column(1).to_pylist(), got.column(2).to_pylist(), strict=True))
    return fit([(np.frombuffer(f, dtype=np.int32), y) for _, y, f in data], bits)


def _scorer(used: np.ndarray, values: np.ndarray, bias: float, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, weights = StemHash(), np.zeros(1 << bits)
        weights[used] = values
        for batch in batches:
            logits = np.array([bias + weights[buckets(t, hashes, bits)].sum() for t in batch.column(1).to_pylist()], dtype=np.float64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(logits, -30, 30))))], names=["doc_id", "score"])

    return run


def score(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, sample: int = SAMPLE, bits: int = BITS) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    used, values, bias = train(docs, labels, sample, bits)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    out = rows.mapInArrow(_scorer(used, values, bias, bits), "doc_id long, score double")
    return out.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
