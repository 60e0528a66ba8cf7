"""Removal of long repeated passages by prefix-free parsing.

A byte goes if it is covered by a ``length``-byte string that starts anywhere else in the corpus. The corpus is parsed as in
prefix-free parsing: a rolling hash picks trigger positions by content, here the leftmost least k-gram hash of every window, so
equal strings pick equal triggers and every string of ``length`` bytes holds one. All strings with one trigger form a phrase;
neighbouring phrases overlap by length - 1 bytes, so each such string is the ``length``-byte prefix of exactly one suffix of one
phrase. As only common prefixes of ``length`` bytes matter, suffixes are ordered to that depth only, by classes of equal hashes:

1. phrases (the dictionary) are counted by all their bytes; one found twice has all its suffixes repeated;
2. of the others, only those whose core (the bytes that all their strings share) is repeated can hold a repeated string;
   their suffixes are split into blocks of BLOCK and these are judged alike;
3. blocks still open are split into single strings, which are compared by two independent 64-bit hashes.

Every step is one shuffle of fixed-width rows, and each task first merges equal keys, so a passage in a third of all documents
sends a row for each batch only. Texts are read in pieces of PIECE strings, so memory doesn't grow with a text.

Defined results: a null text is empty; a repeated row counts as another place, so both lose what they share; rows of equal id and text
get equal rows; an empty table gives no rows; other columns are ignored; a text shorter than ``length`` stays whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, materialize, text_of

LENGTH = 400
REACH = 192  # window of the trigger search
GRAM = 16
BLOCK = 16
PIECE = 1 << 20
CHUNK_BYTES = 2 << 20
ROWS = "core long, outer long, doc_id long, h long, tag long, info int"


@lru_cache(maxsize=4)
def _tables(seed: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Random values of bytes, powers of an odd base and their inverses (mod 2**64)."""
    rng = np.random.default_rng(seed)
    values = rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    base = int(rng.integers(2**61, 2**63)) * 2 + 1
    powers, inverse = np.full(size, base, dtype=np.uint64), np.full(size, pow(base, -1, 2**64), dtype=np.uint64)
    powers[0] = inverse[0] = 1
    return values, np.multiply.accumulate(powers), np.multiply.accumulate(inverse)


class Hasher:
    """Hashes of any stretch of a buffer from prefix sums."""

    def __init__(self, buffer: np.ndarray, seed: int = 1):
        size = 1 << max(16, (len(buffer) + 1).bit_length())
        values, powers, self.inverse = _tables(seed, size)
        self.sums = np.zeros(len(buffer) + 1, dtype=np.uint64)
        np.cumsum(values[buffer] * powers[: len(buffer)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = (self.sums[end] - self.sums[start]) * self.inverse[start]
        return _mixed(h)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def tag_of(low: np.ndarray, high: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """One number for a run of strings: first start, last start, trigger."""
    return (low.astype(np.int64) << 20) | ((high - low).astype(np.int64) << 10) | (anchor - low).astype(np.int64)


def untag(tag: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    low = tag >> 20
    return low, low + ((tag >> 10) & 1023), low + (tag & 1023)


def phrases(buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray, hasher: Hasher, length: int, reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first start, last start, trigger) of each phrase of the pieces buffer[starts:ends], in order."""
    none = np.zeros(0, dtype=np.int64)
    counts = np.maximum(ends - starts - length + 1, 0)
    if not counts.sum():
        return none, none, none
    n = len(buffer) - GRAM + 1
    at = np.arange(n, dtype=np.int64)
    key = (hasher.of(at, at + GRAM) & np.uint64(0xFFFFFFFF00000000)) | at.astype(np.uint64)  # the same order in every buffer
    span = 1
    while span * 2 <= reach:
        key = np.minimum(key[:-span], key[span:])
        span *= 2
    if span < reach:
        key = np.minimum(key[: len(key) - (reach - span)], key[reach - span :])
    first = np.cumsum(counts) - counts
    places = np.arange(counts.sum()) - np.repeat(first - starts, counts)
    anchor = (key[places] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
    last = np.append(new[1:], len(places)) - 1
    return places[new], places[last], anchor[new]


def split(low: np.ndarray, high: np.ndarray, anchor: np.ndarray, step: int) -> tuple[np.ndarray, ...]:
    """Runs cut into blocks of ``step`` starts, counted back from the trigger: (run, first, last, trigger, block number)."""
    near, far = (anchor - high) // step, (anchor - low) // step
    counts = far - near + 1
    run = np.repeat(np.arange(len(low)), counts)
    block = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + near[run]
    a = anchor[run]
    return run, np.maximum(low[run], a - step * block - step + 1), np.minimum(high[run], a - step * block), a, block


def merged(core: np.ndarray, outer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys to count, info) after merging equal keys of a task.

    info: kind + 4 * core count + 16 * outer count (counts of 2 or more are 2) + 64 if the core has several outers. Kind 0 goes to
    the global count; 1 is known to be repeated, 2 known to have a repeated core, 3 both, and it stands for its equals when strings
    of other runs with that core are compared. Kinds 1 to 3 get keys of their own, so that they don't meet in one task.
    """
    if not len(core):
        return core, np.zeros(0, dtype=np.int32)
    order = np.lexsort((outer, core))
    c, o = core[order], outer[order]
    new_core = np.concatenate(([True], c[1:] != c[:-1]))
    new_both = new_core | np.concatenate(([True], o[1:] != o[:-1]))
    size = lambda new: np.minimum(np.diff(np.append(np.flatnonzero(new), len(new))), 2)[np.cumsum(new) - 1]
    n_core, n_both = size(new_core), size(new_both)
    group = np.cumsum(new_core) - 1
    several = (np.bincount(group[new_both]) > 1)[group]
    kind = np.where(new_core, 0, np.where(n_both > 1, np.where(new_both & several, 3, 1), 2))
    info = np.empty(len(core), dtype=np.int32)
    info[order] = kind + 4 * n_core + 16 * n_both + 64 * several
    own = _mixed(core + np.arange(1, len(core) + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return np.where((info & 3) > 0, own, core), info


def _pieces(batch: pa.RecordBatch, column: int, length: int, piece: int) -> Iterator[list[tuple[int, int, np.ndarray]]]:
    """Lists of (row, offset in its text, bytes) of at most CHUNK_BYTES or one piece."""
    values = batch.column(column)
    offsets = np.frombuffer(values.buffers()[1], dtype=np.int32)[values.offset : values.offset + len(values) + 1]
    data = np.frombuffer(values.buffers()[2] or b"", dtype=np.uint8)
    out: list[tuple[int, int, np.ndarray]] = []
    size = 0
    for row, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        for at in range(0, max(1, b - a - length + 1), piece):
            part = data[a + at : min(b, a + at + piece + length - 1)]
            if out and size + len(part) > CHUNK_BYTES:
                yield out
                out, size = [], 0
            out.append((row, at, part))
            size += len(part)
    if out:
        yield out


def _rows(core, outer, docs, hashes, tags) -> pa.RecordBatch:
    core, info = merged(core, outer)
    arrays = [pa.array(core.view(np.int64)), pa.array(outer.view(np.int64)), docs, pa.array(hashes), pa.array(tags), pa.array(info)]
    return pa.RecordBatch.from_arrays(arrays, names=[c.split()[0] for c in ROWS.split(", ")])


def _parse(length: int, reach: int, piece: int):
    """Rows of all phrases of (doc_id, h, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple[np.ndarray, ...]] = []
            h = np.asarray(batch.column(1))
            for pieces in _pieces(batch, 2, length, piece):
                pieces = [p for p in pieces if len(p[2]) >= length]
                if not pieces:
                    continue
                buffer = np.concatenate([p[2] for p in pieces])
                ends = np.cumsum([len(p[2]) for p in pieces])
                starts = ends - [len(p[2]) for p in pieces]
                hasher = Hasher(buffer)
                low, high, anchor = phrases(buffer, starts, ends, hasher, length, reach)
                of = np.searchsorted(starts, low, side="right") - 1
                shift = np.array([p[1] for p in pieces])[of] - starts[of]
                outer = _mixed(hasher.of(low, high + length) + (high - low).astype(np.uint64) * np.uint64(1024) + (anchor - low).astype(np.uint64))
                row = np.array([p[0] for p in pieces])[of]
                found.append((hasher.of(anchor, anchor + length + 1 - reach), outer, row, tag_of(low + shift, high + shift, anchor + shift)))
            if found:
                core, outer, row, tag = (np.concatenate(x) for x in zip(*found, strict=True))
                yield _rows(core, outer, batch.column(0).take(pa.array(row)), h[row], tag)

    return run


def _refine(length: int, step: int, piece: int):
    """Rows of the blocks of the runs that are still open: (doc_id, h, text, tags)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple[np.ndarray, ...]] = []
            h = np.asarray(batch.column(1))
            lists = batch.column(3)
            for pieces in _pieces(batch, 2, length, piece):
                for row, at, data in pieces:
                    low, high, anchor = untag(np.sort(np.asarray(lists[row].values)))
                    here = (low >= at) & (low < at + piece)
                    if not here.any():
                        continue
                    hasher = Hasher(data)
                    _, first, last, a, block = split(low[here] - at, high[here] - at, anchor[here] - at, step)
                    core = hasher.of(a - step * block, a - step * block - step + 1 + length)
                    second = Hasher(data, 2) if step == 1 else hasher
                    outer = _mixed(second.of(first, last + length) + (last - first).astype(np.uint64) * np.uint64(1024) + (a - first).astype(np.uint64) * np.uint64(step > 1))
                    found.append((core, outer, np.full(len(a), row), tag_of(first + at, last + at, np.maximum(a, first) + at)))
            if found:
                core, outer, row, tag = (np.concatenate(x) for x in zip(*found, strict=True))
                for cut in range(0, len(core), 1 << 20):
                    part = slice(cut, cut + (1 << 20))
                    yield _rows(core[part], outer[part], batch.column(0).take(pa.array(row[part])), h[row[part]], tag[part])

    return run


def _judged(rows: DataFrame, label: str) -> DataFrame:
    """doc_id, h, tag, whole (all strings of the run are repeated) and open (its strings must be compared) of the runs that aren't unique.

    A whole run is open too, once for all its equals, if other runs share its core: their strings may be equal to some of its.
    """
    kind, zero = F.col("info").bitwiseAND(3), F.col("info").bitwiseAND(3) == 0
    core, same = Window.partitionBy("core"), Window.partitionBy("core", "outer")
    rows = rows.repartition("core")  # serves both windows
    seen = rows.withColumn("turn", F.row_number().over(same.orderBy("doc_id", "h", "tag")))
    seen = seen.withColumn("n_both", F.sum(F.when(zero, F.shiftright("info", 4).bitwiseAND(3)).otherwise(0)).over(same))
    seen = seen.withColumns({
        "n_core": F.sum(F.when(zero, F.shiftright("info", 2).bitwiseAND(3)).otherwise(0)).over(core),
        "several": (F.max(F.shiftright("info", 6)).over(core) > 0) | (F.min("outer").over(core) != F.max("outer").over(core)),
    })
    kept = seen.where((kind > 0) | (F.col("n_core") > 1))
    whole = kind.isin(1, 3) | (zero & (F.col("n_both") > 1))
    open_ = kind.isin(2, 3) | (zero & ((F.col("n_both") < 2) | (F.col("several") & (F.col("turn") == 1))))
    return materialize(kept.select("doc_id", "h", "tag", whole.alias("whole"), open_.alias("open")), label)


def _with_lists(texts: DataFrame, lists: DataFrame, n_bytes: int, how: str) -> DataFrame:
    """Texts with the lists (doc_id, h, tags) of their runs. Few (by measured size) are broadcast, many are shuffled."""
    lists = lists.withColumnsRenamed({"doc_id": "t_doc", "h": "t_h"})
    lists = F.broadcast(lists) if n_bytes <= BROADCAST_BYTES else lists.hint("merge")
    return texts.join(lists, F.col("doc_id").eqNullSafe(F.col("t_doc")) & (F.col("h") == F.col("t_h")), how).select("doc_id", "h", "text", "tags")


def _listed(runs: DataFrame) -> DataFrame:
    return runs.groupBy("doc_id", "h").agg(F.collect_list("tag").alias("tags"))


def _united(length: int):
    """Runs of a text to its maximal removed stretches: start, end, start, ..."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for tags in batch.column(2):
                low, high, _ = untag(np.sort(np.asarray(tags.values)))
                reach = np.maximum.accumulate(high + length)
                new = np.flatnonzero(np.concatenate(([True], low[1:] > reach[:-1])))
                out.append(np.stack((low[new], reach[np.append(new[1:], len(low)) - 1]), axis=1).reshape(-1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.int64()))], names=["doc_id", "h", "tags"])

    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[list] = [[] for _ in range(4)]
        lists = batch.column(3).to_pylist()
        for data, bounds in zip(batch.column(2), lists, strict=True):
            raw = data.as_buffer()
            view, digest, at = memoryview(raw), hashlib.sha256(), 0
            bounds = bounds or []
            for a, b in zip(bounds[::2], bounds[1::2], strict=True):
                digest.update(view[at:a])
                at = b
            digest.update(view[at:])
            for o, v in zip(out, (raw.size, sum(bounds[1::2]) - sum(bounds[::2]), len(bounds) // 2, digest.hexdigest()), strict=True):
                o.append(v)
        kinds = [pa.int64()] * 3 + [pa.string()]
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(o, k) for o, k in zip(out, kinds, strict=True))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def repeated_stretches(docs: DataFrame, length: int = LENGTH, reach: int = REACH, piece: int = PIECE) -> tuple[DataFrame, DataFrame]:
    """(texts with their row key, doc_id, h, tags: bounds of the stretches to remove)."""
    if not GRAM + reach - 1 <= length or reach > 512:
        raise ValueError("the trigger window must lie within a string, and be 512 at most")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().cast("binary").alias("text")).select("doc_id", F.crc32("text").alias("h"), "text")
    whole, found, label = None, texts.mapInArrow(_parse(length, reach, piece), ROWS), "phrases"
    for step in (BLOCK, 1, 0):
        judged = _judged(found, label)
        part = judged.where("whole").select("doc_id", "h", "tag")
        whole = part if whole is None else whole.unionByName(part)
        if step:
            open_ = judged.where("open")
            found, label = _with_lists(texts, _listed(open_), open_.count() * 24, "inner").mapInArrow(_refine(length, step, piece), ROWS), f"strings{step}"
    return texts, materialize(_listed(whole).mapInArrow(_united(length), "doc_id long, h long, tags array<long>"), "stretches")


def remove_repeats(docs: DataFrame, length: int = LENGTH, reach: int = REACH, piece: int = PIECE) -> DataFrame:
    """For each document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    texts, stretches = repeated_stretches(docs, length, reach, piece)
    size = stretches.agg(F.sum(F.size("tags") * 8 + 32)).first()[0] or 0
    return _with_lists(texts, stretches, size, "left").mapInArrow(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
