"""Language-model scores by a weighted backoff automaton over n-gram counts of the whole corpus.

Model: n-grams of words with Dirichlet smoothing, p(w|h) = (c(hw) + m p(w|h')) / (c(h) + m), where h' is h without its first word; at the
bottom stands the add-half unigram, which keeps a share for unknown words, so probabilities sum to one. As an automaton: states are the
contexts met in training, each seen n-gram is an arc with the smoothed log-probability, and each state has a failure arc, weighted
log10(m / (c(h) + m)), to the state of the shorter context. A text is read once from left to right: an arc is taken where there is one,
else the failure arc first.

How it is spread out: a task cuts its documents into blocks of a few megabytes, hashes their words in numpy and writes each block as numbers
into a word list of its own. Each block sends the distinct n-grams that it holds, with their counts in training rows, once to buckets
by hash; a bucket sums them over all blocks and answers with totals in the order of the question, so keys travel one way only. A block then
has the part of the automaton that its texts can reach, with the counts of the whole corpus, and traverses it. Nothing is broadcast and
nothing but two totals reaches the driver; a common word costs one key a block, so no key is hot. Words are told apart by 62-bit hashes,
longer n-grams by as many bits as leave about one in 2**SPARE of them a hash that another has, at any size of the corpus (62 at most).

Defined results: null texts are empty and have one token, the end; rows with a null id are not held out, so they are learned from; repeated rows
count and are scored each; without training rows every word has probability one; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import give_back, materialize, release, text_of

#: Longest n-gram, and the weight m of the shorter context for contexts of one word and of two (chosen on a fold that is neither trained on nor held out).
ORDER = 3
WEIGHTS = (1000.0, 10.0)
#: Bytes of text in a block, bytes hashed at once, n-grams of a bucket, tokens of a lane of the traversal.
BLOCK, SLICE, BUCKET, LANE = 8_000_000, 1 << 20, 6_000_000, 512
SPARE = 20
BLOCKS = "block long, doc_ids array<long>, held array<boolean>, lengths array<int>, words binary, ids binary, n long"
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"

_rng = np.random.default_rng(20_240)
_BASE = int(_rng.integers(1 << 40, 1 << 62)) * 8 + 5
_BYTE = _rng.integers(1, 1 << 63, 256).astype(np.uint64)
_BYTE[ord("A") : ord("Z") + 1] = _BYTE[ord("a") : ord("z") + 1]
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mixed(h: np.ndarray, order: int, bits: int = 62) -> np.ndarray:
    """The order of the n-gram in the two highest bits, below it the first ``bits`` of its hash, well mixed."""
    h = (h ^ (h >> np.uint64(32))) * _A
    h = (h ^ (h >> np.uint64(29))) * _B
    h = (h ^ (h >> np.uint64(32))) >> np.uint64(64 - bits)
    return (h << np.uint64(62 - bits)) | np.uint64(order << 62)


def _distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct values in order, how often each comes), by sorting."""
    values = np.sort(values)
    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(values)), dtype=bool), values[1:] != values[:-1])))
    return values[first], np.diff(np.append(first, len(values)))


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each key, by the first bits of its hash."""
    return ((((keys << np.uint64(2)) >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)


END, BEGIN = _mixed(np.array([1, 2], dtype=np.uint64), 1)


class Powers:
    """Powers of the base and of its inverse modulo 2**64, as far as needed."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, SLICE)
            for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
                full = np.full(size, base & (2**64 - 1), dtype=np.uint64)
                full[0] = 1
                setattr(self, name, np.multiply.accumulate(full))
        return self.up, self.down


def tokens(data: np.ndarray, ends: np.ndarray, powers: Powers) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all tokens, tokens of each document): the words of each document, lower-cased, then END. ``ends``: of documents in ``data``."""
    starts = np.concatenate(([0], ends[:-1])).astype(np.int64)
    word = ~_BLANK[data]
    before, after = np.concatenate(([False], word[:-1])) if len(word) else word, np.concatenate((word[1:], [False])) if len(word) else word
    full = ends > starts
    before[starts[full]] = False
    after[ends[full] - 1] = False
    first, last = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1
    h = np.empty(len(first), dtype=np.uint64)
    k = 0
    while k < len(first):
        at = int(first[k])
        to = max(k + 1, int(np.searchsorted(last, at + SLICE, side="right")))
        piece = data[at : int(last[to - 1])]
        up, down = powers.upto(len(piece))
        sums = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(_BYTE[piece] * up[: len(piece)])))
        h[k:to] = (sums[last[k:to] - at] - sums[first[k:to] - at]) * down[first[k:to] - at]
        k = to
    own = np.searchsorted(first, ends) - np.searchsorted(first, starts)
    out = np.full(len(h) + len(ends), END, dtype=np.uint64)
    out[np.arange(len(h)) + np.repeat(np.arange(len(ends)), own)] = _mixed(h, 1)
    return out, own + 1


def packed(values: np.ndarray) -> bytes:
    """Whole numbers by byte planes, compressed: planes of leading zeros vanish."""
    raw = np.ascontiguousarray(values.astype(np.uint64).view(np.uint8).reshape(-1, 8).T).tobytes()
    return len(values).to_bytes(8, "little") + (pa.compress(raw, codec="zstd", asbytes=True) if raw else b"")


def unpacked(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    if not n:
        return np.zeros(0, dtype=np.uint64)
    raw = pa.decompress(data[8:], decompressed_size=8 * n, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, dtype=np.uint8).reshape(8, n).T).view(np.uint64).reshape(n)


def _gaps(ordered: np.ndarray) -> np.ndarray:
    return np.diff(ordered, prepend=np.uint64(0))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    powers, seq, part = Powers(), 0, TaskContext.get().partitionId()
    for batch in batches:
        texts = batch.column(1)
        sizes = np.diff(np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1])
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(np.cumsum(sizes[at:]), BLOCK, side="right")) + at)
            text = texts.slice(at, to - at)
            bounds = np.frombuffer(text.buffers()[1], dtype=np.int32)[text.offset : text.offset + len(text) + 1]
            data = np.frombuffer(text.buffers()[2] or b"", dtype=np.uint8)[bounds[0] : bounds[-1]]
            h, lengths = tokens(data, bounds[1:].astype(np.int64) - int(bounds[0]), powers)
            words, ids = np.unique(h, return_inverse=True)
            cells = [pa.array([(part << 32) + seq]), pa.array([batch.column(0).slice(at, to - at).to_pylist()], pa.list_(pa.int64())), pa.array([batch.column(2).slice(at, to - at).to_pylist()], pa.list_(pa.bool_()))]
            cells += [pa.array([lengths.astype(np.int32)], pa.list_(pa.int32())), pa.array([packed(_gaps(words))], pa.binary()), pa.array([packed(ids)], pa.binary()), pa.array([len(h)], pa.int64())]
            yield pa.RecordBatch.from_arrays(cells, names=["block", "doc_ids", "held", "lengths", "words", "ids", "n"])
            at, seq = to, seq + 1
    give_back()


def grams(words: np.ndarray, ids: np.ndarray, lengths: np.ndarray, bits: int = 62) -> list[np.ndarray]:
    """Keys of the n-grams of order 1, 2, ... that end at each token; from order 3 on, 0 where the document is too short before it."""
    begin = np.cumsum(lengths) - lengths
    out = [words[ids]]
    place = np.arange(len(ids)) - np.repeat(begin, lengths)
    for order in range(2, ORDER + 1):
        before = np.concatenate((np.zeros(1, dtype=np.uint64), out[-1][:-1]))
        if order == 2:
            before[begin] = BEGIN
        key = _mixed(before * _B + out[0], order, bits)
        key[place < order - 2] = 0
        out.append(key)
    return out


def _parts(columns: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.cumsum(unpacked(columns["words"]), dtype=np.uint64), unpacked(columns["ids"]).astype(np.int64), np.asarray(columns["lengths"], dtype=np.int64)


def _asked(buckets: int, bits: int):
    """A row for each bucket that a block has n-grams for: their keys in order, and their counts in the block's training rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                words, ids, lengths = _parts(row)
                found = grams(words, ids, lengths, bits)
                held = np.repeat(np.array(row["held"], dtype=bool), lengths)
                keys = _distinct(np.concatenate(found))[0]
                learned, times = _distinct(np.concatenate([g[~held] for g in found]))
                counts = np.zeros(len(keys), dtype=np.int64)
                counts[np.searchsorted(keys, learned)] = times
                if len(keys) and keys[0] == 0:
                    keys, counts = keys[1:], counts[1:]
                bucket = _bucket(keys, buckets)
                by = np.argsort(bucket, kind="stable")  # by bucket, then as the keys stand
                bucket, keys, counts = bucket[by], keys[by], counts[by]
                cut = np.append(np.flatnonzero(np.diff(bucket, prepend=-1)), len(keys))
                pieces = list(zip(cut[:-1], cut[1:], strict=True))
                for k in range(0, len(pieces), 64):
                    some = pieces[k : k + 64]
                    cells = [pa.array([int(bucket[a]) for a, _ in some]), pa.array([row["block"]] * len(some), pa.int64())]
                    cells += [pa.array([packed(_gaps(keys[a:b])) for a, b in some], pa.binary()), pa.array([packed(counts[a:b]) for a, b in some], pa.binary())]
                    yield pa.RecordBatch.from_arrays(cells, names=["bucket", "block", "keys", "counts"])
        give_back()

    return run


def _answered(asked: pa.Table) -> pa.Table:
    """The totals of a bucket, for each block that asked; its training tokens and distinct words stand in the first row."""
    keys = [np.cumsum(unpacked(k), dtype=np.uint64) for k in asked.column("keys").to_pylist()]
    counts = [unpacked(c) for c in asked.column("counts").to_pylist()]
    ends = np.cumsum([len(k) for k in keys])
    known, which = np.unique(np.concatenate(keys), return_inverse=True)  # sorts: the inverse is asked for
    total = np.zeros(len(known), dtype=np.int64)
    for k, (n, own) in enumerate(zip(ends, counts, strict=True)):
        total[which[n - len(own) : n]] += own.astype(np.int64)  # keys of one piece are distinct
        keys[k] = None
    words = total[known >> np.uint64(62) == 1]
    replies = [packed(total[which[n - len(own) : n]]) for n, own in zip(ends, counts, strict=True)]
    first = np.arange(len(replies)) == 0
    cells = [asked.column("block").combine_chunks(), asked.column("bucket").combine_chunks(), pa.array(replies, pa.binary()), pa.array(np.where(first, words.sum(), 0)), pa.array(np.where(first, (words > 0).sum(), 0))]
    return pa.Table.from_arrays(cells, names=["block", "bucket", "totals", "tokens", "types"])


def automaton(keys: np.ndarray, at: list[np.ndarray], begin: np.ndarray, totals: np.ndarray, n: int, v: int) -> tuple[list[np.ndarray], list[np.ndarray], list[np.ndarray]]:
    """(seen, arc, fail) for each order and token: whether the n-gram that ends there was met in training, the log-probability of its arc, and the
    weight of the failure arc of the state that it is as a context. ``at``: indices into ``keys`` of the n-grams of each order; ``begin``: first tokens of documents."""
    unigram = (totals + 0.5) / (n + 0.5 * (v + 1))
    prob = unigram.copy()
    end = int(np.searchsorted(keys, END))
    for order in range(2, len(at) + 1):
        grams_, first = np.arange(len(keys) + 1), np.full(len(keys) + 1, -1)
        first[at[order - 1]] = np.arange(len(at[0]))  # any place where the n-gram stands
        grams_ = grams_[first >= 0]
        first = first[grams_]
        ok = (grams_ < len(keys)) & (totals[np.minimum(grams_, len(keys) - 1)] > 0)
        grams_, first = grams_[ok], first[ok]
        context = at[order - 2][first - 1]
        if order == 2:
            starts = np.zeros(len(at[0]), dtype=bool)
            starts[begin] = True
            context = np.where(starts[first], end, context)  # as many texts begin as end
        m = WEIGHTS[min(order, len(WEIGHTS) + 1) - 2]
        prob[grams_] = (totals[grams_] + m * prob[at[order - 2][first]]) / (totals[context] + m)
    log, met = np.append(np.log10(prob), 0.0), np.append(totals > 0, False)
    fails = [np.append(np.log10(m / (totals + m)), 0.0) for m in WEIGHTS]
    return [met[a] for a in at], [log[a] for a in at], [f[a] for f, a in zip(fails, at, strict=False)]


def traverse(seen: list[np.ndarray], arc: list[np.ndarray], fail: list[np.ndarray], start_fail: float, started: bool, lengths: np.ndarray) -> np.ndarray:
    """The log-probability of each document: one pass from left to right that carries the state, as the length of its context.

    Documents are read side by side, long ones in lanes of LANE tokens. A lane within a document reads the words before it first, from the
    empty state and without counting them: the state holds no more than those. ``start_fail``: the failure arc of the state at the
    beginning of a text; ``started``: whether there is that state.
    """
    top = len(arc) - 1
    begin = np.cumsum(lengths) - lengths
    lanes = -(-lengths // LANE)
    doc = np.repeat(np.arange(len(lengths)), lanes)
    offset = (np.arange(len(doc)) - np.repeat(np.cumsum(lanes) - lanes, lanes)) * LANE
    warm = np.where(offset > 0, top, 0)
    at, size = begin[doc] + offset - warm, np.minimum(LANE, lengths[doc] - offset) + warm
    order = np.argsort(-size, kind="stable")
    doc, at, size, warm, fresh = doc[order], at[order], size[order], warm[order], (offset == 0)[order]
    state, total = np.where(fresh & started, min(1, top), 0), np.zeros(len(doc))
    for t in range(int(size[0]) if len(size) else 0):
        m = int(np.searchsorted(-size, -t, side="left"))
        j, pos = state[:m], at[:m] + t
        weight, follow = np.zeros(m), np.zeros(m, dtype=state.dtype)
        for k in range(top, 0, -1):
            here = np.flatnonzero(j == k)
            p = pos[here]
            hit = seen[k][p]
            weight[here[hit]] += arc[k][p[hit]]
            follow[here[hit]] = min(k + 1, top)
            j[here[hit]] = -1
            miss, p = here[~hit], p[~hit]
            weight[miss] += np.where(fresh[miss] & (t == 0), start_fail, fail[k - 1][p - 1])
            j[miss] = k - 1
        rest = np.flatnonzero(j == 0)
        p = pos[rest]
        weight[rest] += arc[0][p]
        follow[rest] = np.where(seen[0][p], min(1, top), 0)
        total[:m] += np.where(t >= warm[:m], weight, 0.0)
        state[:m] = follow
    return np.bincount(doc, weights=total, minlength=len(lengths))


def _scored(n: int, v: int, buckets: int, bits: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for row in left.to_pylist():
            words, ids, lengths = _parts(row)
            found = grams(words, ids, lengths, bits)
            keys, which = np.unique(np.concatenate(found), return_inverse=True)
            replies = right.sort_by("bucket").column("totals").to_pylist()
            answers = np.concatenate([unpacked(r) for r in replies]).astype(np.int64)
            none = int(len(keys) > 0 and keys[0] == 0)
            keys, which = keys[none:], np.where(which < none, len(keys) - none, which - none)
            if len(answers) != len(keys):
                raise ValueError("an answer is missing")
            totals = np.empty_like(answers)
            totals[np.argsort(_bucket(keys, buckets), kind="stable")] = answers
            at = np.split(which, len(found))
            begin = np.cumsum(lengths) - lengths
            seen, arc, fail = automaton(keys, at, begin, totals, n, v)
            texts = int(totals[np.searchsorted(keys, END)])
            start = float(np.log10(WEIGHTS[0] / (texts + WEIGHTS[0])))
            base = np.add.reduceat(arc[0], begin)
            score = traverse(seen, arc, fail, start, texts > 0, lengths)
            known = np.add.reduceat(seen[0].astype(np.int64), begin)
            cells = [pa.array(row["doc_ids"], pa.int64()), pa.array(row["held"], pa.bool_()), pa.array(lengths), pa.array(known), pa.array(base), pa.array(score)]
            out.append(pa.Table.from_arrays(cells, names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"]))
        give_back()
        return pa.concat_tables(out)

    return run


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def score(docs: DataFrame, folds: int = 5, fold: int = 1) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document."""
    doc_id = F.col("doc_id").cast("long")
    rows = docs.select(doc_id.alias("doc_id"), text_of().alias("text"), held_out(doc_id, folds, fold).alias("held"))
    blocks = materialize(rows.mapInArrow(_blocks, BLOCKS), "blocks")
    n_tokens = blocks.agg(F.sum("n")).first()[0] or 0
    buckets = max(1, -(-ORDER * n_tokens // BUCKET))
    bits = min(62, (ORDER * int(n_tokens)).bit_length() + SPARE)
    asked = blocks.mapInArrow(_asked(buckets, bits), "bucket long, block long, keys binary, counts binary")
    answers = materialize(asked.groupBy("bucket").applyInArrow(_answered, "block long, bucket long, totals binary, tokens long, types long"), "answers")
    facts = answers.agg(F.sum("tokens").alias("n"), F.sum("types").alias("v")).first()
    n, v = facts["n"] or 0, facts["v"] or 0
    found = blocks.groupBy("block").cogroup(answers.select("block", "bucket", "totals").groupBy("block")).applyInArrow(_scored(n, v, buckets, bits), SCORES)
    return found.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")
