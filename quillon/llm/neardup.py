"""N-gram Jaccard join: a MinHash LSH forest finds candidates, exact verification decides.

A document is the set of its SHINGLE-word shingles (of words as they stand; a shorter text is one shingle). Documents of equal sets form one
class. Each class has TREES sequences of MAX_DEPTH MinHash values; a tree is a prefix trie over its sequences, met here as rows sorted by
prefix. A task walks its sorted rows and matches the longest prefixes first: classes under a trie node aren't paired off, but each is
compared by its sketch with the node's pivots only, and a node that ends hands its pivots on to the node of the next shorter prefix. So a node
of near copies yields one link for each, labelled with the length of the matched prefix. Large nodes are thinned out to pivots before the
shuffle too, within each batch.

How far prefixes are shortened follows from the links: those of estimated similarity s at the threshold or above, each weighted by one
over the chance 1 - (1 - s^d)^TREES that prefixes of length d meet, tell how many there are in all, and d is shortened from MAX_DEPTH until
the links at d reach TARGET of that number, at most to the length where pairs right at the threshold do.

Classes linked to a pivot form candidate components, and these are brought together once, whatever the number of trees. There all
pairs are verified exactly by matrix products over shared shingles, in pairs of blocks where a component is large; only counts and a
spanning forest leave a task.

Why a pivot suffices: if J(x, y) >= 0.8 and x joined pivot p at CORE or more, then by the triangle inequality y is near p too, within the
bound LINK, so both end in one component.

Defined results: null and empty texts form one class without links; rows that repeat are copies; of copies the least doc_id stands for
the class; a null doc_id is kept and never stands for others; an empty table gives no rows; other columns are ignored by ``join`` and kept
by ``keep_one``, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, give_back, materialize, release, text_of
from .toxicity import WordHash

SHINGLE = 5
THRESHOLD = 0.8
TREES = 16
MAX_DEPTH = 6
TARGET = 0.999
#: Estimated similarities (MAX_DEPTH * TREES one-byte sketches, standard error 0.04) from which a class belongs to a pivot, or is linked to it.
CORE, LINK = 0.85, 0.5
#: Rows of one node in one batch from which on it is thinned out before the shuffle.
CROWD = 16
#: Classes, and shingles, in a block of a large component.
BLOCK, BLOCK_SHINGLES = 1024, 1 << 21
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_ODD = np.random.default_rng(3).integers(1, 2**63, (2, SHINGLE + TREES * MAX_DEPTH), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def met(similarity: float | np.ndarray, depth: int, trees: int = TREES) -> float | np.ndarray:
    """The chance that prefixes of this length are equal in some tree."""
    return 1 - (1 - similarity**depth) ** trees


def least_depth(threshold: float, target: float = TARGET) -> int:
    """The longest prefix by which pairs right at the threshold meet with the target chance: none need be shorter."""
    return next((d for d in range(MAX_DEPTH, 1, -1) if met(threshold, d) >= target), 1)


def depth_reached(counts: dict[tuple[int, int], int], threshold: float, shortest: int, target: float = TARGET) -> int:
    """The longest prefix at which the links found make up the target share of all; counts: links by prefix length and similarity in percent."""
    for d in range(MAX_DEPTH, shortest, -1):
        found = {s / 100: n for (at, s), n in counts.items() if at >= d and s >= 100 * threshold}
        n = sum(counts[k] for k in counts if k[0] >= d and k[1] >= 100 * threshold)
        every = sum(counts[at, s] / met(min(1.0, s / 100), d) for at, s in counts if at >= d and s >= 100 * threshold)
        if found and n >= target * every:
            return d
    return shortest


def shingles(text: str, hashes: WordHash) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles."""
    words = _WORD.findall(text)
    if not words:
        return np.zeros(0, dtype=np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), dtype=np.uint64, count=len(words))
    if len(h) < SHINGLE:
        return np.array([xxhash.xxh64_intdigest(h.tobytes())], dtype=np.uint64)
    n = len(h) - SHINGLE + 1
    out = np.zeros(n, dtype=np.uint64)
    for k in range(SHINGLE):
        out = (out ^ (h[k : k + n] * _ODD[0, k])) * _ODD[1, k]
        out ^= out >> np.uint64(31)
    return np.unique(out)


def signature(found: np.ndarray) -> np.ndarray:
    """MAX_DEPTH * TREES MinHash values (32 bits) of a shingle set."""
    a, b = _ODD[0, SHINGLE:], _ODD[1, SHINGLE:]
    least = np.full(len(a), 2**64 - 1, dtype=np.uint64)
    for at in range(0, len(found), 2048):
        part = found[at : at + 2048]
        np.minimum(least, (part[:, None] * a + b).min(axis=0), out=least)
    return (least >> np.uint64(32)).astype(np.uint32)


def set_key(found: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(found.tobytes())


def places(sign: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """For each tree, its node at the shortest prefix (a hash), and the rest of its sequence as one number that sorts as it does."""
    wide = sign.astype(np.uint64)
    node = np.arange(1, TREES + 1, dtype=np.uint64) * _ODD[0, 0]
    for k in range(depth):
        node = (node ^ wide[:, k]) * _ODD[1, k % SHINGLE]
        node ^= node >> np.uint64(29)
    rest, bits = np.zeros(TREES, dtype=np.uint64), 62 // max(1, MAX_DEPTH - depth)
    for k in range(depth, MAX_DEPTH):
        rest = (rest << np.uint64(bits)) | (wide[:, k] & np.uint64((1 << min(bits, 32)) - 1))
    return node.astype(np.int64), rest.astype(np.int64)


def _sketch(depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHash()
        for batch in batches:
            seen: set[bytes] = set()
            out: list[list] = [[] for _ in range(5)]
            for text in batch.column(1).to_pylist():
                found = shingles(text, hashes)
                key = set_key(found)
                nodes = rests = sketch = None
                if key not in seen and len(found):
                    sign = signature(found).reshape(TREES, MAX_DEPTH)
                    nodes, rests = places(sign, depth)
                    sketch = (sign.reshape(-1) & 0xFF).astype(np.uint8).tobytes()
                seen.add(key)
                for o, v in zip(out, (key, len(found), nodes, rests, sketch), strict=True):
                    o.append(v)
            kinds = [pa.binary(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(o, k) for o, k in zip(out, kinds, strict=True))], names=["doc_id", "key", "n", "nodes", "rests", "sketch"])
        hashes.clear()
        give_back()

    return run


def _similar(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated similarity of sketches, corrected for chance agreement of one byte."""
    return ((a == b).mean(axis=-1) - 1 / 256) / (1 - 1 / 256)


Link = tuple[int, int, int, int]  # two classes, the length of their common prefix, their estimated similarity in percent


class _Node:
    """The classes met so far under one trie node: its pivots, and which of these are linked with each other."""

    def __init__(self, depth: int):
        self.depth, self.ids, self.root, self.n = depth, [], [], 0
        self.pivots = np.empty((2, TREES * MAX_DEPTH), dtype=np.uint8)

    def add(self, cid: int, sketch: np.ndarray) -> Iterator[Link]:
        """Links that join the class to the pivots near it, and these to each other: a spanning forest, so one for each class."""
        near = _similar(self.pivots[: self.n], sketch) if self.n else np.zeros(0)
        best: dict[int, float] = {}
        for p in np.flatnonzero(near >= LINK).tolist():
            best[self.root[p]] = max(best.get(self.root[p], 0.0), near[p])
        roots = sorted(best)
        if roots:
            yield from ((min(x, cid), max(x, cid), self.depth, round(100 * best[r])) for r in roots for x in [self.ids[r]] if x != cid)
            if len(roots) > 1:
                self.root = [roots[0] if r in roots else r for r in self.root]
        if not self.n or near.max() < CORE:
            if self.n == len(self.pivots):
                self.pivots = np.concatenate((self.pivots, np.empty_like(self.pivots)))
            self.pivots[self.n] = sketch
            self.ids.append(cid)
            self.root.append(roots[0] if roots else self.n)
            self.n += 1


class _Trie:
    """The open nodes on the way from the shortest prefix to the longest, for rows that come sorted by prefix."""

    def __init__(self, shortest: int):
        self.shortest, self.bits = shortest, 62 // max(1, MAX_DEPTH - shortest)
        self.path: list[_Node] = []
        self.last: tuple[int, int] | None = None

    def _close(self, depth: int) -> Iterator[Link]:
        """End the nodes longer than ``depth``: their pivots go on to the next shorter one."""
        while self.path and self.path[-1].depth > depth:
            ended = self.path.pop()
            if self.path:
                for cid, sketch in zip(ended.ids, ended.pivots, strict=False):
                    yield from self.path[-1].add(cid, sketch)

    def add(self, node: int, rest: int, cid: int, sketch: np.ndarray) -> Iterator[Link]:
        if self.last is not None:
            same = 0
            if node == self.last[0]:
                same, apart = MAX_DEPTH, rest ^ self.last[1]
                while apart:
                    same, apart = same - 1, apart >> self.bits
            yield from self._close(same)
        self.last = node, rest
        while not self.path or self.path[-1].depth < MAX_DEPTH:
            self.path.append(_Node(self.path[-1].depth + 1 if self.path else self.shortest))
        yield from self.path[-1].add(cid, sketch)

    def end(self) -> Iterator[Link]:
        yield from self._close(0)
        self.last = None

    def pivots(self) -> Iterator[tuple[int, np.ndarray]]:
        yield from zip(self.path[0].ids, self.path[0].pivots, strict=False)


_ROWS = "node long, rest long, cid long, sketch binary, other long, depth int, percent int"


def _fixed(column: pa.Array) -> np.ndarray:
    """A binary column of sketches as a matrix."""
    n, width = len(column), TREES * MAX_DEPTH
    first = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset] if n else 0
    return np.frombuffer(column.buffers()[2], dtype=np.uint8)[first : first + n * width].reshape(n, width)


def _rows(node, rest, cid, sketch: np.ndarray, links: list[Link]) -> pa.RecordBatch:
    """Rows of the tries, and links found already, which go along under nodes of their own."""
    k, width = len(links), TREES * MAX_DEPTH
    found = np.array(links, dtype=np.int64).reshape(k, 4)
    spread = ((found[:, 0].astype(np.uint64) * _ODD[0, 1]) ^ (found[:, 1].astype(np.uint64) * _ODD[0, 2])).astype(np.int64)
    sizes = np.concatenate((np.full(len(node), width), np.zeros(k, dtype=np.int64)))
    offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
    binary = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(sketch))])
    blank = np.full(len(node), -1, dtype=np.int64)
    arrays = [np.concatenate((node, spread)), np.concatenate((rest, np.zeros(k, dtype=np.int64))), np.concatenate((cid, found[:, 0])), binary]
    arrays += [np.concatenate((blank, found[:, 1])), np.concatenate((blank, found[:, 2])).astype(np.int32), np.concatenate((blank, found[:, 3])).astype(np.int32)]
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in arrays], names=[f.split()[0] for f in _ROWS.split(", ")])


def _planted(depth: int):
    """Rows of all tries of the classes (cid, nodes, rests, sketch); crowds under one node are thinned out to their pivots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            node, rest = (np.asarray(batch.column(i).flatten()) for i in (1, 2))
            row = np.repeat(np.arange(batch.num_rows), TREES)
            cid, sketch = np.asarray(batch.column(0)), _fixed(batch.column(3))
            order = np.lexsort((rest, node))
            starts = np.flatnonzero(np.concatenate(([True], node[order][1:] != node[order][:-1])))
            sizes = np.diff(np.append(starts, len(order)))
            keep, links = np.ones(len(order), dtype=bool), []
            for s, n in zip(starts[sizes >= CROWD].tolist(), sizes[sizes >= CROWD].tolist(), strict=True):
                trie, own = _Trie(depth), order[s : s + n]
                for i in own.tolist():
                    links += trie.add(int(node[i]), int(rest[i]), int(cid[row[i]]), sketch[row[i]])
                links += trie._close(depth)
                stay = {c for c, _ in trie.pivots()}
                keep[own] = [int(cid[row[i]]) in stay for i in own.tolist()]
            kept = np.flatnonzero(keep)
            yield _rows(node[kept], rest[kept], cid[row[kept]], sketch[row[kept]], list(dict.fromkeys(links)))
        give_back()

    return run


def _linked(depth: int):
    """Links (a, b, depth, percent) of the classes near each other in the tries. Rows come sorted by node and rest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, now = _Trie(depth), None

        def sent(links: list[Link]) -> pa.RecordBatch:
            columns = zip(*dict.fromkeys(links), strict=True)
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], names=["a", "b", "depth", "percent"])

        for batch in batches:
            other = np.asarray(batch.column(4))
            ready = np.flatnonzero(other >= 0)
            links = list(zip(*(np.asarray(batch.column(c))[ready].tolist() for c in (2, 4, 5, 6)), strict=True))
            rows = batch.filter(pa.array(other < 0)) if len(ready) else batch
            n = rows.num_rows
            if n:
                node, rest, cid = (np.asarray(rows.column(c)) for c in range(3))
                sketch = _fixed(rows.column(3))
                starts = np.flatnonzero(np.concatenate(([True], node[1:] != node[:-1])))
                for s, e in zip(starts.tolist(), np.append(starts[1:], n).tolist(), strict=True):
                    if node[s] != now:
                        if now is not None:
                            links += trie.end()
                        now = None
                        if e - s == 1 and e < n:
                            continue  # alone under its node
                        now = node[s]
                    for i in range(s, e):
                        links += trie.add(int(node[i]), int(rest[i]), int(cid[i]), sketch[i])
            if links:
                yield sent(links)
        if now is not None and (links := list(trie.end())):
            yield sent(links)

    return run


def _links(sets: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b) of classes by the longest prefixes that reach the target recall."""
    shortest = least_depth(threshold)
    planted = sets.where("sketch IS NOT NULL").select("cid", "nodes", "rests", "sketch").mapInArrow(_planted(shortest), _ROWS)
    found = planted.repartition("node").sortWithinPartitions("node", "rest", "cid").mapInArrow(_linked(shortest), "a long, b long, depth int, percent int")
    found = materialize(found.groupBy("a", "b").agg(F.max("depth").alias("depth"), F.max("percent").alias("percent")), "links")
    counts = {(r["depth"], r["percent"]): r["count"] for r in found.groupBy("depth", "percent").count().collect()}
    return found.where(F.col("depth") >= depth_reached(counts, threshold, shortest)).select("a", "b")


def thinned(edges: DataFrame) -> DataFrame:
    """Edges (a, b) with the components of ``edges``: each node keeps the one to its least neighbour, to which its other smaller neighbours are tied.

    Nodes linked to the same few pivots in many trees so come to have about one edge each, and ties between pivots are shared.
    """
    least = F.min("a").over(Window.partitionBy("b"))
    ties = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct().select("a", "b", least.alias("m"))
    return ties.select(F.col("m").alias("a"), F.explode(F.array("a", "b")).alias("b")).where("a < b").distinct()


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """(node, root): the least node of each connected component of edges (a, b). Labels spread along edges and jump along themselves."""
    edges = thinned(thinned(edges))
    both = materialize(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), label)
    held = roots = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")), label)
    while True:
        near = both.join(roots.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        step = roots.join(near, "node").select("node", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        jump = roots.select(F.col("node").alias("root"), F.col("root").alias("far"))
        step = step.join(jump, "root", "left").select("node", "old", F.least("root", F.coalesce("far", "root")).alias("root"))
        step = materialize(step, label)
        release(held)
        held, roots = step, step.select("node", "root")
        if not step.where("root < old").limit(1).count():
            release(both)
            return roots


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(cid, comp, blocks, block, shingles) of the representatives: (text, key, cid, comp, blocks, block)."""
    hashes = WordHash()
    for batch in batches:
        found = [shingles(t, hashes) for t in batch.column(0).to_pylist()]
        ok = pa.array([set_key(f) == k for f, k in zip(found, batch.column(1).to_pylist(), strict=True)], pa.bool_())
        raw = pa.array([f.tobytes() for f in found], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(2, 6)] + [raw], names=["cid", "comp", "blocks", "block", "shingles"]).filter(ok)


def _common(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections, by products over the shingles that two sets or more hold."""
    m = len(sets)
    lengths = np.array([len(s) for s in sets])
    values, code, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(m), lengths)
    shared = (count > 1) & (count < m)
    out = np.full((m, m), float((count == m).sum()), dtype=np.float64)
    place = np.cumsum(shared) - 1
    use = shared[code]
    row, col = row[use], place[code[use]]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    width = max(256, (1 << 22) // m)
    for at in range(0, int(shared.sum()), width):
        lo, hi = np.searchsorted(col, (at, at + width))
        x = np.zeros((m, width), dtype=np.float32)
        x[row[lo:hi], col[lo:hi] - at] = 1
        out += x @ x.T
    return out


def _verify(threshold: float):
    """For each group (comp, i, j): the links of each class within it and a spanning forest of them."""

    def group(rows: dict[int, tuple[int, np.ndarray]], i: int, j: int) -> Iterator[tuple[int, int, int]]:
        cids = np.array(sorted(rows))
        block = np.array([rows[c][0] for c in cids])
        sets = [rows[c][1] for c in cids]
        lengths = np.array([len(s) for s in sets], dtype=np.float64)
        common = _common(sets)
        linked = common >= threshold * (lengths[:, None] + lengths[None, :] - common) - 1e-9
        np.fill_diagonal(linked, False)
        if i != j:
            linked &= block[:, None] != block[None, :]
        counts = linked.sum(axis=1)
        root = np.arange(len(cids))
        todo = set(range(len(cids)))
        while todo:
            start = min(todo)
            front = np.array([start])
            todo.discard(start)
            while len(front):
                near = np.flatnonzero(linked[front].any(axis=0))
                front = np.array([x for x in near.tolist() if x in todo], dtype=np.int64)
                root[front] = start
                todo.difference_update(front.tolist())
        yield from zip(cids.tolist(), counts.tolist(), cids[root].tolist(), strict=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[int, np.ndarray]] = {}
        now = None

        def flush() -> pa.RecordBatch:
            found = list(group(held, now[1], now[2]))
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], names=["cid", "links", "root"])

        for batch in batches:
            for comp, i, j, cid, block, raw in zip(*(batch.column(c).to_pylist() for c in range(6)), strict=True):
                if (comp, i, j) != now:
                    if held:
                        yield flush()
                    held, now = {}, (comp, i, j)
                held[cid] = (block, np.frombuffer(raw, dtype=np.uint64))
        if held:
            yield flush()
        held = {}
        give_back()

    return run


def join(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, copy_id (least id of the same shingle set), class_id (least id of the near-duplicate group), n_copies (rows of the
    set), n_links (other sets at the threshold or above)."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    kinds = "doc_id long, key binary, n long, nodes array<long>, rests array<long>, sketch binary"
    rows = materialize(texts.mapInArrow(_sketch(least_depth(threshold)), kinds), "sketches")
    sets = rows.groupBy("key").agg(F.min("doc_id").alias("copy_id"), F.count(F.lit(1)).alias("n_copies"), F.max("n").alias("n"))
    sets = sets.join(rows.where("sketch IS NOT NULL").select("key", "nodes", "rests", "sketch").dropDuplicates(["key"]), "key", "left")
    sets = materialize(sets.withColumn("cid", F.monotonically_increasing_id()), "sets")
    roots = components(_links(sets, threshold))

    sized = sets.select("cid", "key", "copy_id", "n").join(roots.select(F.col("node").alias("cid"), F.col("root").alias("comp")), "cid")
    sizes = sized.groupBy("comp").agg(F.greatest(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK)), F.ceil(F.sum("n") / F.lit(BLOCK_SHINGLES))).cast("long").alias("blocks"))
    wanted = materialize(sized.join(sizes, "comp").select("copy_id", "key", "cid", "comp", "blocks", F.pmod(F.xxhash64("cid"), F.col("blocks")).alias("block")), "wanted")
    listed = F.broadcast(wanted) if wanted.count() * 64 <= BROADCAST_BYTES else wanted.hint("merge")
    found = texts.join(listed, F.col("doc_id").eqNullSafe(F.col("copy_id"))).select("text", "key", "cid", "comp", "blocks", "block")
    found = found.mapInArrow(_sets, "cid long, comp long, blocks long, block long, shingles binary")
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other")
    pairs = found.select("comp", "cid", "block", "shingles", other).select("comp", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "cid", "block", "shingles")
    checked = pairs.repartition("comp", "i", "j").sortWithinPartitions("comp", "i", "j").mapInArrow(_verify(threshold), "cid long, links long, root long")
    checked = materialize(checked, "verified")
    counts = checked.groupBy("cid").agg(F.sum("links").alias("n_links"), F.min("root").alias("root"), F.count(F.lit(1)).alias("parts"))
    if counts.where("parts > 1").limit(1).count():
        spread = components(checked.where("root <> cid").select(F.col("root").alias("a"), F.col("cid").alias("b")), "spread")
        counts = counts.drop("root").join(spread.select(F.col("node").alias("cid"), "root"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    named = sets.select("cid", "key", "copy_id", "n_copies").join(counts.select("cid", "n_links", "root"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    least = named.groupBy("root").agg(F.min("copy_id").alias("class_id"))
    named = materialize(named.join(least, "root").select("key", "copy_id", "class_id", "n_copies", F.coalesce("n_links", F.lit(0)).alias("n_links")), "classes")
    listed = F.broadcast(named) if named.count() * 64 <= BROADCAST_BYTES else named.hint("merge")
    return rows.select("doc_id", "key").join(listed, "key").select("doc_id", "copy_id", "class_id", "n_copies", "n_links")


def keep_one(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, with their own columns, that stand for their group: the least doc_id of each; rows that repeat stay once.

    Rows with a null doc_id stay only where no other row of their group has an id.
    """
    found = join(docs, threshold).where(F.col("doc_id").eqNullSafe(F.col("class_id"))).select(F.col("doc_id").alias("n_id")).distinct()
    found = materialize(found, "kept")
    listed = F.broadcast(found) if found.count() * 16 <= BROADCAST_BYTES else found.hint("merge")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("n_row"))
    out = rows.join(listed, F.col("n_row").getField("doc_id").cast("long").eqNullSafe(F.col("n_id")), "left_semi")
    if docs.groupBy("doc_id").count().where("count > 1").limit(1).count():
        out = out.select("n_row", F.col("n_row").getField("doc_id").alias("n_doc"), F.col("n_row").getField("text").alias("n_text")).dropDuplicates(["n_doc", "n_text"])
    return out.select(*[F.col("n_row").getField(c).alias(c) for c in docs.columns])
