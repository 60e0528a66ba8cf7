"""Hierarchical multi-length packing of documents into training sequences.

Each partition of the scan packs its own documents, so nothing is shuffled: full windows of the longest tier are cut off first,
the remainder of each document is routed to the smallest tier that holds it, and tiers are packed from the longest to the
shortest. The gap of a window is filled with whole documents of shorter tiers (largest that fits first); only when none
fits is the shortest waiting document cut. Windows of a tier are exactly full, so only the last window of a partition is padded.

The windows of a tier wait until DEAL step groups of ``step_tokens`` tokens are full, and are then dealt to these by attention cost, to and
fro. At the end of a partition what waits is dealt to as few groups as hold it, alike to within one window: only those hold fewer tokens.

Defined results: a null or empty text is the end token alone; rows that repeat are packed once each; an empty table gives
no rows; other columns are ignored. Piece bounds depend on how the input is split into partitions, the tokens do not.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, text_of

TIERS = (256, 512, 1024, 2048)
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, padded_length long, step_group long"
STEP_TOKENS = 65536
DEAL = 8


class WordEncoder:
    """Token ids of texts by way of a bounded cache of words.

    The tokenizer lowers case, cuts a text into words by a pattern and then works on each word alone, so the ids of a text are those
    of its words in turn. The pattern (a fixed value of the tokenizer) is applied here to texts of Latin letters and common
    signs, for which lowering and normal form are the same in both; other texts, and those with special tokens, go to the
    tokenizer whole.
    """

    #: The letters and digits that texts of these signs hold once they are in lower case.
    LETTERS, DIGITS = r"a-zA-Z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u02af\u2c65\u2c66", r"0-9\xb2\xb3\xb9\xbc-\xbe"
    PATTERN = re.compile(rf"[{LETTERS}]+|'(?:[stmd]|re|ve|ll)|[{DIGITS}]|[^\s{LETTERS}{DIGITS}]+")
    OTHER = re.compile(r"[^\t\n\r -~\xa0-\u024f\u2010-\u2027]|<\|")

    def __init__(self, path: str, max_entries: int = 1_000_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.max_entries = max_entries
        self.cache: dict[str, bytes] = {}
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True

    def rest(self, entries: int = 600_000) -> None:
        """Keep the oldest words only, which are the frequent ones, until the next task."""
        self.cache = dict(islice(self.cache.items(), entries))
        give_back()

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype=np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: list[str]) -> None:
        """Encode words that aren't cached in one text: every word's last token, and no other, ends a word."""
        if len(self.cache) + len(words) > self.max_entries:  # frequent words come early: the older half stays
            self.cache = dict(islice(self.cache.items(), self.max_entries // 2))
        ids = self._ids([" ".join(words)])[0]
        last = np.flatnonzero(self.ends[ids]) + 1
        if len(last) == len(words):
            raw, at = ids.tobytes(), [0, *(last * 4).tolist()]
            self.cache.update(zip(words, map(raw.__getitem__, map(slice, at, at[1:])), strict=False))
        else:
            self.cache.update(zip(words, (x.tobytes() for x in self._ids(words)), strict=True))

    def encode(self, texts: list[str], end: int) -> Iterator[np.ndarray]:
        tail = np.array([end], dtype=np.uint32).tobytes()
        for text in texts:
            if self.OTHER.search(text):
                yield np.append(self._ids([text])[0], np.uint32(end))
                continue
            words = self.PATTERN.findall(text.lower())
            try:
                raw = b"".join(map(self.cache.__getitem__, words))
            except KeyError:
                self._learn([w for w in set(words) if w not in self.cache])
                if any(w not in self.cache for w in words):  # the cache was cut
                    self.cache.clear()
                    self._learn(list(set(words)))
                raw = b"".join(map(self.cache.__getitem__, words))
            yield np.frombuffer(raw + tail, dtype=np.uint32)


@lru_cache(maxsize=2)
def encoder_for(path: str) -> WordEncoder:
    """One encoder for each Python worker, so that tasks share its cache."""
    return WordEncoder(path)


class TierPacker:
    """Packs pieces (document, start, length) into exactly full windows, keeping what is left for the next batch."""

    def __init__(self, tiers: tuple[int, ...] = TIERS):
        self.tiers = tuple(sorted(tiers))
        self.by_length: list[list[tuple[int, int]]] = [[] for _ in range(self.tiers[-1] + 1)]
        self.mask = 0
        self.waiting = 0

    def put(self, doc: int, start: int, length: int) -> None:
        self.by_length[length].append((doc, start))
        self.mask |= 1 << length
        self.waiting += length

    def _take(self, length: int) -> tuple[int, int]:
        stack = self.by_length[length]
        out = stack.pop()
        if not stack:
            self.mask &= ~(1 << length)
        self.waiting -= length
        return out

    def _fill(self, window: list[tuple[int, int, int]], gap: int) -> None:
        while gap:
            fits = self.mask & ((1 << (gap + 1)) - 1)
            if fits:
                length = fits.bit_length() - 1
                window.append((*self._take(length), length))
                gap -= length
            else:
                length = (self.mask & -self.mask).bit_length() - 1
                doc, start = self._take(length)
                window.append((doc, start, gap))
                self.put(doc, start + gap, length - gap)
                gap = 0

    def windows(self, last: bool) -> Iterator[tuple[int, list[tuple[int, int, int]]]]:
        """(tier, pieces) of each window; the rest of the pool stays unless it is the last call."""
        for i in range(len(self.tiers) - 1, -1, -1):
            tier, lower = self.tiers[i], self.tiers[i - 1] if i else 0
            own = ((1 << (tier + 1)) - 1) & ~((1 << (lower + 1)) - 1)
            while self.waiting >= tier and (m := self.mask & own):
                length = m.bit_length() - 1
                window = [(*self._take(length), length)]
                self._fill(window, tier - length)
                yield tier, window
        if last:
            for tier in reversed(self.tiers):
                while self.waiting >= tier:
                    window: list[tuple[int, int, int]] = []
                    self._fill(window, tier)
                    yield tier, window
            if self.waiting:
                window = []
                self._fill(window, self.waiting)
                yield self.tiers[-1], window


def _packer(path: str, end: int, tiers: tuple[int, ...], step_tokens: int):
    top = max(tiers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        from pyspark import TaskContext

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        base = TaskContext.get().partitionId() << 40
        encoder, packer = encoder_for(path), TierPacker(tiers)
        kept: dict[int, tuple[object, np.ndarray]] = {}
        counters = {"doc": 0, "seq": 0}
        waiting: dict[int, list[tuple[int, list[tuple]]]] = {t: [] for t in tiers}
        groups = 0

        def described(tier: int, pieces: list[tuple[int, int, int]]) -> tuple[int, list[tuple]]:
            """Attention cost and rows of a window; it takes the next sequence."""
            seq, offset, out = base | counters["seq"], 0, []
            counters["seq"] += 1
            total = sum(p[2] for p in pieces)
            padded = total if total & (total - 1) == 0 else top
            for doc, start, length in pieces:
                doc_id, ids = kept[doc]
                out.append((doc_id, start, length, zlib.crc32(ids[start : start + length].tobytes()), len(ids), seq, offset, tier, padded))
                offset += length
            return sum(p[2] ** 2 for p in pieces), out

        def dealt(last: bool) -> Iterator[pa.RecordBatch]:
            """Rows of the windows whose step groups are settled."""
            nonlocal groups
            out: list[tuple] = []
            for tier, own in waiting.items():
                size = max(1, step_tokens // tier)
                ready = len(own) if last else len(own) - len(own) % (DEAL * size)
                for at in range(0, ready, DEAL * size):
                    part = own[at : min(ready, at + DEAL * size)]
                    group = balanced([cost for cost, _ in part], -(-len(part) // size))
                    out += [(*row, base | (groups + g)) for (_, rows), g in zip(part, group, strict=True) for row in rows]
                    groups += max(group) + 1
                del own[:ready]
            if out:
                kinds = [pa.int64()] * 7 + [pa.int32(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=[f.split()[0] for f in SCHEMA.split(", ")])

        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                windows: list[tuple[int, list[tuple[int, int, int]]]] = []
                for doc_id, ids in zip(part.column(0).to_pylist(), encoder.encode(part.column(1).to_pylist(), end), strict=True):
                    doc = counters["doc"]
                    counters["doc"] += 1
                    kept[doc] = (doc_id, ids)
                    n = len(ids)
                    full = n - n % top
                    windows += [(top, [(doc, s, top)]) for s in range(0, full, top)]
                    if n > full:
                        packer.put(doc, full, n - full)
                for tier, pieces in [*windows, *packer.windows(False)]:
                    waiting[tier].append(described(tier, pieces))
                yield from dealt(False)
                left = {doc for stack in packer.by_length for doc, _ in stack}
                kept = {doc: kept[doc] for doc in left}
        for tier, pieces in packer.windows(True):
            waiting[tier].append(described(tier, pieces))
        yield from dealt(True)
        encoder.rest()

    return run


def balanced(costs: list[int], groups: int) -> list[int]:
    """A group for each window: the dearest first, dealt to and fro, so that sizes differ by one at most and costs little."""
    out = [0] * len(costs)
    for turn, i in enumerate(sorted(range(len(costs)), key=lambda i: -costs[i])):
        lap, place = divmod(turn, groups)
        out[i] = groups - 1 - place if lap % 2 else place
    return out


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, tiers: tuple[int, ...] = TIERS, step_tokens: int = STEP_TOKENS) -> DataFrame:
    """One row for each piece: where it lies in its document and in its sequence, its tier and its step group.

    ``tokenizer`` is the path of a tokenizer file on every executor; ``end_id`` follows each document.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(_packer(tokenizer, end_id, tuple(tiers), step_tokens), SCHEMA)
