"""Language-model scores against a plain model over strings; hashing against a plain splitter; the model's sums."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from quillon.llm import scoring

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute(docs, weights=scoring.WEIGHTS):
    texts = [(i, [*WORD.findall(lowered(t)), None]) for i, t in docs]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    count = Counter()
    for i, words in texts:
        if not held(i):
            seq = ("<s>", *words)
            count["<s>",] += 1
            for end in range(1, len(seq)):
                for k in range(1, min(3, end + 1) + 1):
                    if end - k + 1 >= 0 and not (k == 1 and end == 0):
                        count[seq[end - k + 1 : end + 1]] += 1
    uni = {g: c for g, c in count.items() if len(g) == 1 and g != ("<s>",)}
    n, v = sum(uni.values()), len(uni)

    def p(context, w):
        if not context:
            return (uni.get((w,), 0) + 0.5) / (n + 0.5 * (v + 1))
        lower = p(context[1:], w)
        m = weights[len(context) - 1]
        return (count[(*context, w)] + m * lower) / (count[context] + m)

    out = []
    for i, words in texts:
        seq = ("<s>", *words)
        score = sum(math.log10(p(seq[max(0, e - 2) : e], seq[e])) for e in range(1, len(seq)))
        out.append((i, held(i), len(words), sum((w,) in uni for w in words), n, sum(math.log10(p((), w)) for w in words), score))
    return out, (p, uni, count)


def close(got, want):
    key = lambda r: tuple(map(str, r[:5])) + (round(r[5], 6), round(r[6], 6))
    got, want = sorted((tuple(r[c] for c in ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")) for r in got), key=key), sorted(want, key=key)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5:] for g in got], [w[5:] for w in want], rtol=1e-9, atol=1e-9)


def made(seed, n=120):
    rng = random.Random(seed)
    words = ["the", "The", "a", "é", "É", "x\x0by", "naïve", "日本", "-", "END"] + ["w" + str(i) for i in range(40)]
    text = lambda k: "".join(rng.choice(words) + rng.choice([" ", "\n", "\t \r", "\x0c", "\xa0 "]) for _ in range(k))
    docs = [(i, text(rng.choice([0, 1, 2, 3, 30]))) for i in range(n)]
    docs += [(1000, text(2000)), (1001, None), (1002, "   \n"), (1003, docs[5][1]), (5, docs[5][1]), (5, "unheard of words only zzz"), (None, "a null id")]
    return docs


def test_scores_equal_a_plain_model(spark):
    docs = made(1)
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'x' AS block", "1 AS ids").repartition(3)
    close(scoring.score(df).collect(), brute(docs)[0])


@pytest.mark.parametrize("docs", [[], [(1, None)], [(7, "a b a b"), (7, "a b")], [(i, "b") for i in range(30) if zlib.crc32(str(i).encode()) % 5 == 1]])
def test_scores_of_small_tables(spark, docs):
    close(scoring.score(spark.createDataFrame(docs, "doc_id long, text string")).collect(), brute(docs)[0])


def test_small_blocks_lanes_and_many_buckets_change_nothing(monkeypatch):
    """The steps of a score without Spark, with the smallest sizes: blocks of a text or two, 40 buckets, lanes of three tokens."""
    import pyarrow as pa

    docs = made(2, 40)
    monkeypatch.setattr(scoring, "BLOCK", 200)
    monkeypatch.setattr(scoring, "LANE", 3)
    monkeypatch.setattr(scoring, "SLICE", 16)

    class Part:
        @staticmethod
        def get():
            return Part()

        def partitionId(self):  # noqa: N802
            return 3

    monkeypatch.setattr(scoring, "TaskContext", Part)
    held = [i is not None and zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in docs]
    batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in docs], pa.int64()), pa.array([t or "" for _, t in docs]), pa.array(held)], names=["doc_id", "text", "held"])
    blocks = list(scoring._blocks(iter([batch.slice(2), batch.slice(0, 2)])))
    assert len(blocks) > 10
    asked = pa.Table.from_batches(list(scoring._asked(40, 62)(iter(blocks))))
    buckets = asked.column("bucket").to_numpy()
    answers = pa.concat_tables([scoring._answered(asked.filter(pa.array(buckets == b))) for b in sorted(set(buckets))])
    n, v = sum(answers.column("tokens").to_pylist()), sum(answers.column("types").to_pylist())
    rows = []
    for b in blocks:
        mine = answers.filter(pa.array(answers.column("block").to_numpy() == b.column("block")[0].as_py()))
        rows += scoring._scored(n, v, 40, 62)(pa.Table.from_batches([b]), mine).to_pylist()
    close([r | {"train_tokens": n} for r in rows], brute(docs)[0])


def test_tokens_of_bytes(monkeypatch):
    monkeypatch.setattr(scoring, "SLICE", 8)
    texts = ["", "a", "Ab aB", " lead", "trail ", "x" * 50 + " y", "\x0b\x0c\x1c a\xa0b", "日本 日本"]
    raw = [t.encode() for t in texts]
    h, lengths = scoring.tokens(np.frombuffer(b"".join(raw), dtype=np.uint8), np.cumsum([len(r) for r in raw]), scoring.Powers())
    words = [[*WORD.findall(lowered(t)), None] for t in texts]
    assert lengths.tolist() == [len(w) for w in words]
    flat = [w for ws in words for w in ws]
    assert len({(w, int(x)) for w, x in zip(flat, h, strict=True)}) == len(set(flat)) == len(set(h.tolist()))


def test_probabilities_sum_to_one():
    docs = made(3, 20)
    _, (p, uni, _) = brute(docs)
    for context in [(), ("<s>",), ("the",), ("<s>", "the"), ("a", "the"), ("zzz", "qqq")]:
        known = sum(p(context, w) for (w,) in uni)
        assert known + p(context, "never seen") == pytest.approx(1.0)


def test_packing_is_reversible():
    rng = np.random.default_rng(1)
    for values in (np.zeros(0, dtype=np.uint64), rng.integers(0, 2**63, 1000).astype(np.uint64), np.array([2**64 - 1, 0], dtype=np.uint64)):
        assert (scoring.unpacked(scoring.packed(values)) == values).all()
