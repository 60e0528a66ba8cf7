"""The n-gram Jaccard join against brute force."""

import random

import numpy as np
import pytest

from quillon.llm import neardup

DOCS = "doc_id long, text string, lang string, key string, n int"


def made(spark, texts):
    return spark.createDataFrame([(i, t, None, "x", 1) for i, t in enumerate(texts)], DOCS)


def shingle_set(t):
    words = (t or "").split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute(texts):
    """(copy, group, links) of each text."""
    sets = [shingle_set(t) for t in texts]
    first, links, parent = {}, {}, {}
    for i, s in enumerate(sets):
        first.setdefault(s, i)
    keys = list(first)
    for s in keys:
        parent[s], links[s] = s, 0
    def find(s):
        while parent[s] is not s:
            s = parent[s]
        return s
    for i, a in enumerate(keys):
        for b in keys[:i]:
            if a and b and 5 * len(a & b) >= 4 * len(a | b):
                links[a] += 1
                links[b] += 1
                x, y = sorted((find(a), find(b)), key=first.__getitem__)
                parent[y] = x
    return [(first[s], first[find(s)], links[s]) for s in sets]


def corpus(seed, n=160):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(3000)]
    texts = [None, "", " ", "one", "one", "a b c d", "a b c d e", "a b c d e"]
    for _ in range(n // 4):
        base = [rng.choice(words) for _ in range(rng.choice([6, 40, 120, 400]))]
        texts.append(" ".join(base))
        for _ in range(rng.choice([0, 1, 3, 8])):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4, 8])):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(" ".join(copy))
    base = [rng.choice(words) for _ in range(300)]
    for _ in range(60):  # one large group
        copy = list(base)
        for _ in range(rng.choice([1, 2, 4])):
            copy[rng.randrange(len(copy))] = rng.choice(words)
        texts.append(" ".join(copy))
    head = texts[:8]
    rest = texts[8:]
    rng.shuffle(rest)
    return head + rest


@pytest.mark.parametrize("block", [1024, 16])
def test_join(spark, block, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", block)
    texts = corpus(block)
    want = brute(texts)
    got = {r.doc_id: (r.copy_id, r.class_id, r.n_links) for r in neardup.join(made(spark, texts)).collect()}
    assert len(got) == len(texts)
    wrong = [i for i, w in enumerate(want) if got[i] != w]
    assert len(wrong) <= 0.01 * len(texts), [(got[i], want[i]) for i in wrong[:5]]
    assert all(got[i][0] == w[0] for i, w in enumerate(want))
    kept = neardup.keep_one(made(spark, texts))
    assert kept.columns == made(spark, []).columns
    assert {r.doc_id for r in kept.collect()} == {c for _, c, _ in got.values()}


def test_join_of_odd_tables(spark):
    assert neardup.join(made(spark, [])).count() == 0 and neardup.keep_one(made(spark, [])).count() == 0
    docs = made(spark, ["a b c d e f g", "x", None])
    twice = docs.union(docs)
    assert sorted(tuple(r)[:4] for r in neardup.join(twice).collect()) == sorted([(0, 0, 0, 2), (1, 1, 1, 2), (2, 2, 2, 2)] * 2)
    assert neardup.keep_one(twice).count() == 3


def test_signature_estimates():
    rng = np.random.default_rng(1)
    a = np.unique(rng.integers(0, 2**63, 900).astype(np.uint64))
    b = np.unique(np.concatenate((a[:800], rng.integers(0, 2**63, 100).astype(np.uint64))))
    true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert abs((neardup.signature(a) == neardup.signature(b)).mean() - true) < 0.15
    assert neardup.least_depth(0.8) == 4


def test_prefixes_are_shortened_until_the_recall_is_reached():
    high, low = {(6, 97): 1000}, {(6, 80): 900, (5, 81): 60, (4, 80): 40}
    assert neardup.depth_reached(high, 0.8, 4) == 6  # copies this near share the longest prefixes
    assert neardup.depth_reached(low, 0.8, 4) == 4
    assert neardup.depth_reached({(6, 80): 900, (6, 99): 3_000}, 0.8, 4) == 5
    assert neardup.depth_reached({}, 0.8, 4) == 4 and neardup.depth_reached({(6, 60): 9}, 0.8, 4) == 4


def test_trie_matches_the_longest_prefix_first():
    rng = np.random.default_rng(2)
    sketch = rng.integers(0, 256, neardup.TREES * neardup.MAX_DEPTH).astype(np.uint8)
    trie, far = neardup._Trie(4), rng.integers(0, 256, len(sketch)).astype(np.uint8)
    pack = lambda a, b: (a << 31) | b
    rows = [(1, pack(5, 5), 10, sketch), (1, pack(5, 5), 11, sketch), (1, pack(5, 6), 12, sketch), (1, pack(7, 1), 13, sketch), (1, pack(7, 2), 14, far), (2, pack(5, 5), 15, sketch)]
    links = [x for row in rows for x in trie.add(*row)] + list(trie.end())
    assert sorted(x[:3] for x in links) == [(10, 11, 6), (10, 12, 5), (10, 13, 4)]


def test_recall_of_pairs_near_the_threshold(spark):
    """1,200 pairs of texts with a similarity from 0.8 to 0.85, all else unlike."""
    rng = random.Random(6)
    words, texts, pairs = [f"w{i}" for i in range(5000)], [], 0
    while pairs < 1200:
        base = [rng.choice(words) for _ in range(rng.choice([60, 110, 220]))]
        copy = list(base)
        for _ in range(len(base) // 46):
            copy[rng.randrange(len(copy))] = rng.choice(words)
        a, b = shingle_set(" ".join(base)), shingle_set(" ".join(copy))
        if 0.8 <= len(a & b) / len(a | b) <= 0.85:
            texts += [" ".join(base), " ".join(copy)]
            pairs += 1
    got = {r.doc_id: (r.class_id, r.n_links) for r in neardup.join(made(spark, texts)).collect()}
    found = sum(got[2 * i] == got[2 * i + 1] == (2 * i, 1) for i in range(pairs))
    assert found >= 0.99 * pairs


def test_crowds_are_thinned_before_the_shuffle(spark, monkeypatch):
    monkeypatch.setattr(neardup, "CROWD", 4)
    texts = corpus(7)
    want = brute(texts)
    got = {r.doc_id: (r.copy_id, r.class_id, r.n_links) for r in neardup.join(made(spark, texts)).collect()}
    assert sum(got[i] != w for i, w in enumerate(want)) <= 0.01 * len(texts)


def test_keep_one_of_columns_with_clashing_names(spark):
    docs = made(spark, ["a b c d e f g", "a b c d e f g", "x", None]).selectExpr("*", "1 AS n_id", "2 AS n_row", "3 AS n_doc", "4 AS cid", "5 AS class_id")
    kept = neardup.keep_one(docs.union(docs))
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [0, 2, 3]


def test_links_to_many_pivots_are_thinned(spark):
    """300 classes, each linked to the same 16 pivots: about an edge for each class stays, and the components are the same."""
    links = [(100 * g + p, 100 * g + c) for g in (0, 1000) for p in range(16) for c in range(16, 316)] + [(7, 999_999)]
    edges = spark.createDataFrame(links, "a long, b long")
    thin = neardup.thinned(edges)
    assert thin.count() <= 2 * (300 + 15) + 1
    assert {(r.node, r.root) for r in neardup.components(edges).collect()} == {(x, 100_000 if x >= 100_000 and x != 999_999 else 0) for e in links for x in e}
