"""Mixing, personal data, toxicity, repeated passages and vector search against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest

from quillon.llm import mixing, passages, pii, topk, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long, tag int, core int"


def made(spark, texts, sources=None):
    sources = sources or ["s"] * len(texts)
    return spark.createDataFrame([(i, t, None, s, None, 7, 1) for i, (t, s) in enumerate(zip(texts, sources, strict=True))], DOCS)


# --- mixing ----------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("weights", [{"a": 0.36, "b": 0.21, "c": 0.2, "d": 0.013, "e": 0.217}, {"a": 1 / 3, "b": 1 / 3, "c": 1 / 3}, {"a": 1.0, "rare": 0.0001}])
def test_edf_deviates_by_less_than_a_block(weights):
    """From the very targets, over many more slots than a small weight needs for one block."""
    total = sum(map(Fraction, weights.values()))
    share = {s: Fraction(w) / total for s, w in weights.items()}
    seen = Counter()
    for t, s in zip(range(30_000), mixing.edf(mixing.exact(weights)), strict=False):
        seen[s] += 1
        if t % 7 == 0:
            assert all(abs(seen[x] - (t + 1) * w) < 1 for x, w in share.items())


@pytest.mark.parametrize("weights", [None, {"hot": 0.5, "x": 0.3, "y": 0.2}, {"hot": 0.0, "x": 1.0}])
def test_positions(spark, weights):
    rng = random.Random(4)
    sources = rng.choices(["hot", "x", "y", "z", None], [40, 10, 5, 1, 3], k=900)
    rows = mixing.positions(made(spark, ["t"] * 900, sources), weights, block=8).collect()
    assert sorted(r.position for r in rows) == list(range(900)) and {r.doc_id for r in rows} == set(range(900))
    assert all(r.source == sources[r.doc_id] for r in rows)
    sizes = Counter((r.source, r.block) for r in rows)
    n = Counter(sources)
    assert all(k == 8 or k == n[s] % 8 and b == n[s] // 8 for (s, b), k in sizes.items())
    by_slot = defaultdict(set)
    for r in rows:
        by_slot[r.slot].add((r.source, r.block, r.phase, r.share))
    assert sorted(by_slot) == list(range(len(by_slot))) and all(len(x) == 1 for x in by_slot.values())
    done, start, phase = Counter(), 0, 0
    for slot in sorted(by_slot):
        ((s, _, p, _),) = by_slot[slot]
        if p != phase:
            done, start, phase = Counter(), slot, p
        done[s] += 1
        for x, share in {(y[0], y[3]) for z in by_slot.values() for y in z if y[2] == phase}:
            assert abs(done[x] - (slot + 1 - start) * share) < 1
    if weights and not weights["hot"]:
        assert max(r.position for r in rows if r.source == "x") < min(r.position for r in rows if r.source != "x")


def test_interleave_keeps_rows_and_columns(spark):
    docs = made(spark, [None, "", "a", "b", "b"], ["p", None, "p", "q", "q"])
    docs = docs.union(docs.limit(1))
    out = mixing.interleave(docs)
    assert out.columns == docs.columns and sorted(map(str, out.collect())) == sorted(map(str, docs.collect()))
    assert mixing.interleave(docs.limit(0)).count() == 0 and mixing.positions(docs.limit(0)).count() == 0


# --- personal data ---------------------------------------------------------------------------------------------------


def naive_spans(t):
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 16 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))]
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(digits(m[0])) <= 15]


def test_base_spans_match_patterns():
    rng = random.Random(5)
    for _ in range(20_000):
        t = "".join(rng.choice("12.@a-+ (9_é") for _ in range(rng.randint(0, 40)))
        assert naive_spans(t) == pii.base_spans(t), t
    assert pii.base_spans("a" * 200_000) == [] and pii.base_spans("1" * 50_000) == []


def test_field_on_unseen_sentences():
    weights, rng = dict(pii.trained()), random.Random(77)
    good = total = 0
    for _ in range(300):
        text, spans = pii._sentence(rng)
        base, found = pii.find(text, weights)
        assert set(base) <= set(found)
        total += len(spans)
        good += len(spans & set(found))
        extra = set(found) - set(base) - spans
        assert len(extra) <= 1
    assert good >= 0.97 * total


def test_detect(spark):
    texts = [None, "", "mail a.b@c.de or call (555) 123-4567 now", "card 4111 1111 1111 1111 ip 10.0.0.1 phone +49 30 1234567", "Version 3.0. no data 1.2.3 here", "é" * 9 + " x@y.zz"]
    got = {r.doc_id: r for r in pii.detect(made(spark, texts)).collect()}
    for i, t in enumerate(texts):
        base = naive_spans(t or "")
        assert got[i].base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
    assert got[2].spans == "email:5:13,phone:22:36" and got[4].spans == "" and got[3].n_phone == 1
    assert pii.detect(made(spark, [])).count() == 0


# --- toxicity --------------------------------------------------------------------------------------------------------


def test_toxicity_held_out(spark):
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdefg") for _ in range(4)) for _ in range(200)]
    texts, toxic = [None, ""], [None, 0]
    for _ in range(900):
        bad = rng.random() < 0.25
        t = [rng.choice(words) for _ in range(rng.randint(5, 60))]
        if bad:
            t.insert(rng.randint(0, len(t)), rng.choice(["vile", "scum", "idiot"]))
        texts.append(" ".join(t))
        toxic.append(int(bad))
    labels = spark.createDataFrame([(i, 1, y) for i, y in enumerate(toxic)], "doc_id long, quality int, toxic int")
    rows = toxicity.score(made(spark, texts), labels).collect()
    assert len(rows) == len(texts) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    import zlib

    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    held = [(r.predicted, toxic[r.doc_id]) for r in rows if r.held_out and texts[r.doc_id]]
    assert sum(p == y for p, y in held) >= 0.97 * len(held)
    assert toxicity.score(made(spark, texts[:3]), labels.limit(0)).count() == 3
    assert toxicity.score(made(spark, []), labels).count() == 0


# --- repeated passages -----------------------------------------------------------------------------------------------


def brute_repeats(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = np.zeros(len(b) + 1, dtype=bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = True
        keep = bytes(c for c, g in zip(b, gone, strict=False) if not g)
        out.append((len(b), int(gone.sum()), int(((~gone[:-1]) & gone[1:]).sum() + gone[0]), hashlib.sha256(keep).hexdigest()))
    return out


@pytest.mark.parametrize("length,reach,alphabet", [(40, 16, "ab"), (60, 24, "abcdé "), (400, 192, "abcdefgh ")])
def test_passages(spark, length, reach, alphabet):
    rng = random.Random(length)
    text = lambda n: "".join(rng.choice(alphabet) for _ in range(n))
    common = [text(length * k // 2) for k in (1, 2, 2, 3, 5)]
    texts = [None, "", text(length - 1), "ab" * length, "xyz" * (length // 2), common[3], common[3]]
    for _ in range(60):
        parts = [rng.choice([text(rng.randint(0, length)), rng.choice(common), "q" * rng.randint(0, 2 * length)]) for _ in range(rng.randint(1, 5))]
        if rng.random() < 0.5:
            p = rng.choice(common)
            a = rng.randint(0, len(p))
            parts.append(p[a : a + length + rng.randint(-3, 3)] + text(3))
        texts.append("".join(parts))
    piece = 64 if length == 40 else passages.PIECE
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in passages.remove_repeats(made(spark, texts), length, reach, piece).collect()}
    want = brute_repeats(texts, length)
    for i, w in enumerate(want):
        assert got[i] == w, i


def test_passages_of_repeated_rows(spark):
    docs = made(spark, ["r" * 30 + "abcdefghij" * 50, None, "x"])
    rows = passages.remove_repeats(docs.union(docs)).collect()
    assert len(rows) == 6 and {(r.doc_id, r.n_bytes, r.n_removed) for r in rows} == {(0, 530, 530), (1, 0, 0), (2, 1, 0)}
    assert passages.remove_repeats(docs.limit(0)).count() == 0


# --- vector search ---------------------------------------------------------------------------------------------------


def test_search(spark):
    rng = np.random.default_rng(8)
    vectors = [[float(x) for x in rng.normal(0, 0.2, 16)] for _ in range(400)]
    for i in range(100, 240):
        vectors[i] = vectors[100]  # many ties
    vectors[7], vectors[8], vectors[9], vectors[50] = None, [float("nan")] * 16, [None] * 16, [float("inf")] + [0.0] * 15
    df = spark.createDataFrame([(i, v, 1) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>, score int")
    got = [tuple(r) for r in topk.search(df, every=10, wave=17).orderBy("query_id", "rank").collect()]
    ok = {i: np.floor(256 * np.asarray(v, dtype=np.float32).astype(float)) for i, v in enumerate(vectors) if v is not None and None not in v and np.isfinite(v).all()}
    want = []
    for q in sorted(x for x in ok if x % 10 == 0):
        best = sorted((-int(ok[q] @ v), i) for i, v in ok.items() if i != q)[:5]
        want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    assert got == want
    assert topk.search(df.limit(0)).count() == 0
    few = topk.search(df.where("vec_id < 3")).collect()
    assert [(r.query_id, r.rank) for r in few] == [(0, 1), (0, 2)]
