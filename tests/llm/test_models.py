"""The models' inner steps against enumeration, finite differences and plain loops."""

import itertools
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import pii, toxicity

TEXT = "call 555-123-4567 or jo@ab.com at 10.0.0.1 now"


def segmentations(n, segments):
    """All sets of segments that don't overlap."""
    def go(at):
        if at >= n:
            yield ()
            return
        yield from go(at + 1)
        for s in segments:
            if s[0] == at:
                for rest in go(s[1]):
                    yield (s, *rest)
    return list(go(0))


def weighted(seed):
    rng = random.Random(seed)
    toks = pii.tokens_of(TEXT)
    cands = pii.candidates(TEXT, toks)
    names = {name for f in cands.values() for name in ("bias", *f)}
    return toks, cands, {(k, name): rng.uniform(-1.5, 1.5) for k in pii.KINDS for name in names}


@pytest.mark.parametrize("seed", range(4))
def test_field_against_all_segmentations(seed):
    toks, cands, w = weighted(seed)
    segments = pii.scored(cands, w)
    every = segmentations(len(toks), segments)
    scores = [sum(s[4] for s in x) for x in every]
    total = math.log(sum(map(math.exp, scores)))
    found, log_sum = pii.marginals(len(toks), segments)
    assert log_sum == pytest.approx(total)
    for segment, p in zip(segments, found, strict=True):
        assert p == pytest.approx(sum(math.exp(v - total) for x, v in zip(every, scores, strict=True) if segment in x))
    best = max(zip(scores, every, strict=True), key=lambda x: x[0])
    assert pii.decode(TEXT, toks, w) == [(k, toks[i][0], toks[j - 1][1]) for i, j, k, _, _ in best[1]]


def test_field_gradient_by_finite_differences():
    toks, cands, w = weighted(9)
    gold = dict(itertools.islice({ij: "phone" for ij in cands}.items(), 1))

    def loglik(w):
        segments = pii.scored(cands, w)
        return sum(s[4] for s in segments if gold.get(s[:2]) == s[2]) - pii.marginals(len(toks), segments)[1]

    segments = pii.scored(cands, w)
    gradient = dict.fromkeys(w, 0.0)
    for (i, j, k, f, _), p in zip(segments, pii.marginals(len(toks), segments)[0], strict=True):
        for name in ("bias", *f):
            gradient[k, name] += (gold.get((i, j)) == k) - p
    for key in list(w)[::7]:
        up, down = dict(w), dict(w)
        up[key] += 1e-5
        down[key] -= 1e-5
        assert gradient[key] == pytest.approx((loglik(up) - loglik(down)) / 2e-5, abs=1e-5)


#: Written by hand, in shapes and words that the generator doesn't know.
REAL = [
    ("Please contact Maria Schmidt (maria.schmidt@uni-koeln.de), room 4.12, or ring +49 221 470-2233 before 17:30.", {("email", "maria.schmidt@uni-koeln.de"), ("phone", "+49 221 470-2233")}),
    ("The gateway at 192.168.1.254 answered 3 of 5 pings; firmware 2.4.1 was built on 2021-03-17.", {("ip", "192.168.1.254")}),
    ("Paid with Visa 4111 1111 1111 1111, order 20230415-77, total $1,249.00.", {("card", "4111 1111 1111 1111")}),
    ("For bookings dial (212) 555-0187 and ask for John; rooms from 89 to 140 euros, section 12.3.4.", {("phone", "(212) 555-0187")}),
    ("My address is jane.doe (at) example (dot) org, ISBN 978-3-16-148410-0.", {("email", "jane.doe (at) example (dot) org")}),
    ("In 1998 some 3,400 people lived there, 12.5 % fewer than in 1987; see pages 110-118.", set()),
]


def test_field_on_text_by_hand():
    w = dict(pii.trained())
    right = wrong = missed = 0
    for text, want in REAL:
        got = {(k, text[a:b]) for k, a, b in pii.find(text, w)[1]}
        right, wrong, missed = right + len(got & want), wrong + len(got - want), missed + len(want - got)
    assert right >= 6 and wrong <= 1 and missed <= 1


def test_ftrl_against_a_plain_loop():
    rng = random.Random(2)
    examples = [(np.array(sorted(rng.sample(range(16), rng.randint(1, 6))), dtype=np.int32), rng.randint(0, 1)) for _ in range(40)]
    alpha, beta, l1, l2, epochs, seed = 0.5, 1.0, 0.02, 0.1, 3, 5
    used, values, bias = toxicity.fit(examples, 4, alpha, beta, l1, l2, epochs, seed)
    z, n, bound = [0.0] * 17, [0.0] * 17, l1 * 40**0.5

    def weight(i):
        return 0.0 if abs(z[i]) <= bound else -(z[i] - math.copysign(bound, z[i])) / ((beta + math.sqrt(n[i])) / alpha + l2)

    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for at in order.permutation(40):
            ids, y = [*examples[at][0].tolist(), 16], examples[at][1]
            g = 1 / (1 + math.exp(-sum(map(weight, ids)))) - y
            now = [weight(i) for i in ids]
            for i, w in zip(ids, now, strict=True):
                sigma = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / alpha
                z[i] += g - sigma * w
                n[i] += g * g
    want = {i: weight(i) for i in range(16) if weight(i)}
    assert used.tolist() == sorted(want) and values.tolist() == pytest.approx([want[i] for i in sorted(want)]) and bias == pytest.approx(weight(16))


def test_toxicity_of_odd_rows(spark):
    """Repeated rows score alike, a very long text as its words, and repeated label rows don't pass the bound on the sample."""
    text = "you worthless clown " * 60_000
    rows = [(i, "nice quiet day by the sea" if i % 2 else "you worthless clown") for i in range(40)] + [(0, "you worthless clown")] * 3 + [(100, text), (101, None), (102, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("mine"))
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(40)] * 2, "doc_id long, toxic int")
    got = toxicity.score(docs, labels).collect()
    assert len(got) == len(rows) and len({r.score for r in got if r.doc_id == 0}) == 1
    by = {r.doc_id: r for r in got}
    assert by[100].score == by[101].score or by[100].score > by[101].score
    assert all(by[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i in by)
