"""Mixing of more sources than one plan is simulated for."""

from collections import Counter

import pytest

from quillon.llm import mixing


@pytest.mark.parametrize("weights", [None, {"big": 3.0, "h1": 1.0, None: 1.0}])
def test_many_sources(spark, weights):
    names = ["big"] * 3000 + [f"h{i % 400}" for i in range(900)] + [None] * 200
    docs = spark.createDataFrame(list(enumerate(names)), "doc_id long, source string")
    rows = sorted(mixing.positions(docs, weights, block=4).collect(), key=lambda r: r.position)
    assert [r.position for r in rows] == list(range(len(names)))
    assert {(r.doc_id, r.source) for r in rows} == set(enumerate(names))
    assert all(a.slot <= b.slot and a.phase <= b.phase for a, b in zip(rows, rows[1:], strict=False))
    if weights is None:
        size = {s: names.count(s) for s in set(names)}
        target = {s: n**mixing.TEMPER for s, n in size.items()}
        assert rows[0].share == pytest.approx(target[rows[0].source] / sum(target.values()))
        reach = min(size[s] / target[s] for s in ("big", None))  # virtual time at which the first of both runs out
        share = target["big"] / (target["big"] + target[None])
        first = [r.source for r in rows if r.source in ("big", None)][: int(0.9 * reach * (target["big"] + target[None]))]
        assert all(abs(first[:k].count("big") - k * share) <= 8 for k in range(len(first)))
    else:
        given = sum(names.count(s) for s in weights)
        assert {r.source for r in rows[:given]} == set(weights) and not {r.source for r in rows[given:]} & set(weights)


def test_many_small_sources_leave_the_others_their_share(spark):
    """300 sources of one block beside three large ones: slots of the large ones and of the pool are within a block of their target."""
    names = ["a"] * 400 + ["b"] * 240 + ["c"] * 200 + [f"h{i}" for i in range(300)]
    rows = mixing.positions(spark.createDataFrame(list(enumerate(names)), "doc_id long, source string"), block=4).collect()
    served = {r.slot: (r.source, r.phase, r.share) for r in rows}
    first = [served[t] for t in sorted(served) if served[t][1] == 0]
    own = {s: n**mixing.TEMPER for s, n in Counter(names).items()}
    total, seen = sum(own.values()), Counter()
    assert len(first) > 300  # a small source that runs out ends no phase
    for k, (s, _, share) in enumerate(first, 1):
        assert share == pytest.approx(own[s] / total)
        seen[s[0]] += 1
        assert all(abs(seen[x] - k * sum(w for y, w in own.items() if y[0] == x) / total) < 1 for x in "abch")


@pytest.mark.parametrize("chunk", [7, 1 << 17])
def test_blocks_keep_their_size(spark, monkeypatch, chunk):
    """However many blocks there are, and however many slots are written at a time."""
    monkeypatch.setattr(mixing, "MAX_BLOCKS", 4, raising=False)
    monkeypatch.setattr(mixing, "CHUNK", chunk, raising=False)
    docs = spark.createDataFrame([(i, "ab"[i % 3 == 0]) for i in range(200)] + [(200, None), (201, "c")], "doc_id long, source string")
    rows = sorted(mixing.positions(docs, block=8).collect(), key=lambda r: r.position)
    assert [r.position for r in rows] == list(range(202))
    assert [r.slot for r in rows] == sorted(r.slot for r in rows)
    assert max(Counter((r.source, r.block) for r in rows).values()) == 8
