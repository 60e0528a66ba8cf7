"""The whole pipeline against its stages' brute-force versions on a small table."""

import random

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from test_lines import brute as brute_lines  # noqa: E402
from test_neardup import brute as brute_groups  # noqa: E402
from test_rowwise import brute_quality  # noqa: E402


def test_pipeline(spark, tmp_path):
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 9))) for _ in range(2500)]
    lines = [" ".join(rng.choice(words) for _ in range(rng.randint(4, 14))) for _ in range(300)]
    texts = [None, "", "few words", "x# y$ z% " * 5, " ".join(["same words here now again"] * 9)]
    for _ in range(120):
        texts.append("\n".join(rng.choice(lines) if rng.random() < 0.1 else " ".join(rng.choice(words) for _ in range(12)) for _ in range(rng.randint(1, 8))))
    for _ in range(30):
        copy = rng.choice(texts[5:]).split(" ")
        copy[rng.randrange(len(copy))] = rng.choice(words)
        texts.append(" ".join(copy))
    rows = [(i, t, "en", rng.choice(["hot", "hot", "a", None]), len(t or "")) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")

    kept = {}
    for i, t in enumerate(texts):
        n, chars, symbols, dup, repeat = brute_quality(t)
        n_lines = sum(bool(x.strip()) for x in (t or "").split("\n"))
        bad = n < 10 or 100 * repeat > 20 * n or 10 * symbols > 3 * n or not 2 * n <= chars <= 40 * n or (dup >= 3 and 2 * dup > n_lines)
        if not bad:
            kept[i] = t
    lined = {i: x[2] for i, x in brute_lines(list(kept.items())).items()}
    ids = sorted(lined)
    groups = brute_groups([lined[i] for i in ids])
    one = {ids[g] for _, g, _ in groups}

    stage = docs
    want = [set(kept), set(kept), one, one]
    for k, (name, f) in enumerate(corpus_pipeline.STAGES[:-1]):
        f(spark, stage, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        stage = spark.read.parquet(f"{tmp_path}/{k}")
        assert stage.columns == docs.columns, name
        got = {r.doc_id: r for r in stage.collect()}
        assert set(got) == want[k], name
        assert all(r.source == rows[i][3] and (k == 0 or r.text == lined[i]) for i, r in got.items()), name
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {p.doc_id for p in pieces} == one
    total = {p.doc_id: p.doc_tokens for p in pieces}
    for i in one:
        assert sum(p.length for p in pieces if p.doc_id == i) == total[i]
