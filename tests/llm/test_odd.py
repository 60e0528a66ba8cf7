"""Odd inputs: repeated rows, very long texts, edges of pieces, large scores, empty tables, clashing columns."""

import hashlib
import random

import numpy as np
import pytest

from quillon.llm import chat, passages, pii, topk
from quillon.llm.common import materialize, release, shared_dir

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_pii_of_repeated_rows_and_a_long_text(spark):
    long = "nothing to see here, " * 20_000 + "call (212) 555-0187 or a@b.org " + "and nothing there " * 20_000
    docs = spark.createDataFrame([(1, "a@b.org"), (1, "a@b.org"), (2, long), (3, None)], "doc_id long, text string").selectExpr("*", "'x' AS spans", "1 AS n_email")
    rows = pii.detect(docs).collect()
    assert len(rows) == 4 and rows[0] == rows[1]
    by = {r.doc_id: r for r in rows}
    at = long.index("(212)")
    assert by[2].n_email == 1 and f"phone:{at}:{at + 14}" in by[2].spans.split(",") and by[3].spans == ""


def test_chat_of_a_long_text(spark):
    text = "[INST] é\\ " * 200_000
    turns = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", text), (1, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    (row,) = chat.digests(chat.format_chat(turns)).collect()
    assert (row.n_turns, row.loss_chars) == (3, 2 * len(text)) and row.loss_sha256 == hashlib.sha256((text * 2).encode()).hexdigest()


def test_passages_over_the_edge_of_a_piece(spark):
    """A passage that crosses the end of a text's first piece, and one that ends the text, are found with the default sizes."""
    rng = random.Random(1)
    noise = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(passages.PIECE + 3000))
    one, two = ("".join(rng.choice("ABCDEFGHIJKLM") for _ in range(700)) for _ in range(2))
    cut = passages.PIECE - 350
    long = noise[:cut] + one + noise[cut:] + two
    docs = spark.createDataFrame([(1, long), (2, f"x {one} y"), (3, two), (4, two[:399])], "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in passages.remove_repeats(docs).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert got == {1: (len(long), 1400, 2, sha(noise)), 2: (704, 700, 1, sha("x  y")), 3: (700, 700, 1, sha("")), 4: (399, 0, 0, sha(two[:399]))}


@pytest.mark.parametrize("scale", [1.0, 1e6])
def test_search_of_repeated_rows_and_large_scores(spark, scale):
    """Scores past 2**53 are exact; rows that share a query's id are its own, other repeated rows are candidates each."""
    rng = np.random.default_rng(4)
    vectors = (rng.normal(0, 1, (120, 8)) * scale).tolist()
    ids = [*range(110), *range(10)]  # ten ids come twice, 0 among them
    df = spark.createDataFrame(list(zip(ids, vectors, strict=True)), "vec_id long, embedding array<double>")
    whole = [[int(np.floor(256 * x)) for x in v] for v in vectors]
    want = []
    for q in sorted({i for i in ids if i % 50 == 0}):
        found = sorted((-sum(a * b for a, b in zip(whole[r], whole[c], strict=True)), ids[c]) for r in range(120) if ids[r] == q for c in range(120) if ids[c] != q)
        want += [(q, k + 1, v, -s) for k, (s, v) in enumerate(found[:5])]
    for wave in (4096, 2):
        assert [tuple(r) for r in topk.search(df, wave=wave).orderBy("query_id", "rank").collect()] == want
    assert scale == 1.0 or max(abs(w[3]) for w in want) > 2**53
    with pytest.raises(ValueError, match="2\\*\\*63"):
        topk.search(df.selectExpr("vec_id", "transform(embedding, x -> x * 1e9 * 1e6) AS embedding"))


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_pipeline_of_odd_tables(spark, tmp_path):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(900)]
    texts = [" ".join(rng.choice(words) for _ in range(40)) for _ in range(6)]
    clash = ["'a' AS m_source", "1 AS n_id", "2 AS q_words", "3 AS d_text", "4 AS row", "5 AS line", "6 AS key"]
    rows = [(i, t, "en", None, len(t)) for i, t in enumerate(texts)]
    for name, table in {"empty": [], "repeated": rows + rows}.items():
        docs = spark.createDataFrame(table, DOCS).selectExpr("*", *clash)
        docs.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        stage = docs
        for _, f in corpus_pipeline.STAGES[:-1]:
            stage = f(spark, stage, f"{tmp_path}/{name}")
            assert stage.columns == docs.columns
        pieces = corpus_pipeline.run(spark, f"{tmp_path}/{name}").collect()
        assert {p.doc_id for p in pieces} == {r[0] for r in table}


def test_written_tables_are_added_to_and_released(spark):
    a = materialize(spark.range(3), "here")
    b = materialize(spark.range(5, 7), "ignored", a)
    assert sorted(r.id for r in b.collect()) == [0, 1, 2, 5, 6] and a.inputFiles()[0].rsplit("/", 1)[0] == b.inputFiles()[0].rsplit("/", 1)[0]
    release(b)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(b.inputFiles()[0]).getParent()
    assert not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")
