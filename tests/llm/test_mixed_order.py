"""Packing in the pipeline follows the mixing schedule, however the input's files lie."""

import random
from collections import Counter

import pytest

from quillon.llm import mixing

corpus_pipeline = pytest.importorskip("corpus_pipeline")

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_sequences_follow_the_schedule(spark, tmp_path):
    rng, first = random.Random(2), 0
    for source, n in (("a", 4000), ("b", 1200), ("c", 300)):  # a file for each source
        rows = [(first + i, " ".join(str(rng.random()) for _ in range(9 if source == "a" else 2)), "en", source, 60) for i in range(n)]
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/docs")
        first += n
    docs = spark.read.parquet(f"{tmp_path}/docs")
    coalesce = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        mixing.interleave(docs).write.parquet(f"{tmp_path}/mixed")  # the last files hold one source's long rows alone, and are read first
        pieces = corpus_pipeline.pack_sequences(spark, spark.read.parquet(f"{tmp_path}/mixed"), str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesce)
    place = {r.doc_id: r.position for r in mixing.positions(docs).collect()}
    order = list(dict.fromkeys(p.doc_id for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset))))
    assert len(order) == len(place) == first
    assert len({p.sequence_id >> 40 for p in pieces}) > 1  # several partitions
    # at every prefix of the sequences each source has about the share that the schedule gives it
    source = lambda d: "a" if d < 4000 else "b" if d < 5200 else "c"
    seen, due, worst = Counter(), Counter(), 0
    for got, want in zip(order, sorted(place, key=place.get), strict=True):
        seen[source(got)] += 1
        due[source(want)] += 1
        worst = max(worst, *(abs(seen[s] - due[s]) for s in "abc"))
    # a batch of 1,024 is packed longest first, which moves a source of share p by 1,024 p (1 - p) at most; some 80 short rows may wait
    assert worst <= 1024 // 4 + 80
