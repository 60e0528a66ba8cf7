"""The queries of this package and their SQL: opN_<name> applies operator N to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import centroids, chat, lines, merkle, mixing, neardup, packing, passages, pii, quality, scoring, topk, toxicity
from .common import table, tokenizer_path

Query = Callable[[SparkSession, str], DataFrame]


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.positions(table(spark, sf_dir, "documents"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(table(spark, sf_dir, "documents"))


def op3_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op4_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.join(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    same = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", same), (-1, 1, "assistant", same)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    return chat.digests(chat.format_chat(turns.unionByName(extra)))


def op8_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.report(table(spark, sf_dir, "documents"))


def op9_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.remove_repeats(table(spark, sf_dir, "documents"))


def op10_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"))


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"))


def op12_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.score(table(spark, sf_dir, "documents"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    found = (op1_mix, op2_pii, op3_pack, op4_neardup, op5_toxicity, op6_quality, op7_chat, op8_lines, op9_passages, op10_search, op11_centroids, op12_lm, op13_merkle)
    return {f.__name__: f for f in found}


OP6_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (
    SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
           list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
    FROM d
),
grams AS (
    SELECT doc_id, i, list_aggregate(words[i:i + 4], 'string_agg', ' ') AS gram
    FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM w WHERE len(words) >= 5)
),
twice AS (
    SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM grams) WHERE n > 1
),
covered AS (
    SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest(range(0, 5)) AS k) GROUP BY doc_id
),
f AS (
    SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words,
           CAST(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
           CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
           CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
           CAST(len(lines) AS BIGINT) AS n_lines,
           CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words
    FROM w LEFT JOIN covered ON w.doc_id = covered.doc_id
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words OR n_symbols * 10 > n_words * 3
            OR word_chars < 2 * n_words OR word_chars > 40 * n_words
            OR (n_dup_lines >= 3 AND n_dup_lines * 2 > n_lines)) AS kept
FROM f
"""

OP8_SQL = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(0, len(ls))) AS no FROM d),
t AS (SELECT doc_id, no, line, list_sort(list_distinct(regexp_extract_all(line, '[^\x20\x09-\x0D]+'))) AS ws FROM l),
c AS (
    SELECT row_number() OVER (ORDER BY doc_id, no) AS id, doc_id, no, ws, len(ws) AS n
    FROM (SELECT * FROM t WHERE len(ws) > 0 QUALIFY row_number() OVER (PARTITION BY ws ORDER BY doc_id, no) = 1)
),
p AS (SELECT id, n, unnest(ws) AS tok FROM c),
f AS (SELECT tok, count(*) AS df FROM p GROUP BY tok),
r AS (SELECT p.id, n, p.tok, row_number() OVER (PARTITION BY p.id ORDER BY df, p.tok) AS pos FROM p JOIN f USING (tok)),
pre AS (SELECT * FROM r WHERE pos <= n - (4 * n + 4) // 5 + 1),
pairs AS (
    SELECT DISTINCT a.id AS x, b.id AS y FROM pre a JOIN pre b
    ON a.tok = b.tok AND a.id < b.id AND 5 * a.n >= 4 * b.n AND 5 * b.n >= 4 * a.n
),
gone AS (
    SELECT DISTINCT y FROM pairs JOIN c cx ON cx.id = x JOIN c cy ON cy.id = y
    WHERE 9 * len(list_intersect(cx.ws, cy.ws)) >= 4 * (cx.n + cy.n)
),
kept AS (SELECT doc_id, no FROM c WHERE id NOT IN (SELECT y FROM gone)),
marked AS (
    SELECT t.doc_id, t.no, t.line, len(t.ws) > 0 AS worded, k.no IS NOT NULL AS stays
    FROM t LEFT JOIN kept k ON t.doc_id = k.doc_id AND t.no = k.no
)
SELECT doc_id, CAST(sum(CASE WHEN worded THEN 1 ELSE 0 END) AS BIGINT) AS n_lines,
       CAST(sum(CASE WHEN worded AND NOT stays THEN 1 ELSE 0 END) AS BIGINT) AS n_removed,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY no) FILTER (WHERE stays OR NOT worded), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

OP10_SQL = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS x FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
s AS (
    SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.x, c.x) AS BIGINT) AS score
    FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""


def _op11_sql(k: int = 40, rounds: int = 5, width: int = 64, seed: int = 2) -> str:
    """One block of assignments and floored means for each round."""
    sql = f"""
WITH v AS MATERIALIZED (
    SELECT vec_id, row_number() OVER () AS no, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
    WHERE embedding IS NOT NULL AND len(embedding) = {width} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
e AS (SELECT no, unnest(x) AS x, unnest(range(0, {width})) AS d FROM v),
c0 AS (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id) NULLS LAST, x) - 1 AS c, x FROM v QUALIFY c < {k})
"""
    near = "SELECT no, arg_min(c, (far, c)) AS c, min(far) AS far FROM (SELECT no, c, list_sum(list_transform(list_zip(v.x, q.x), lambda z: CAST((z[1] - z[2]) * (z[1] - z[2]) AS BIGINT))) AS far FROM v, c{r} q) GROUP BY no"
    for r in range(rounds):
        sql += f""", a{r} AS ({near.format(r=r)}),
m{r} AS (
    SELECT c, list(f ORDER BY d) AS x FROM (
        SELECT c, d, CAST((s - ((s % n) + n) % n) // n AS BIGINT) AS f FROM (SELECT c, d, sum(CAST(x AS HUGEINT)) AS s, count(*) AS n FROM e JOIN a{r} USING (no) GROUP BY c, d)
    ) GROUP BY c
),
c{r + 1} AS (SELECT c, coalesce(m{r}.x, c{r}.x) AS x FROM c{r} LEFT JOIN m{r} USING (c))
"""
    return sql + f""", z AS ({near.format(r=rounds)})
SELECT vec_id, CAST(c AS INTEGER) AS cluster, CAST(far AS BIGINT) AS distance, CAST(sum(far) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
       CAST(sum(far) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c{rounds}.x, ',')) AS centroid_sha256
FROM z JOIN v USING (no) JOIN c{rounds} USING (c)
"""


#: crc32 (polynomial 0xEDB88320) of the decimal doc_id, bit by bit.
CRC_SQL = """xor(list_reduce(
        list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)),
        lambda c, b: list_reduce([0, 1, 2, 3, 4, 5, 6, 7], lambda x, k: xor(x >> 1, (x & 1) * 3988292384), xor(c, b)), CAST(4294967295 AS BIGINT)), 4294967295)"""


def _coded(*columns: str) -> str:
    return " || ".join(f"coalesce(octet_length(encode(CAST({c} AS VARCHAR))) || ':' || CAST({c} AS VARCHAR), '-')" for c in columns)


OP13_SQL = f"""
WITH RECURSIVE d AS MATERIALIZED (
    SELECT doc_id, source, {CRC_SQL} AS crc, sha256({_coded("doc_id", "source", "lang", "n_chars", "text")}) AS leaf,
           sha256({_coded("doc_id", "source", "lang", "n_chars", "replace(text, chr(10), '')")}) AS tried
    FROM documents
),
p AS MATERIALIZED (
    SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) AS tree, count(*) OVER (PARTITION BY source) AS n,
           row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx FROM d
),
nodes AS (
    SELECT tree, 0 AS level, idx, n, leaf AS digest FROM p
    UNION ALL
    SELECT tree, level + 1, idx // 3, (n + 2) // 3, sha256(string_agg(digest, '' ORDER BY idx)) FROM nodes WHERE n > 1 GROUP BY tree, level, idx // 3, n
),
s AS MATERIALIZED (SELECT tree, digest AS subroot, tree - 1 AS rank, count(*) OVER () AS m FROM nodes WHERE n = 1),
tops AS (
    SELECT 0 AS level, rank AS idx, m AS n, subroot AS digest FROM s
    UNION ALL
    SELECT level + 1, idx // 3, (n + 2) // 3, sha256(string_agg(digest, '' ORDER BY idx)) FROM tops WHERE n > 1 GROUP BY level, idx // 3, n
),
walk AS (
    SELECT doc_id, tree, leaf, idx AS at, n AS left_, 0 AS level, false AS top, '' AS proof,
           CASE WHEN crc % 2 = 0 AND text_changes THEN tried ELSE leaf END AS fold
    FROM (SELECT *, tried <> leaf AS text_changes FROM p)
    UNION ALL
    SELECT * FROM (
        WITH w AS (SELECT w.*, s.rank, s.m FROM walk w JOIN s USING (tree) WHERE w.left_ > 1 OR NOT w.top)
        SELECT doc_id, tree, leaf, rank, m, 0, true, proof, fold FROM w WHERE left_ <= 1 AND NOT top
        UNION ALL
        SELECT w.doc_id, w.tree, w.leaf, w.at // 3, (w.left_ + 2) // 3, w.level + 1, w.top,
               w.proof || coalesce(string_agg(k.digest, '' ORDER BY k.idx) FILTER (WHERE k.idx <> w.at), ''),
               sha256(string_agg(CASE WHEN k.idx = w.at THEN w.fold ELSE k.digest END, '' ORDER BY k.idx))
        FROM w JOIN (SELECT tree, level, idx, digest, false AS top FROM nodes UNION ALL SELECT s.tree, level, idx, digest, true FROM tops, s) k
          ON k.tree = w.tree AND k.level = w.level AND k.top = w.top AND k.idx // 3 = w.at // 3
        WHERE w.left_ > 1 GROUP BY w.doc_id, w.tree, w.leaf, w.at, w.left_, w.level, w.top, w.proof, w.fold
    )
)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = root AS verified
FROM walk JOIN s USING (tree), (SELECT digest AS root FROM tops WHERE n = 1) WHERE top AND left_ <= 1
"""


def oracle_sql() -> dict[str, str]:
    return {"op13_merkle": OP13_SQL, "op11_centroids": _op11_sql(), "op6_quality": OP6_SQL, "op8_lines": OP8_SQL, "op10_search": OP10_SQL}
