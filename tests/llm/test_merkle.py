"""Merkle manifests against plain Python: null and empty sources, repeated ids and rows, lone leaves, sources over several blocks."""

import hashlib
import zlib

import pytest

from quillon.llm import merkle

DOCS = "doc_id long, source string, lang string, n_chars long, text string"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def coded(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def levels(leaves):
    out = [leaves]
    while len(out[-1]) > 1:
        out.append([H(*out[-1][i : i + 3]) for i in range(0, len(out[-1]), 3)])
    return out


def brute(docs):
    by = {}
    for r in docs:
        by.setdefault(r[1], []).append((r, H(*map(coded, r))))
    trees = {}
    for source in by:
        by[source].sort(key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1]))
        trees[source] = levels([leaf for _, leaf in by[source]])
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    top = levels([trees[s][-1][0] for s in order])
    out = []
    for rank, source in enumerate(order):
        for i, (r, leaf) in enumerate(by[source]):
            tried = leaf
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[4] is not None:
                tried = H(*map(coded, (*r[:4], r[4].replace("\n", ""))))
            siblings = []
            for tree, at in ((trees[source], i), (top, rank)):
                for level in tree[:-1]:
                    run = level[at // 3 * 3 : at // 3 * 3 + 3]
                    siblings += run[: at % 3] + run[at % 3 + 1 :]
                    tried = H(*run[: at % 3], tried, *run[at % 3 + 1 :])
                    at //= 3
            out.append((r[0], leaf, trees[source][-1][0], top[-1][0], H(*siblings), tried, tried == top[-1][0]))
    return sorted(out, key=str)


def rows(spark, docs):
    return sorted((tuple(r) for r in merkle.manifest(spark.createDataFrame(docs, DOCS).selectExpr("*", "'x' AS tree", "1 AS idx")).collect()), key=str)


def test_manifest_of_sources_of_all_sizes(spark):
    docs = [(i, "hot", "en", i, f"line {i % 97}\nend") for i in range(2500)]
    docs += [(i, f"s{i % 40}", None, None, "é\n" * (i % 3) or None) for i in range(3000, 3130)]
    docs += [(9000, None, "de", 3, "abc"), (9001, None, "de", 3, ""), (9002, "", "de", 3, "a\n"), (9003, "-", "xx", 3, "\n\n"), (9004, "snull", "xx", 3, "q")]
    docs += [(None, "hot", None, None, None), (None, "hot", "en", 1, "a\nb"), (2**62 + 1, "hot", "en", 1, "x"), (2**62 + 3, "hot", "en", 1, "x")]
    docs += [(7, "hot", "en", 7, "line 7\nend")] * 3 + [(8, "hot", "en", 7, "another\n")]
    got, want = rows(spark, docs), brute(docs)
    assert got == want
    assert 0 < sum(r[-1] for r in got) < len(got)


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 9, 10])
def test_small_manifests(spark, n):
    docs = [(i, "a", "en", 1, "t\n") for i in range(n)]
    assert rows(spark, docs) == brute(docs)


def test_coordinates_come_from_index_and_size_alone():
    import numpy as np

    row, level, idx = merkle.coordinates(np.array([0, 9, 5]), np.array([1, 10, 6]))
    assert sorted(zip(row.tolist(), level.tolist(), idx.tolist(), strict=True)) == [(1, 2, 0), (2, 0, 3), (2, 0, 4), (2, 1, 0)]


def test_a_proof_must_fit():
    with pytest.raises(ValueError, match="left over"):
        merkle.folded("a", 0, 1, ["b"])
