"""Line deduplication against brute force."""

import hashlib
import random

import pytest

from quillon.llm import lines

DOCS = "doc_id long, text string, lang string, n_chars int, line string, tokens int"


def made(spark, rows):
    return spark.createDataFrame([(i, t, None, -1, "x", 1) for i, t in rows], DOCS)


def brute(rows):
    """Text that stays for each row, in order of id."""
    seen, out = [], {}
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        if t is None:
            out[i] = (0, 0, None)
            continue
        kept, n = [], 0
        for line in t.split("\n"):
            tokens = frozenset(w for w in line.replace("\t", " ").replace("\r", " ").split(" ") if w)
            if not tokens:
                kept.append(line)
                continue
            n += 1
            if not any(5 * len(tokens & s) >= 4 * len(tokens | s) for s in seen):
                kept.append(line)
            seen.append(tokens)
        out[i] = (n, n - sum(bool(k.strip(" \t\r")) for k in kept), "\n".join(kept))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_lines(spark, seed):
    rng = random.Random(seed)
    words = [f"w{min(int(rng.paretovariate(0.6)), 400)}" for _ in range(4000)]
    pool = [[rng.choice(words) for _ in range(rng.choice([1, 2, 3, 4, 5, 6, 9, 12, 20, 30]))] for _ in range(120)]

    def line():
        base = list(rng.choice(pool))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
            base[rng.randrange(len(base))] = rng.choice(words)
        rng.shuffle(base)
        return rng.choice([" ", "  ", "\t"]).join(base)

    rows = [(i, "\n".join(rng.choice([line(), line(), line(), "", " "]) for _ in range(rng.randint(1, 8)))) for i in range(150)]
    rows += [(150, None), (151, ""), (152, "\n\n"), (None, "null id line one two three four"), (153, "null id line one two three five")]
    rng.shuffle(rows)
    want = brute(rows)
    got = {r.doc_id: r for r in lines.report(made(spark, rows)).collect()}
    assert got.keys() == want.keys()
    for i, (n, removed, text) in want.items():
        assert (got[i].n_lines, got[i].n_removed) == (n, removed), i
        assert got[i].kept_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    out = lines.dedupe(made(spark, rows))
    assert out.columns == made(spark, []).columns
    for r in out.collect():
        assert r.text == want[r.doc_id][2] and r.n_chars == (None if r.text is None else len(r.text)) and r.line == "x"


def test_lines_of_repeated_rows(spark):
    docs = made(spark, [(1, "a b\nc d"), (1, "a b\nc d"), (1, "e f\nc d"), (2, "a b\ng")])
    rows = [tuple(r)[:3] for r in lines.report(docs).collect()]
    assert len(rows) == 4 and (2, 2, 1) in rows and sum(r[0] == 1 for r in rows) == 3
    by_text = {}
    for r in lines.dedupe(docs).collect():
        by_text.setdefault(r.doc_id, []).append(r.text)
    assert len(set(by_text[1])) == 2 and "\n".join(sorted(set(by_text[1]))).count("c d") == 1
    assert lines.report(docs.limit(0)).count() == 0 and lines.dedupe(docs.limit(0)).count() == 0


def test_lines_with_common_words_and_long_lists(spark, monkeypatch):
    """Every way through the join: pairs of common words, leads, lists dealt over tasks, lines with maps in two halves."""
    monkeypatch.setattr(lines, "COMMON", 6)
    monkeypatch.setattr(lines, "SHARE", 1)
    monkeypatch.setattr(lines, "LED", 3)
    monkeypatch.setattr(lines, "DEALT", 5)
    rng = random.Random(8)
    words = [f"w{i}" for i in range(60)]
    base = [f"b{i}" for i in range(20)] + words[:10]
    rows = []
    for i in range(90):
        mine = list(base if i % 3 == 0 else rng.sample(words, rng.choice([4, 5, 6, 8, 30])))
        for _ in range(rng.choice([0, 1, 2, 4])):
            mine[rng.randrange(len(mine))] = rng.choice(words)
        far = [f"f{k}" for k in range(90)]
        for _ in range(rng.choice([3, 12])):
            far[rng.randrange(90)] = rng.choice(words)
        rows.append((i, " ".join(mine) + "\n" + " ".join(rng.sample(words, 5)) + ("\n" + " ".join(far) if i % 9 == 0 else "")))
    want = brute(rows)
    got = {r.doc_id: r for r in lines.report(made(spark, rows)).collect()}
    for i, (n, removed, text) in want.items():
        assert (got[i].n_lines, got[i].n_removed, got[i].kept_sha256) == (n, removed, hashlib.sha256(text.encode()).hexdigest()), i
    assert sum(x[1] for x in want.values()) > 20
