"""Packing, quality and chat against brute force."""

import hashlib
import random
import re
import zlib

import pytest
import regex
from pyspark.sql import functions as F

from quillon.llm import chat, packing, quality
from quillon.llm.common import tokenizer_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long, length int"


def made(spark, texts):
    return spark.createDataFrame([(i, t, None, "s", None, 7) for i, t in enumerate(texts)], DOCS)


TEXTS = [None, "", " \n\t ", "one", "a b c d e f", "a b c d e a b c d e", "x\nx\n\nx y\nx y", "w " * 4000, "Ere## $$ <|endoftext|> it's 12 don’t\x1cX é", "a\x0bb\x0cc\rd e f g h i j " * 3, "ß ñ " * 700]


def test_pack(spark):
    from tokenizers import Tokenizer

    rng = random.Random(1)
    texts = TEXTS + [" ".join(rng.choice(["alpha", "beta", "Gam-ma", "dél'ta"]) for _ in range(rng.randint(1, 900))) for _ in range(60)]
    rows = packing.pack(made(spark, texts).coalesce(2), tokenizer_path()).collect()
    t = Tokenizer.from_file(tokenizer_path())
    ids = {i: [*t.encode(x or "", add_special_tokens=False).ids, 1] for i, x in enumerate(texts)}
    by_doc, by_seq = {}, {}
    for r in rows:
        piece = ids[r.doc_id][r.start : r.start + r.length]
        assert r.doc_tokens == len(ids[r.doc_id]) and r.ids_crc32 == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in piece))
        by_doc.setdefault(r.doc_id, []).append((r.start, r.length))
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert by_doc.keys() == ids.keys()
    for d, pieces in [*by_doc.items(), *by_seq.items()]:
        at = 0
        for start, length in sorted(pieces):
            assert start == at and length > 0
            at += length
    assert all(sum(x[1] for x in by_doc[d]) == len(ids[d]) for d in ids)
    sizes = [sum(x[1] for x in s) for s in by_seq.values()]
    assert max(sizes) <= 2048
    padding = sum(0 if n & (n - 1) == 0 else 2048 - n for n in sizes)
    assert padding <= 2 * 2048
    assert packing.pack(made(spark, []), tokenizer_path()).count() == 0


def test_step_groups_are_balanced(spark):
    """In each partition and tier all groups but the last ones hold the step's tokens exactly, and their attention costs are near."""
    rng = random.Random(5)
    texts = [" ".join(rng.choice(["alpha", "beta", "gamma"]) for _ in range(rng.choice([30, 120, 300, 800]))) for _ in range(1500)]
    rows = packing.pack(made(spark, texts).coalesce(1), tokenizer_path(), step_tokens=4096).collect()
    tokens, cost, tier = {}, {}, {}
    for r in rows:
        tokens[r.step_group] = tokens.get(r.step_group, 0) + r.length
        cost[r.step_group] = cost.get(r.step_group, 0) + r.length**2
        assert tier.setdefault(r.step_group, r.tier) == r.tier
    assert sorted(g & ((1 << 40) - 1) for g in tokens) == list(range(len(tokens)))
    for t in packing.TIERS:
        own = [g for g in tokens if tier[g] == t]
        assert len(own) < 3 * packing.DEAL or sum(tokens[g] == 4096 for g in own) >= len(own) - packing.DEAL
        by_deal = [own[i : i + packing.DEAL] for i in range(0, len(own) - packing.DEAL, packing.DEAL)]
        assert all(max(cost[g] for g in deal) <= 1.5 * min(cost[g] for g in deal) for deal in by_deal)
    assert packing.balanced([9, 1, 8, 2, 7, 3], 3) == [0, 0, 1, 1, 2, 2] and packing.balanced([], 0) == []


def test_words_are_those_of_the_tokenizer():
    """On every sign that the word pattern is used for, alone and in mixed strings, it finds what the tokenizer's own does."""
    own = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
    signs = [c for c in map(chr, range(0x2100)) if not packing.WordEncoder.OTHER.search(c)]
    assert len(signs) > 500 and all(own.findall(c.lower()) == packing.WordEncoder.PATTERN.findall(c.lower()) for c in signs)
    rng = random.Random(3)
    for _ in range(20_000):
        text = "".join(rng.choice(signs) if rng.random() < 0.5 else rng.choice("'strevmld 7") for _ in range(rng.randint(1, 12))).lower()
        assert own.findall(text) == packing.WordEncoder.PATTERN.findall(text)


@pytest.mark.parametrize("entries", [2, 5, 40])
def test_a_full_word_cache_changes_nothing(entries):
    from tokenizers import Tokenizer

    rng, own = random.Random(4), Tokenizer.from_file(tokenizer_path())
    words = ["alpha", "beta", "gammaray", "dél", "x1", "it's", "quietly", "zzz", "hello", "world"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.choice([1, 4, 30]))) for _ in range(60)]
    got = packing.WordEncoder(tokenizer_path(), entries).encode(texts, 1)
    assert [x.tolist() for x in got] == [[*own.encode(t, add_special_tokens=False).ids, 1] for t in texts]


def test_pack_of_repeated_rows(spark):
    docs = made(spark, ["a b c", "d e"])
    rows = packing.pack(docs.union(docs).coalesce(1), tokenizer_path()).collect()
    assert sorted((r.doc_id, r.start) for r in rows) == [(0, 0), (0, 0), (1, 0), (1, 0)] and len({r.offset for r in rows}) == 4


def brute_quality(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    from collections import Counter

    n = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if n[w] > 1 for k in range(5)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_quality(spark):
    rng = random.Random(2)
    texts = TEXTS + [" ".join(rng.choice("abc") for _ in range(rng.randint(3, 60))) for _ in range(80)]
    for r in quality.judge(made(spark, texts)).collect():
        want = brute_quality(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, texts[r.doc_id]
        failed = want[0] < 10 or 100 * want[4] > 20 * want[0]
        assert r.base_failed == failed and not (failed and r.kept)
    assert quality.judge(made(spark, [])).count() == 0
    kept = quality.keep_good(made(spark, texts))
    assert kept.columns == made(spark, []).columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in quality.judge(made(spark, texts)).where("kept").collect()}


def test_chat_round_trip(spark):
    same = "</s>[INST] ok [/INST]"
    odd = ["", None, "\\", "\\\\[INST]", "<s", "[/INST", "é[OUT]ü", "a\nb", "[ROLE] x[/ROLE] y[/TURN]", " ", same, "<", "</s", "ü" * 300]
    roles = ["user", "assistant", "system", "tool", None, "[/ROLE] ", "assistant"]
    rng = random.Random(3)
    rows = [(c, t, rng.choice(roles), rng.choice(odd), 1) for c in [None, -1, *range(40)] for t in range(rng.randint(1, 7))]
    rows += [(5, None, "user", "first", 1), (7, 0, "user", "tie", 1), (7, 0, "user", "tie", 1)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, n_turns int")
    got = {r.conv_id: r for r in chat.digests(chat.format_chat(df)).collect()}
    by = {}
    for c, t, role, text, _ in rows:
        by.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    assert got.keys() == by.keys()
    for c, turns in by.items():
        turns = sorted(turns, key=lambda x: (x[0], x[1], x[2].encode(), x[3].encode()))
        loss = "".join(t for *_, r, t in turns if r == "assistant")
        r = got[c]
        assert r.n_turns == len(turns)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for *_, a, b in turns).encode()).hexdigest()
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.digests(chat.format_chat(df.limit(0))).count() == 0


@pytest.mark.parametrize("text", ["plain", "[INST]\\", "\\[", "</s></s>", "[[INST]"])
def test_escape(text):
    assert chat.unescape(chat.escape(text)) == text


def test_cascade_skips_the_rules_behind_one_that_rejects(spark):
    """A rule that would fail the whole job on rejected rows is never evaluated for them."""
    docs = made(spark, ["few", "one two three", "a text of ten words and some more of them here", None])
    bad = F.col("q_text").rlike("^(few|one.*|)$")
    first, second = quality.Rule("first", bad), quality.Rule("second", F.when(bad, F.raise_error(F.lit("evaluated")).cast("boolean")).otherwise(F.lit(False)))
    assert [r.doc_id for r in quality.keep_good(docs, [second, first], ["first", "second"]).collect()] == [2]
    with pytest.raises(Exception, match="evaluated"):
        quality.keep_good(docs, [second, first], ["second", "first"]).collect()


def test_production_rules_stand_in_branches(spark):
    """The plan computes the dear figures inside the CASE of the filter, not in a projection below it."""
    docs = made(spark, TEXTS)
    plan = quality.keep_good(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("xxhash64") == plan[plan.index("Filter") : plan.index("Project", plan.index("Filter"))].count("xxhash64") > 0
    names = quality.production(docs)[1]
    assert sorted(names) == ["duplicate_lines", "repeated_windows", "symbols", "too_few_words", "word_length"]


def test_quality_keeps_columns_of_clashing_names(spark):
    docs = made(spark, ["a text of ten words and some more of them here"] * 2).selectExpr("*", "'mine' AS q_words", "5 AS row", "7 AS n_words", "1 AS q_barrier")
    docs = docs.union(docs)
    judged = quality.judge(docs).collect()
    assert len(judged) == 4 and len(set(judged)) == 2
    assert {(r.q_words, r.row, r.q_barrier, r.n_words) for r in judged} == {("mine", 5, 1, 11)}
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns and kept.count() == 4 and {r.n_words for r in kept.collect()} == {7}
