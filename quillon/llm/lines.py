"""Line deduplication as an exact set-similarity join, in DataFrame functions only.

The tokens of a line are its distinct words. A line goes if an earlier line (by doc_id, then line number) has a Jaccard similarity
of at least NUM / DEN with it. Tokens are ordered by rarity: the words of one of SHARE lines, counted in RANKS hash buckets, give every token
of all lines one sortable number, so no shuffle is needed to order a line's tokens. Any order of the tokens gives the same result; a good one saves time. Then:

1. lines with equal token sets become one class, led by its earliest line; all others go;
2. a line of n tokens posts the rarest n - ceil(NUM * n / DEN) + 1 of them (prefix filter); similar lines share one of these. Where
   a token of the prefix is common (its bucket counts more than COMMON words), the line posts it with each later token of a prefix one
   longer instead: similar lines share two tokens of that, so lists stay short however large the corpus is;
3. keys that look frequent on a share of the lines get some leads, early lines there, and every line is held against the leads of its
   keys first: most near copies of one line go here, without meeting each other pair by pair;
4. a self-join of the postings gives the other candidates of the lines left, under length and positional filters and a bound from parity
   maps of the sets; the longest lists are dealt over several tasks;
5. candidates are verified on the full token sets.

Which keys count as frequent changes only the time, never the lines that go.

Defined results: a null text stays null and has no lines; lines without a word stay; an empty table gives no rows; rows that repeat
(equal id and text) get equal results, and of rows that share an id the text's checksum decides the order; other columns
pass through ``dedupe`` untouched.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, materialize, maybe_broadcast
from .quality import bound, trimmed

NUM, DEN = 4, 5
RANKS = 1 << 20
#: A token is common from this number of words in its bucket on.
COMMON = 2048
#: One of SHARE lines tells which keys are frequent, and leads them: keys with LED lines or more (by that share), the most frequent KEYS
#: of them, have LEADS leads each, the earliest of as many classes; lists of DEALT lines or more are dealt over tasks.
SHARE, LED, KEYS, LEADS, DEALT = 8, 512, 1 << 13, 32, 8192
#: Lines of this many tokens and more have their parity map in two halves.
WIDE = 72
_TAIL = 56  # bits of a token's hash below its rank


def _level(count: np.ndarray | float) -> np.ndarray:
    return np.minimum(127, np.floor(4 * np.log2(np.asarray(count) + 1))).astype(np.int8)


def _words(line: Column) -> Column:
    """The words of a line, and the empty strings between blanks."""
    odd = line.contains("\t") | line.contains("\x0b") | line.contains("\x0c") | line.contains("\r")
    return F.split(F.when(odd, F.translate(line, "\t\x0b\x0c\r", "    ")).otherwise(line), " ", -1)


def _sets(line: Column) -> Column:
    """Distinct hashes of the words of a line."""
    return F.array_distinct(F.array_remove(F.transform(_words(line), lambda w: F.xxhash64(w)), F.xxhash64(F.lit(""))))


def word_ranks(docs: DataFrame) -> Column:
    """One small array of the query: for each hash bucket, a level (0 to 127) that grows with the words of the corpus in it.

    The words are those of one of SHARE lines, by the lines' hashes: the levels order tokens and decide nothing else. The array comes as a
    scalar subquery, so that plans hold a reference to it. RANKS bounds it, whatever the vocabulary.
    """
    lines = docs.select(F.explode(F.split("d_text", "\n", -1)).alias("text")).where(F.pmod(F.xxhash64("text"), F.lit(SHARE)) == 0)
    words = lines.select(F.explode(_words(F.col("text"))).alias("w"))
    found = words.groupBy(F.xxhash64("w").bitwiseAND(RANKS - 1).cast("int").alias("b")).count().toArrow()
    counts = np.zeros(RANKS)
    counts[np.asarray(found.column(0))] = np.asarray(found.column(1)) * SHARE
    array = pa.ListArray.from_arrays(pa.array([0, RANKS], pa.int32()), pa.array(_level(counts)))
    return docs.sparkSession.createDataFrame(pa.table({"levels": array})).scalar()


def _ordered(hashes: Column, levels: Column) -> Column:
    """Tokens as numbers, rarest first."""
    key = lambda h: F.shiftleft(F.get(levels, h.bitwiseAND(RANKS - 1).cast("int")).cast("long"), _TAIL).bitwiseOR(F.shiftrightunsigned(h, 64 - _TAIL))
    return F.sort_array(F.transform(hashes, key))


def prefix_length(n: Column) -> Column:
    return n - F.ceil(n * F.lit(NUM) / F.lit(DEN)).cast("int") + 1


def _line_key(h: Column, number: Column) -> Column:
    return F.shiftleft(h.cast("long"), 31).bitwiseOR(number.cast("long"))


def _identified(docs: DataFrame, *more: Column) -> tuple[DataFrame, bool]:
    """Rows of d_doc, d_hash (0 unless some id repeats), d_text and more columns; whether some id repeats."""
    rows = docs.select(F.col("doc_id").cast("long").alias("d_doc"), F.col("text").cast("string").alias("d_text"), *more)
    repeats = rows.groupBy("d_doc").count().where("count > 1").limit(1).count() > 0
    return rows.withColumn("d_hash", F.coalesce(F.crc32(F.col("d_text").cast("binary")), F.lit(0)) if repeats else F.lit(0).cast("long")), repeats


def classes(docs: DataFrame, ranks: Column) -> DataFrame:
    """The first line of each token set: doc, line (key), n, bits and more (parity maps), prefix (31 bits of each token of a prefix one
    longer; empty for lines that have no other similar set), rare (tokens of the prefix before the first common one)."""
    split = docs.select("d_doc", "d_hash", F.posexplode(F.split("d_text", "\n", -1)).alias("number", "text"))
    rows = split.select(F.struct(F.col("d_doc").alias("doc"), _line_key(F.col("d_hash"), F.col("number")).alias("line")).alias("id"), _sets(F.col("text")).alias("hashes"))
    rows = rows.withColumn("levels", ranks).select("id", _ordered(F.col("hashes"), F.col("levels")).alias("tokens"))  # rows never hold the levels
    none, n = F.lit(0).cast("long"), F.size("tokens")
    bit = lambda x: F.call_function("shiftleft", F.lit(1).cast("long"), x.bitwiseAND(63).cast("int"))
    parity = F.aggregate("tokens", none, lambda acc, x: acc.bitwiseXOR(bit(x)))
    half = lambda k: F.aggregate("tokens", none, lambda acc, x: F.when(x.bitwiseAND(64) == k, acc.bitwiseXOR(bit(x))).otherwise(acc))
    first = (int(_level(COMMON)) + 1) << _TAIL
    rows = rows.select(
        "id", n.alias("n"), F.when(n >= WIDE, half(0)).otherwise(parity).alias("bits"), F.when(n >= WIDE, half(64)).otherwise(none).alias("more"), F.xxhash64("tokens").alias("h1"), F.xxhash64(F.lit(7), "tokens").alias("h2"),
        F.slice("tokens", F.lit(1), F.when(n > 3, prefix_length(n) + 1).otherwise(0)).alias("prefix"),
    )
    short = F.transform("prefix", lambda x: x.bitwiseAND(0x7FFFFFFF).cast("int"))
    rare = F.least(F.size(F.filter("prefix", lambda x: x < first)), F.size("prefix") - 1)
    rows = rows.select("id", "n", "bits", "more", "h1", "h2", short.alias("prefix"), rare.alias("rare"))
    firsts = rows.groupBy("h1", "h2").agg(F.min("id").alias("id"), *[F.first(c).alias(c) for c in ("n", "bits", "more", "prefix", "rare")])
    return firsts.where("n > 0").select("id.doc", "id.line", "n", "bits", "more", "prefix", "rare")


def postings(firsts: DataFrame) -> DataFrame:
    """key, doc, line, n, bits, more, most (tokens that a line with the same key can share at most, by the places of the key's tokens)."""
    own = ["doc", "line", "n", "bits", "more"]
    single = firsts.where("rare > 0").select(*own, F.posexplode(F.slice("prefix", F.lit(1), F.col("rare"))).alias("at", "token"))
    single = single.select(F.coalesce(F.col("token").cast("long"), F.lit(0).cast("long")).alias("key"), *own, (F.abs("n") - F.col("at")).alias("most"))
    double = firsts.where("rare >= 0 AND rare < size(prefix) - 1").select(*own, "prefix", F.explode(F.sequence("rare", F.size("prefix") - 2)).alias("i"))
    double = double.select(*own, "i", F.get("prefix", F.col("i")).alias("one"), F.posexplode(F.slice("prefix", F.col("i") + 2, F.size("prefix"))).alias("at", "two"))
    return single.unionByName(double.select(F.xxhash64("one", "two").alias("key"), *own, (F.abs("n") - F.col("i") - F.col("at")).alias("most")))


def _earlier(a: Callable[[str], Column], b: Callable[[str], Column]) -> Column:
    return F.when(a("doc").eqNullSafe(b("doc")), a("line") < b("line")).otherwise(F.coalesce(a("doc") < b("doc"), a("doc").isNull()))


def _may_match(a: Callable[[str], Column], b: Callable[[str], Column], n1: Column, n2: Column) -> Column:
    """Whether no filter parts lines a and b: length, places of the common tokens, parity maps.

    Sets that differ in d tokens have maps that differ in d bits at most, and similar sets of n1 and n2 tokens in (n1 + n2) / 9. The
    halves of a map in two make up the whole map.
    """
    both = n1 + n2
    apart = F.bit_count(a("bits").bitwiseXOR(b("bits")))
    more = a("more").bitwiseXOR(b("more"))
    apart = F.when((n1 >= WIDE) == (n2 >= WIDE), apart + F.bit_count(more)).otherwise(F.bit_count(a("bits").bitwiseXOR(b("bits")).bitwiseXOR(more)))
    return (n1 * DEN >= n2 * NUM) & (n2 * DEN >= n1 * NUM) & (F.least(a("most"), b("most")) * (DEN + NUM) >= both * NUM) & (apart * (DEN + NUM) <= both * (DEN - NUM))


_POSTED = ("doc", "line", "n", "bits", "more", "most")


def _led(leads: DataFrame, posted: DataFrame) -> DataFrame:
    """a_doc, a_line, doc, line: lines that may match an earlier lead of one of their keys."""
    a, b = lambda c: F.col(f"a_{c}"), F.col
    found = posted.join(F.broadcast(leads.select("key", *[F.col(c).alias(f"a_{c}") for c in _POSTED])), "key")
    return found.where(_may_match(a, b, a("n"), b("n")) & _earlier(a, b)).select("a_doc", "a_line", "doc", "line").distinct()


def _index(posted: DataFrame) -> DataFrame:
    """The postings by which a line can meet longer ones: with n tokens of its own, they share 2 * NUM / (NUM + DEN) of n at least.

    The number keeps the filter above the exchange, which both sides of the join then share.
    """
    rows = posted.withColumn("number", F.monotonically_increasing_id()).where((F.col("most") * (NUM + DEN) >= F.abs("n") * 2 * NUM) & (F.col("number") >= 0))
    return rows.select(*[c for c in posted.columns if c not in _POSTED], *[F.col(c).alias(f"a_{c}") for c in _POSTED])


def _met(index: DataFrame, posted: DataFrame, on: list[str]) -> DataFrame:
    """a_doc, a_line, doc, line: pairs that may match, the later line last. A line that is gone has its n negative: it may be the earlier only."""
    a, b = lambda c: F.col(f"a_{c}"), F.col
    n1, n2 = F.abs(a("n")), F.abs(b("n"))
    first = _earlier(a, b)
    ordered = (n1 < n2) | ((n1 == n2) & first)
    match = _may_match(a, b, n1, n2) & ordered & (F.when(first, b("n")).otherwise(a("n")) > 0) & ~(a("doc").eqNullSafe(b("doc")) & (a("line") == b("line")))
    found = posted.join(index, on).where(F.when(match, F.lit(True)).otherwise(F.lit(False)))  # so nothing is inferred for, and pushed to, one side
    found = found.select(F.when(first, F.struct(a("doc"), a("line"), b("doc"), b("line"))).otherwise(F.struct(b("doc").alias("a_doc"), b("line").alias("a_line"), a("doc").alias("doc"), a("line").alias("line"))).alias("pair"))
    return found.select("pair.*")


def _tokens_for(docs: DataFrame, wanted: DataFrame, repeats: bool) -> DataFrame:
    """doc, line, tokens of the wanted lines (doc, line)."""
    by_doc = wanted.withColumns({"w_hash": F.shiftrightunsigned("line", 31), "number": F.col("line").bitwiseAND((1 << 31) - 1).cast("int")})
    by_doc = by_doc.groupBy(F.col("doc").alias("w_doc"), "w_hash").agg(F.collect_list(F.struct("line", "number")).alias("w_lines"))
    by_doc = F.broadcast(by_doc) if wanted.count() * 24 <= BROADCAST_BYTES else by_doc.hint("merge")
    joined = docs.join(by_doc, F.col("d_doc").eqNullSafe(F.col("w_doc")) & (F.col("d_hash") == F.col("w_hash")))
    found = bound(F.split("d_text", "\n", -1), lambda lines: F.transform("w_lines", lambda x: F.struct(x["line"].alias("line"), F.get(lines, x["number"]).alias("text"))))
    out = joined.select(F.col("d_doc").alias("doc"), F.explode(found).alias("x")).select("doc", "x.line", _sets(F.col("x.text")).alias("tokens"))
    return out.dropDuplicates(["doc", "line"]) if repeats else out


def _similar(pairs: DataFrame, tokens: DataFrame) -> DataFrame:
    """The later lines (doc, line) of the pairs (a_doc, a_line, doc, line) that are similar."""
    b = tokens.select(F.col("doc").alias("t_doc"), F.col("line").alias("t_line"), F.col("tokens").alias("t_tokens"))
    joined = pairs.join(b, F.col("a_doc").eqNullSafe(F.col("t_doc")) & (F.col("a_line") == F.col("t_line"))).select("doc", "line", F.col("t_tokens").alias("a_tokens"))
    joined = joined.join(b, F.col("doc").eqNullSafe(F.col("t_doc")) & (F.col("line") == F.col("t_line"))).select("doc", "line", "a_tokens", "t_tokens")
    common = F.size(F.array_intersect("a_tokens", "t_tokens"))
    return joined.where(common * DEN >= (F.size("a_tokens") + F.size("t_tokens") - common) * NUM).select("doc", "line").distinct()


def _verified(docs: DataFrame, pairs: DataFrame, label: str, repeats: bool) -> DataFrame:
    """The later lines (doc, line) of the pairs that are similar: each is held against its earliest candidate, and the others if need be."""
    members = materialize(pairs.select(F.col("a_doc").alias("doc"), F.col("a_line").alias("line")).unionByName(pairs.select("doc", "line")).distinct(), "members")
    tokens = materialize(_tokens_for(docs, members, repeats), "tokens")
    first = pairs.groupBy("doc", "line").agg(F.min(F.struct("a_doc", "a_line")).alias("a"), F.count(F.lit(1)).alias("size"))
    first = materialize(first.select("a.a_doc", "a.a_line", "doc", "line", "size"), "first")
    gone = materialize(_similar(first, tokens), label)
    others = _same(pairs, _same(first.where("size > 1"), gone, "left_anti"), "left_semi")
    return materialize(gone.unionByName(_similar(others, tokens)).distinct(), label)


def _same(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    """Join on (doc, line), where null ids are equal."""
    r = maybe_broadcast(right.select(F.col("doc").alias("r_doc"), F.col("line").alias("r_line")), 24)
    return left.join(r, F.col("doc").eqNullSafe(F.col("r_doc")) & (F.col("line") == F.col("r_line")), how)


def survivors(docs: DataFrame, repeats: bool, ranks: Column) -> DataFrame:
    """doc, line of the lines with words that stay."""
    firsts = materialize(classes(docs, ranks), "lines")
    posting = firsts.where("size(prefix) > 0")
    some = posting.where(F.pmod(F.xxhash64("doc", "line"), F.lit(SHARE)) == 0)
    keys = postings(some).groupBy("key").count().where(F.col("count") >= max(1, LED // SHARE))
    keys = materialize(keys.orderBy(F.desc("count"), "key").limit(KEYS), "keys")
    frequent = postings(some).join(F.broadcast(keys.select("key")), "key").withColumn("class", F.pmod(F.xxhash64("line", "doc"), F.lit(LEADS)))
    leads = frequent.groupBy("key", "class").agg(F.min(F.struct(*_POSTED)).alias("lead")).select("key", "lead.*")
    leads = materialize(leads, "leads")
    gone = _verified(docs, materialize(_led(leads, postings(posting)), "pairs1"), "gone1", repeats)

    sign = F.when(F.col("r_line").isNotNull(), -F.col("n")).otherwise(F.col("n")).alias("n")
    posted = postings(_same(posting, gone, "left").select(*[c for c in posting.columns if c != "n"], sign))
    hot = keys.where(F.col("count") * SHARE >= DEALT).select("key", F.ceil(F.col("count") * SHARE / DEALT).cast("int").alias("tasks"))
    hot = materialize(hot, "hot")
    some_hot = hot.limit(1).count() > 0
    cold = (posted.join(F.broadcast(hot), "key", "left_anti") if some_hot else posted).repartition("key")
    pairs = _met(_index(cold), cold, ["key"])
    if some_hot:
        rows = posted.join(F.broadcast(hot), "key")
        each = rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1))).drop("tasks")
        dealt_rows = rows.withColumn("part", F.pmod(F.xxhash64("doc", "line"), F.col("tasks")).cast("int")).drop("tasks")
        pairs = pairs.unionByName(_met(_index(dealt_rows), each, ["key", "part"]))
    gone2 = _verified(docs, materialize(pairs.distinct(), "pairs2"), "gone2", repeats)
    return _same(_same(firsts.select("doc", "line"), gone, "left_anti"), gone2, "left_anti")


def _worded(line: Column) -> Column:
    return trimmed(line) != ""


def _kept_lines(text: Column, numbers: Column) -> Column:
    """The text of the lines without words and of those numbered, joined again; as it is where all stay."""

    def kept(lines: Column) -> Column:
        stays = F.filter(lines, lambda x, i: F.array_contains(numbers, i) | ~_worded(x))
        return F.array_join(stays, "\n")

    return F.when(text.isNotNull(), bound(F.split(text, "\n", -1), kept))


def _with_kept(rows: DataFrame, repeats: bool) -> DataFrame:
    """Identified rows with k_numbers, the numbers of the lines with words that stay (null if none does)."""
    docs = rows.select("d_doc", "d_hash", "d_text")
    kept = materialize(survivors(docs, repeats, word_ranks(docs)), "kept")
    by_doc = kept.groupBy(F.col("doc").alias("k_doc"), F.shiftrightunsigned("line", 31).alias("k_hash")).agg(F.sort_array(F.collect_set(F.col("line").bitwiseAND((1 << 31) - 1).cast("int"))).alias("k_numbers"))
    by_doc = F.broadcast(by_doc) if kept.count() * 12 <= BROADCAST_BYTES else by_doc.hint("merge")
    return rows.join(by_doc, F.col("d_doc").eqNullSafe(F.col("k_doc")) & (F.col("d_hash") == F.col("k_hash")), "left").drop("k_doc", "k_hash")


def dedupe(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with their own columns; ``text`` keeps the lines that stay and n_chars (if there) follows it."""
    own = docs.columns
    rows, repeats = _identified(docs, F.struct(*[F.col(f"`{c}`") for c in own]).alias("d_row"))
    out = _with_kept(rows, repeats).withColumn("d_new", _kept_lines(F.col("d_text"), F.coalesce("k_numbers", F.array().cast("array<int>"))))
    value = {c: F.col("d_row").getField(c) for c in own} | {"text": F.col("d_new")}
    if "n_chars" in own:
        value["n_chars"] = F.char_length("d_new").cast(docs.schema["n_chars"].dataType)
    return out.select(*[value[c].alias(c) for c in own])


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines (with a word), n_removed, kept_sha256 (of the text that stays)."""
    rows = _with_kept(*_identified(docs)).withColumn("k_numbers", F.coalesce("k_numbers", F.array().cast("array<int>")))
    # both figures come from one split of the text: the number of lines with words, and the text that stays
    lines = F.split(F.coalesce("d_text", F.lit("")), "\n", -1)
    counted = bound(lines, lambda x: F.struct(F.size(F.filter(x, _worded)).alias("n"), F.array_join(F.filter(x, lambda y, i: F.array_contains("k_numbers", i) | ~_worded(y)), "\n").alias("text")))
    rows = rows.select("d_doc", "k_numbers", counted.alias("x"))
    return rows.select(F.col("d_doc").alias("doc_id"), F.col("x.n").cast("long").alias("n_lines"), (F.col("x.n") - F.size("k_numbers")).cast("long").alias("n_removed"), F.sha2(F.col("x.text"), 256).alias("kept_sha256"))
