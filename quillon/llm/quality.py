"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Each rule is a boolean column over the text and its words. The selectivity of a rule (share of rejected rows) and its cost (seconds for a
row) are measured on a sample picked by hash; rules are then ordered by rejection per cost and chained in one CASE expression. In
``keep_good`` every figure stands inside the branch of its rule, so a row that an early rule rejects never evaluates the later ones.
``judge`` reports all figures of all rows, so there only the verdict is chained. The order changes the time, never the verdict.

Defined results: a null text has no words and fails the base rules, as an empty one does; repeated rows are judged alike; an
empty table gives no rows; other columns pass through untouched, but for those named as a figure or verdict of ``judge``, which
these replace.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of

BLANK = "\x20\t\n\x0b\x0c\r"
_BLANK_RUN = r"[\x20\x09-\x0D]+"
#: Rows of the sample on which costs and selectivities are measured, at most, and the times that each is measured.
SAMPLE_ROWS, TIMES = 1024, 3


@dataclass(frozen=True)
class Rule:
    name: str
    reject: Column


def trimmed(text: Column) -> Column:
    return F.trim(text, F.lit(BLANK))


def words_of(text: Column) -> Column:
    """The words of a text; one empty string stands for none."""
    return F.split(trimmed(text), _BLANK_RUN, -1)


def n_words_of(words: Column) -> Column:
    return F.when(F.get(words, F.lit(0)) == "", F.lit(0)).otherwise(F.size(words)).cast("long")


def n_symbols_of(text: Column) -> Column:
    return F.char_length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long")


def lines_of(text: Column) -> Column:
    """The \\n-split lines that hold a word."""
    return F.filter(F.split(text, "\n", -1), lambda x: F.char_length(trimmed(x)) > 0)


def n_dup_lines_of(lines: Column) -> Column:
    return (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")


def bound(value: Column, use) -> Column:
    """use(value) with the value computed once: inside a lambda an expression would run again for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _window_hashes(words: Column) -> Column:
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    return bound(hashes, lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - 5), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(5)])))


def _covered(windows: Column) -> Column:
    """Words under windows that occur twice or more, from the hashes of all windows in order."""
    pairs = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def repeated(s: Column) -> Column:
        same = lambda a, b: F.coalesce(F.get(s, a)["h"] == F.get(s, b)["h"], F.lit(False))
        at = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda j: same(j, j - 1) | same(j, j + 1))
        return F.sort_array(F.transform(at, lambda j: F.get(s, j)["i"]))

    def union(p: Column) -> Column:
        steps = F.zip_with(p, F.slice(p, 2, F.size(p)), lambda a, b: F.least(F.lit(5), F.coalesce(b - a, F.lit(5))))
        return F.aggregate(steps, F.lit(0), lambda acc, x: acc + x)

    return bound(bound(pairs, repeated), union)


def n_repeat_words_of(words: Column, windows: Column) -> Column:
    """Words in five-word windows found twice or more. The sort only runs for texts that have such a window."""
    return (
        F.when(F.size(words) < 6, F.lit(0))
        .when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0))
        .otherwise(_covered(windows)).cast("long")
    )


#: The base figures that judge reports.
REPORTED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def figures(text: Column, words: Column, lines: Column) -> dict[str, Column]:
    """The figures of a text by name, as expressions."""
    return {
        "n_words": n_words_of(words),
        "word_chars": F.char_length(F.array_join(words, "")).cast("long"),
        "n_symbols": n_symbols_of(text),
        "n_dup_lines": bound(lines, n_dup_lines_of),
        "n_lines": F.size(lines).cast("long"),
        "n_repeat_words": F.when(F.size(words) < 6, F.lit(0).cast("long")).otherwise(bound(_window_hashes(words), lambda w: n_repeat_words_of(words, w))),
    }


def base_failed(figure: dict[str, Column]) -> Column:
    return (figure["n_words"] < 10) | (100 * figure["n_repeat_words"] > 20 * figure["n_words"])


def rules(figure: dict[str, Column]) -> list[Rule]:
    """The production rules. Bounds are wide: only plain junk goes."""
    f = figure
    return [
        Rule("too_few_words", f["n_words"] < 10),
        Rule("symbols", f["n_symbols"] * 10 > f["n_words"] * 3),
        Rule("word_length", (f["word_chars"] < 2 * f["n_words"]) | (f["word_chars"] > 40 * f["n_words"])),
        Rule("duplicate_lines", (f["n_dup_lines"] >= 3) & (f["n_dup_lines"] * 2 > f["n_lines"])),
        Rule("repeated_windows", 100 * f["n_repeat_words"] > 20 * f["n_words"]),
    ]


def _split(docs: DataFrame) -> DataFrame:
    """row (the columns of docs), q_text, q_words and q_barrier, which isn't deterministic: a filter that names it stays above this
    projection, so that the words are split once."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), text_of().alias("q_text"))
    return rows.select("row", "q_text", words_of(F.col("q_text")).alias("q_words"), F.monotonically_increasing_id().alias("q_barrier"))


def order(docs: DataFrame, todo: list[Rule], sample_rows: int = SAMPLE_ROWS) -> list[str]:
    """Names of the rules by rejection per second on the sample, best first; ties by name.

    The sample takes the texts whose hashes fall in an evenly spread share of all. A rule's seconds are the least of TIMES runs over it,
    less those of a run without a rule. Nothing but the order depends on them.
    """
    n = docs.count()
    share = max(1, n // sample_rows)
    texts = docs.select(text_of().alias("text")).where(F.pmod(F.xxhash64("text"), F.lit(share)) == 0).limit(2 * sample_rows).toArrow()
    if not texts.num_rows:
        return [r.name for r in todo]
    sample = _split(docs.sparkSession.createDataFrame(texts).coalesce(1))

    def measured(reject: Column) -> tuple[float, float]:
        took = []
        for _ in range(TIMES):
            began = time.perf_counter()
            found = sample.where(F.col("q_barrier") >= 0).agg(F.avg(F.coalesce(reject, F.lit(False)).cast("int"))).first()[0]
            took.append(time.perf_counter() - began)
        return found or 0.0, min(took)

    idle = measured(F.size("q_words") < 0)[1]
    score = {r.name: (share + 1e-3) / max(took - idle, 1e-4) for r in todo for share, took in [measured(r.reject)]}
    return sorted(score, key=lambda name: (-score[name], name))


def cascade(todo: list[Rule], names: list[str]) -> Column:
    """True if no rule rejects; CASE stops at the first that does."""
    by_name = {r.name: r.reject for r in todo}
    out = F.when(F.lit(False), F.lit(False))
    for name in names:
        out = out.when(F.coalesce(by_name[name], F.lit(False)), F.lit(False))
    return out.otherwise(F.lit(True))


def production(docs: DataFrame) -> tuple[list[Rule], list[str]]:
    """The rules over q_text and q_words, and their measured order."""
    todo = rules(figures(F.col("q_text"), F.col("q_words"), lines_of(F.col("q_text"))))
    return todo, order(docs, todo)


def judge(docs: DataFrame) -> DataFrame:
    """The columns of ``docs``, the base figures, base_failed and kept."""
    names = production(docs)[1]
    df = _split(docs).withColumn("q_lines", lines_of(F.col("q_text")))
    df = df.select("row", *[c.alias(f"f_{name}") for name, c in figures(F.col("q_text"), F.col("q_words"), F.col("q_lines")).items()])
    found = {name[2:]: F.col(name) for name in df.columns if name != "row"}
    out = {c: F.col("row").getField(c) for c in docs.columns} | {name: found[name] for name in REPORTED}
    out |= {"base_failed": base_failed(found), "kept": ~base_failed(found) & cascade(rules(found), names)}
    return df.select(*[c.alias(name) for name, c in out.items()])


def keep_good(docs: DataFrame, todo: list[Rule] | None = None, names: list[str] | None = None) -> DataFrame:
    """The rows of ``docs`` that the cascade keeps, with their own columns. Own rules are columns over q_text and q_words, in the order of ``names``."""
    if todo is None:
        todo, names = production(docs)
    kept = _split(docs).where(cascade(todo, names or [r.name for r in todo]) & (F.col("q_barrier") >= 0))
    return kept.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
