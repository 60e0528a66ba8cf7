"""Ranked search over several kinds of entities, and page lists in natural order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.scalars import canonical


def search(entities: DataFrame, query: str, k: int = 3) -> DataFrame:
    """Entities (kind, id, name) whose canonical name holds the query: exact ones first, then those that begin with it, then others;
    kinds take turns, up to ``k`` of each a round."""
    q = F.lit(" ".join("".join(c if c.isascii() and c.isalnum() else " " for c in query.lower()).split()))
    key = canonical(F.col("name"))
    tier = F.when(key == q, 0).when(F.startswith(key, q), 1).when(F.contains(key, q), 2)
    hits = entities.withColumn("tier", tier).where("tier IS NOT NULL")
    own = Window.partitionBy("kind").orderBy("tier", F.char_length("name"), "name", "id")
    hits = hits.withColumn("own", F.row_number().over(own))
    hits = hits.withColumn("round", F.when(F.col("tier") == 0, 0).otherwise(1 + F.floor((F.col("own") - 1) / k)).cast("long"))
    return hits.select("kind", "id", "name", "tier", "round", "own")


def page(rows: DataFrame, query: str, number: str, size: int = 40) -> DataFrame:
    """The first page of rows whose number holds the query: exact first, then natural order; total counts all hits."""
    digits = F.regexp_extract(number, r"(\d+)", 1)
    exact = F.lower(number) == query.lower()
    hits = rows.where(F.contains(F.lower(number), F.lit(query.lower())))
    hits = hits.withColumns({"exact": exact, "n": F.when(digits == "", None).otherwise(digits.cast("long"))})
    order = [F.desc("exact"), F.asc_nulls_last("n"), F.asc(number)]
    return hits.withColumn("total", hits.agg(F.count(F.lit(1))).scalar()).orderBy(*order).limit(size)
