"""Aggregations: votes with exact ties, shares, dominance, islands, density, summaries, set and window helpers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def weighted_mode(rows: DataFrame, key: str, value: str, weight: str) -> DataFrame:
    """key, value: the value with the largest summed weight; an exact tie goes to the smaller value."""
    sums = rows.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.sum(weight).alias("w"))
    best = Window.partitionBy(key).orderBy(F.desc("w"), value)
    return sums.withColumn("r", F.row_number().over(best)).where("r = 1").select(key, value, "w")


def shares(rows: DataFrame, key: str, weight: str, cases: dict[str, Column]) -> DataFrame:
    """One pass: the total weight of each key and, for each case, the share of it that meets the condition."""
    total = F.sum(weight)
    return rows.groupBy(key).agg(total.alias("total"), *[(F.sum(F.when(c, F.col(weight)).otherwise(0)) / total).alias(n) for n, c in cases.items()])


def dominance(rows: DataFrame, key: str, value: str, least_values: int, most_share: float) -> DataFrame:
    """key, values, share: keys with at least so many values of which none is too frequent; share is that of the commonest."""
    counts = rows.groupBy(key, value).agg(F.count(F.lit(1)).alias("n"))
    out = counts.groupBy(key).agg(F.count(F.lit(1)).alias("n_values"), F.max("n").alias("top"), F.sum("n").alias("total"))
    return out.where((F.col("n_values") >= least_values) & (F.col("top") <= most_share * F.col("total")))


def islands(rows: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """Runs of equal consecutive values: by, island (from 0), value, n."""
    w = Window.partitionBy(*by).orderBy(*order)
    changed = (~F.col(value).eqNullSafe(F.lag(value).over(w))).cast("int")
    rows = rows.withColumn("changed", F.when(F.row_number().over(w) == 1, 0).otherwise(changed))
    rows = rows.withColumn("island", F.sum("changed").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(*by, "island", value).agg(F.count(F.lit(1)).alias("n"))


def absorb(runs: list[tuple[object, int]], least: int) -> list[tuple[object, int]]:
    """Runs (value, length) after the shortest run below ``least`` has joined its longer neighbour (ties: the earlier), again and again."""
    runs = [r for r in runs if r[1]]
    while len(runs) > 1:
        short = min(range(len(runs)), key=lambda i: (runs[i][1], i))
        if runs[short][1] >= least:
            break
        left = runs[short - 1][1] if short else -1
        right = runs[short + 1][1] if short + 1 < len(runs) else -1
        into = short - 1 if left >= right else short + 1
        runs[into] = (runs[into][0], runs[into][1] + runs[short][1])
        del runs[short]
        merged: list[tuple[object, int]] = []
        for v, n in runs:
            if merged and merged[-1][0] == v:
                merged[-1] = (v, merged[-1][1] + n)
            else:
                merged.append((v, n))
        runs = merged
    return runs


def absorb_short_runs(islands_: DataFrame, by: str, value: str, least: int) -> DataFrame:
    """islands() of each key with short runs absorbed. Sequential within a key, so one Arrow group for each."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("island")
        out = absorb(list(zip(pdf[value], pdf["n"], strict=True)), least)
        return pd.DataFrame({by: pdf[by].iloc[0], "island": range(len(out)), value: [v for v, _ in out], "n": [n for _, n in out]})

    kinds = dict(islands_.dtypes)
    return islands_.groupBy(by).applyInPandas(run, f"{by} {kinds[by]}, island long, {value} {kinds[value]}, n long")


def density(points: DataFrame, weight: str, degrees: float, least: float) -> DataFrame:
    """Grid cells whose 3 x 3 neighbourhood weighs at least so much: x, y, w, near."""
    cells = points.groupBy(F.floor(F.col("lon") / degrees).cast("long").alias("x"), F.floor(F.col("lat") / degrees).cast("long").alias("y")).agg(F.sum(weight).alias("w"))
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    near = cells.withColumn("s", F.explode(steps)).groupBy((F.col("x") + F.col("s.i")).alias("x"), (F.col("y") + F.col("s.j")).alias("y")).agg(F.sum("w").alias("near"))
    return cells.join(near, ["x", "y"]).where(F.col("near") >= least)


def uniform(rows: DataFrame, key: str, value: str) -> DataFrame:
    """key, value; an error if a key has several values."""
    n = F.count_distinct(value)
    return rows.groupBy(key).agg(F.when(n > 1, F.raise_error(F.lit(f"more than one {value}"))).otherwise(F.max(value)).alias(value))


def boxes(points: DataFrame, key: str) -> DataFrame:
    return points.groupBy(key).agg(F.min("lon").alias("west"), F.min("lat").alias("south"), F.max("lon").alias("east"), F.max("lat").alias("north"))


def centroids(points: DataFrame, key: str, weight: str) -> DataFrame:
    w = F.sum(weight)
    return points.groupBy(key).agg((F.sum(F.col("lon") * F.col(weight)) / w).alias("lon"), (F.sum(F.col("lat") * F.col(weight)) / w).alias("lat"))


def shards(sizes: list[int], limit: int) -> list[int]:
    """Shard number of each item in order: a new shard begins when the next item would pass the limit; no item is split."""
    out, shard, used = [], 0, 0
    for n in sizes:
        if used and used + n > limit:
            shard, used = shard + 1, 0
        used += n
        out.append(shard)
    return out


def sharded(items: DataFrame, by: str, key: str, size: str, limit: int) -> DataFrame:
    """Items with the number of their shard within ``by``, in order of key."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, shard, used = object(), 0, 0
        for pdf in batches:
            out = []
            for b, n in zip(pdf[by], pdf[size], strict=True):
                if b != now:
                    now, shard, used = b, 0, 0
                elif used and used + n > limit:
                    shard, used = shard + 1, 0
                used += n
                out.append(shard)
            yield pdf.assign(shard=out)

    kept = items.select(by, key, size)
    kinds = dict(kept.dtypes)
    return kept.repartition(by).sortWithinPartitions(by, key).mapInPandas(run, f"{by} {kinds[by]}, {key} {kinds[key]}, {size} {kinds[size]}, shard long")
