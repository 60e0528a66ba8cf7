"""Mixing sources to target weights by Pfair scheduling.

The documents of a source, in a seeded hash order, are cut into blocks. A source of weight w (a share of all slots) gets its j-th block a
release time floor(j / w) and a deadline ceil((j + 1) / w), in exact whole-number arithmetic; earliest deadline first then serves one
block a slot, and at no prefix does a source deviate from its target by one block. When the first source runs out, a new phase begins
with the targets of those that are left, until all documents are placed.

Sources of one block, which can't be spaced, are pooled: the pool is a source of their weights together, and within it they follow one
another in the order of u / w, with a fixed u from 0 to 1 for each. Those without a weight have a pool of their own.

The same rule holds for any number of blocks and sources. The driver simulates the schedule and writes it a CHUNK of slots at a time, so it holds
one entry for each source of two blocks or more; the pools are numbered by ranges. Ranks are exact without a hot task: rows are numbered
within (source, hash bucket) and bucket offsets are added.

Defined results: a null source is a source of its own; sources without a positive weight follow after all others, in proportion
to their sizes; rows that repeat are placed once each; ties go by doc_id; an empty table gives no rows; other columns are
kept by ``interleave`` and ignored by ``positions``.
"""

from __future__ import annotations

import heapq
import itertools
import math
from collections.abc import Iterator
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, maybe_broadcast

BLOCK = 64
#: Names of the pools of sources of one block, with and without a weight; slots that the driver holds at once.
POOL, LATE = "+", "-"
CHUNK = 1 << 17
#: Rows of a partition of the mixed table.
PART_ROWS = 32_768
#: Exponent of the default targets: a source's weight is its number of documents to this power.
TEMPER = 0.7


def exact(weights: dict[str, float]) -> dict[str, int]:
    """Whole numbers in the very proportions of the weights."""
    parts = {s: Fraction(w) for s, w in weights.items()}
    unit = math.lcm(*(p.denominator for p in parts.values()))
    whole = {s: int(p * unit) for s, p in parts.items()}
    common = math.gcd(*whole.values())
    return {s: w // common for s, w in whole.items()}


def edf(parts: dict[str, int]) -> Iterator[str]:
    """The source of each slot, without end, by earliest deadline among the released blocks (ties by name)."""
    total = sum(parts.values())
    waiting = [(0, s, 0) for s in parts]
    heapq.heapify(waiting)
    ready: list[tuple[int, str, int]] = []
    slot = 0
    while True:
        while waiting and waiting[0][0] <= slot:
            _, s, j = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(j + 1) * total // parts[s]), s, j))
        _, s, j = heapq.heappop(ready)
        yield s
        heapq.heappush(waiting, ((j + 1) * total // parts[s], s, j + 1))
        slot += 1


def schedule(blocks: dict[str, int], weights: dict[str, float]) -> Iterator[tuple[str, int, int, float]]:
    """(source, block, phase, share) of each slot, until all blocks are placed. A phase ends when a source runs out."""
    done, phase = dict.fromkeys(blocks, 0), 0
    while left := [s for s in sorted(blocks) if done[s] < blocks[s]]:
        live = {s: weights[s] for s in left if weights.get(s, 0) > 0} or {s: float(blocks[s]) for s in left}
        parts = exact(live)
        total = sum(parts.values())
        share = {s: p / total for s, p in parts.items()}
        for s in edf(parts):
            yield s, done[s], phase, share[s]
            done[s] += 1
            if done[s] == blocks[s]:
                break
        phase += 1


def _source() -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))


def _ranked(keyed: DataFrame, counts: DataFrame, block: int) -> DataFrame:
    """Rows with their rank and block within their source."""
    offsets = counts.withColumn("m_offset", F.sum("m_n").over(Window.partitionBy("m_source").orderBy("m_bucket").rowsBetween(Window.unboundedPreceding, -1))).select("m_source", "m_bucket", F.coalesce("m_offset", F.lit(0)).alias("m_offset"))
    order = Window.partitionBy("m_source", "m_bucket").orderBy("m_key", "doc_id")
    ranked = keyed.withColumn("m_row", F.row_number().over(order) - 1)
    ranked = ranked.join(maybe_broadcast(offsets, 64), ["m_source", "m_bucket"]).withColumn("m_rank", F.col("m_row") + F.col("m_offset"))
    return ranked.withColumn("m_block", F.floor(F.col("m_rank") / F.lit(block)))


def _pooled(small: DataFrame, seed: int) -> DataFrame:
    """m_pool, m_place (from 0 within its pool), m_source, m_size, m_w of the sources of one block (m_source, m_size, m_w, m_pool), by virtual time."""
    u = (F.pmod(F.xxhash64("m_source", F.lit(seed)), F.lit(1 << 20)) + 0.5) / (1 << 20)
    at = ["m_v", "m_source"]
    ranged = materialize(small.withColumn("m_v", u / F.col("m_w")).repartitionByRange("m_pool", *at).withColumn("m_range", F.spark_partition_id()), "pools")
    sums = sorted((r["m_pool"], r["m_range"], r["count"]) for r in ranged.groupBy("m_pool", "m_range").count().collect())
    before = [(p, r, sum(n for q, _, n in sums[:k] if q == p)) for k, (p, r, _) in enumerate(sums)]
    offsets = F.broadcast(small.sparkSession.createDataFrame(before, "m_pool string, m_range int, m_offset long"))
    place = F.col("m_offset") + F.row_number().over(Window.partitionBy("m_pool", "m_range").orderBy(*at)) - 1
    return ranged.join(offsets, ["m_pool", "m_range"]).select("m_pool", place.alias("m_place"), "m_source", "m_size", "m_w")


def _plan(counts: DataFrame, weights: dict[str, float] | None, block: int, seed: int) -> DataFrame:
    """m_source, m_block, m_slot, m_before (rows in earlier slots), m_phase, m_share of all blocks."""
    spark = counts.sparkSession
    own = materialize(counts.groupBy("m_source").agg(F.sum("m_n").alias("m_size")), "sources")
    small = own.where(F.col("m_size") <= block)
    sizes = {r["m_source"]: r["m_size"] for r in own.where(F.col("m_size") > block).collect()}
    if weights is None:
        target = {s: float(n) ** TEMPER for s, n in sizes.items()}
        small = small.withColumns({"m_w": F.pow(F.col("m_size").cast("double"), F.lit(TEMPER)), "m_pool": F.lit(POOL)})
        equal = {r["m_size"]: r["count"] for r in small.groupBy("m_size").count().collect()}
        target[POOL] = math.fsum(k * float(n) ** TEMPER for n, k in sorted(equal.items()))
    else:
        target = {("" if s is None else "=" + s): float(w) for s, w in weights.items()}
        small = small.join(spark.createDataFrame(list(target.items()), "m_source string, m_w double"), "m_source", "left")
        listed = F.coalesce(F.col("m_w") > 0, F.lit(False))
        small = small.withColumns({"m_pool": F.when(listed, POOL).otherwise(LATE), "m_w": F.when(listed, F.col("m_w")).otherwise(1.0)})
        target[POOL] = math.fsum(sorted(r["m_w"] for r in small.where(listed).select("m_w").collect()))
    blocks = {s: -(-n // block) for s, n in sizes.items()} | {r["m_pool"]: r["count"] for r in small.groupBy("m_pool").count().collect()}
    kinds = "m_source string, m_block long, m_slot long, m_phase long, m_share double, m_n long"
    slots = None
    for part in itertools.batched(enumerate(schedule(blocks, target)), CHUNK):
        rows = [(s, j, slot, phase, share, min(block, sizes[s] - j * block) if s in sizes else None) for slot, (s, j, phase, share) in part]
        columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.string(), *[pa.int64()] * 3, pa.float64(), pa.int64()), strict=True)]
        new = materialize(spark.createDataFrame(pa.table(columns, names=[k.split()[0] for k in kinds.split(", ")])), "slots")
        slots = new if slots is None else slots.unionByName(new)
    slots = slots if slots is not None else spark.createDataFrame([], kinds)
    if blocks.keys() & {POOL, LATE}:
        weight = F.when(F.col("m_pool") == POOL, float(target[POOL])).otherwise(float(blocks.get(LATE, 1)))
        pools = _pooled(small, seed).select(F.col("m_pool").alias("m_key"), F.col("m_place").alias("m_block"), F.col("m_source").alias("o_source"), F.col("m_size").alias("o_n"), (F.col("m_w") / weight).alias("o_share"))
        slots = slots.withColumnRenamed("m_source", "m_key").join(pools, ["m_key", "m_block"], "left")
        mine = F.col("o_source").isNotNull()
        slots = slots.select(F.coalesce("o_source", "m_key").alias("m_source"), F.when(mine, F.lit(0)).otherwise(F.col("m_block")).cast("long").alias("m_block"), "m_slot", "m_phase", F.when(mine, F.col("m_share") * F.col("o_share")).otherwise(F.col("m_share")).alias("m_share"), F.coalesce("o_n", "m_n").alias("m_n"))
    slots = materialize(slots.withColumn("m_run", F.floor(F.col("m_slot") / CHUNK)), "numbered")
    done = sorted((r["m_run"], r["n"]) for r in slots.groupBy("m_run").agg(F.sum("m_n").alias("n")).collect())
    runs = spark.createDataFrame([(r, t - n) for (r, n), t in zip(done, itertools.accumulate(n for _, n in done), strict=True)], "m_run long, m_start long")
    past = Window.partitionBy("m_run").orderBy("m_slot").rowsBetween(Window.unboundedPreceding, -1)
    found = slots.join(F.broadcast(runs), "m_run").withColumn("m_before", F.col("m_start") + F.coalesce(F.sum("m_n").over(past), F.lit(0)))
    return materialize(found.select("m_source", "m_block", "m_slot", "m_before", "m_phase", "m_share"), "plan")


def _placed(docs: DataFrame, weights: dict[str, float] | None, block: int, seed: int) -> DataFrame:
    """The rows of ``docs`` with m_block, m_slot, m_phase, m_share and m_position."""
    key = F.xxhash64(F.col("doc_id"), F.lit(seed))
    n = docs.count()
    buckets = 1 << max(4, min(13, (n // 512).bit_length()))
    keyed = docs.withColumns({"m_source": _source(), "m_key": key, "m_bucket": F.pmod(key, F.lit(buckets))})
    counts = materialize(keyed.groupBy("m_source", "m_bucket").agg(F.count("*").alias("m_n")), "counts")
    plan = _plan(counts, weights, block, seed)
    placed = _ranked(keyed, counts, block).join(maybe_broadcast(plan, 96), ["m_source", "m_block"])
    return placed.withColumn("m_position", F.col("m_before") + F.col("m_rank") % block)


def positions(docs: DataFrame, weights: dict[str, float] | None = None, block: int = BLOCK, seed: int = 17) -> DataFrame:
    """Where each document goes: doc_id, source, phase, block (of its source), slot, position (gapless from 0), target share."""
    out = _placed(docs.select("doc_id", "source"), weights, block, seed)
    return out.select("doc_id", "source", F.col("m_phase").cast("long").alias("phase"), F.col("m_block").cast("long").alias("block"), F.col("m_slot").cast("long").alias("slot"), F.col("m_position").cast("long").alias("position"), F.col("m_share").cast("double").alias("share"))


def interleave(docs: DataFrame, weights: dict[str, float] | None = None, block: int = BLOCK, seed: int = 17) -> DataFrame:
    """The rows of ``docs``, with their own columns, sorted by mixed position: files and rows within them follow the schedule.

    Positions have no gaps, so a partition's range follows by arithmetic and nothing is sampled.
    """
    own = docs.columns
    held = docs.select("doc_id", "source", F.struct(*[F.col(f"`{c}`") for c in own]).alias("m_row_itself"))
    parts = max(1, -(-docs.count() // PART_ROWS), docs.sparkSession.sparkContext.defaultParallelism)
    size = max(1, -(-docs.count() // parts))
    out = _placed(held, weights, block, seed).select("m_position", "m_row_itself")
    out = out.repartitionById(parts, F.floor(F.col("m_position") / size).cast("int")).sortWithinPartitions("m_position")
    return out.select(*[F.col("m_row_itself").getField(c).alias(c) for c in own])
