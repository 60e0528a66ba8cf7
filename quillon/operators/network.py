"""Conforming and network operators: rule updates, evidence, overlaps, propagation, point-to-line joins, fitting, ordering."""

from __future__ import annotations

import math
import random

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.operators.joins import cut

M = 111_320.0


def imputed_vote(rows: DataFrame, key: str, value: str, weight: str, fallback: int) -> DataFrame:
    """key, value, w: a weighted vote in which rows without a value side with the leader of the others, or with ``fallback``."""
    known = rows.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.sum(weight).alias("w"))
    lead = known.groupBy(key).agg(F.max_by(value, F.struct("w", -F.col(value))).alias("lead"))
    filled = rows.join(lead, key, "left").withColumn(value, F.coalesce(value, "lead", F.lit(fallback)))
    sums = filled.groupBy(key, value).agg(F.sum(weight).alias("w"))
    return sums.groupBy(key).agg(F.max_by(F.struct(value, "w"), F.struct("w", -F.col(value))).alias("x")).select(key, f"x.{value}", "x.w")


def corrected(rows: DataFrame, rules: DataFrame, key: str, value: str) -> DataFrame:
    """Rows whose value a rule (key, value) rewrites; an error if rules for one key disagree."""
    one = rules.groupBy(key).agg(F.when(F.count_distinct(value) > 1, F.raise_error(F.lit("conflicting rules"))).otherwise(F.max(value)).alias("r_value"))
    return rows.join(one, key, "left").withColumn(value, F.coalesce("r_value", value)).withColumn("corrected", F.col("r_value").isNotNull()).drop("r_value")


def reasons(rows: DataFrame, cases: dict[str, Column]) -> DataFrame:
    """Rows that meet a condition, with the names of all that they meet."""
    named = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in cases.items()]))
    return rows.withColumn("reasons", named).where(F.size("reasons") > 0)


def hidden_identities(members: DataFrame, excluded: DataFrame, key: str, member: str) -> DataFrame:
    """Keys all of whose members are excluded."""
    sets = members.groupBy(key).agg(F.collect_set(member).alias("all"))
    gone = members.join(excluded.select(member).distinct(), member, "left_semi").groupBy(key).agg(F.collect_set(member).alias("gone"))
    return sets.join(gone, key).where(F.size(F.array_except("all", "gone")) == 0).select(key, F.size("all").alias("n"))


def fingerprints(rows: DataFrame, key: str, value: str) -> DataFrame:
    """key, sha256 of its sorted distinct values: a guard that an exception applies to exactly the context it was made for."""
    joined = F.array_join(F.array_sort(F.collect_set(F.col(value).cast("string"))), ",")
    return rows.groupBy(key).agg(F.sha2(joined, 256).alias("fingerprint"))


def one_sided(overlaps: DataFrame, least: float) -> DataFrame:
    """guest, host, km: overlaps of at least so much whose host doesn't claim the guest as much."""
    strong = overlaps.where(F.col("km") >= least)
    back = strong.select(F.col("guest").alias("host"), F.col("host").alias("guest"))
    return strong.join(back, ["guest", "host"], "left_anti")


def transition_votes(rows: DataFrame, by: str, order: list[str], value: str) -> DataFrame:
    """before, after, n: how often a value follows another within ``by``."""
    w = Window.partitionBy(by).orderBy(*order)
    pairs = rows.withColumn("after", F.lead(value).over(w)).where(F.col("after").isNotNull())
    return pairs.groupBy(F.col(value).alias("before"), "after").agg(F.count(F.lit(1)).alias("n"))


def propagated(edges: DataFrame, values: DataFrame) -> DataFrame:
    """node, value: unvalued nodes take a value that two valued neighbours or more share, and no other, until nothing changes."""
    both = cut(edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    known = cut(values.select("node", "value"))
    while True:
        near = both.join(known.select(F.col("node").alias("v"), "value"), "v").join(known.select(F.col("node").alias("u")), "u", "left_anti")
        new = near.groupBy(F.col("u").alias("node")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("value").alias("k"), F.min("value").alias("value"))
        new = cut(new.where("n >= 2 AND k = 1").select("node", "value"))
        if not new.limit(1).count():
            return known
        known = cut(known.unionByName(new))


def segment_cells(metres: float, size: float, mid_lat: float | None = None) -> tuple[Column, Column]:
    """The cell (of about ``size`` metres) of a point (lon, lat), and those within ``metres`` of a segment (a_lon, a_lat, b_lon, b_lat), worked out for parts of
    it as long as a cell: a long one goes to a strip of cells, not to all of its box."""
    fixed = None if mid_lat is None else math.cos(math.radians(mid_lat))
    row = lambda lat: F.floor(lat * M / size).cast("long")

    def metres_of_degree(y: Column) -> Column:
        """Of longitude, in a row of cells: at its edge farther from the equator."""
        if fixed is not None:
            return F.lit(M * fixed)
        edge = F.greatest(F.abs(y), F.abs(y + 1)) * (size / M)
        return M * F.greatest(F.cos(F.radians(F.least(edge, F.lit(90.0)))), F.lit(1e-6))

    column = lambda lon, y: F.floor(lon * metres_of_degree(y) / size).cast("long")
    a_lon, a_lat, b_lon, b_lat = (F.col(c) for c in ("a_lon", "a_lat", "b_lon", "b_lat"))
    length = F.greatest(F.abs(b_lat - a_lat), F.abs(b_lon - a_lon)) * M
    parts = F.greatest(F.lit(1), F.ceil(length / size)).cast("int")

    def cells(i: Column) -> Column:
        x0, y0, x1, y1 = (p + (q - p) * k / parts for k in (i, i + 1) for p, q in ((a_lon, b_lon), (a_lat, b_lat)))
        across = lambda y: metres / metres_of_degree(y)
        rows = F.sequence(row(F.least(y0, y1) - metres / M), row(F.greatest(y0, y1) + metres / M))
        return F.flatten(F.transform(rows, lambda y: F.transform(F.sequence(column(F.least(x0, x1) - across(y), y), column(F.greatest(x0, x1) + across(y), y)), lambda x: F.struct(x.alias("c_x"), y.alias("c_y")))))

    own = F.struct(column(F.col("lon"), row(F.col("lat"))).alias("c_x"), row(F.col("lat")).alias("c_y"))
    return own, F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(0), parts - 1), cells)))


def near_segments(points: DataFrame, segments: DataFrame, metres: float, mid_lat: float | None = None, by: tuple[str, ...] = (), size: float | None = None) -> DataFrame:
    """Points (id, lon, lat) with the segments (seg, a_lon, a_lat, b_lon, b_lat) at most ``metres`` away, of the same ``by``: id, seg, share, metres.

    A point goes to the cell that it lies in (``size`` metres wide, four times the reach by default), a segment to those within reach of it. Distances are in the
    plane around each point; with ``mid_lat``, in one plane for all.
    """
    at, around = segment_cells(metres, metres * 4 if size is None else size, mid_lat)
    fixed = None if mid_lat is None else math.cos(math.radians(mid_lat))
    a_lon, a_lat, b_lon, b_lat = (F.col(c) for c in ("a_lon", "a_lat", "b_lon", "b_lat"))
    spread = segments.withColumn("c", F.explode(around))
    own = points.withColumn("c", at)
    met = own.join(spread, ["c", *by])
    k = F.lit(M * fixed) if fixed is not None else M * F.cos(F.radians(F.col("lat")))
    dx, dy, px, py = (b_lon - a_lon) * k, (b_lat - a_lat) * M, (F.col("lon") - a_lon) * k, (F.col("lat") - a_lat) * M
    square = dx * dx + dy * dy
    share = (px * dx + py * dy) / F.when(square > 0, square)
    share = F.when(square == 0, 0.0).when(share < 0, 0.0).when(share > 1, 1.0).otherwise(share)
    met = met.withColumn("share", share)
    off = F.sqrt(F.pow(px - F.col("share") * dx, 2) + F.pow(py - F.col("share") * dy, 2))
    return met.withColumn("metres", off).where(F.col("metres") <= metres).select("id", "seg", *by, "share", "metres")


def snapped(points: DataFrame, segments: DataFrame, metres: float, mid_lat: float | None = None) -> DataFrame:
    """The nearest segment of each point within reach (ties: the smaller number)."""
    one = segments.groupBy("a_lon", "a_lat", "b_lon", "b_lat").agg(F.min("seg").alias("seg"))  # of segments that are the same the first counts
    found = near_segments(points, one, metres, mid_lat)
    best = Window.partitionBy("id").orderBy("metres", "seg")
    return found.withColumn("turn", F.row_number().over(best)).where("turn = 1").drop("turn")


def clipped_path(points: DataFrame, bounds: DataFrame) -> DataFrame:
    """line, along, lon, lat: the part of each line (with metres along, see cumulative) between ``low`` and ``high``, ends interpolated."""
    w = Window.partitionBy("line").orderBy("seq")
    rows = points.join(bounds, "line").withColumns({f"n_{c}": F.lead(c).over(w) for c in ("along", "lon", "lat")})
    inner = rows.where("along >= low AND along <= high").select("line", "along", "lon", "lat")
    ends = []
    for bound in ("low", "high"):
        share = (F.col(bound) - F.col("along")) / (F.col("n_along") - F.col("along"))
        at = lambda c, s=share: (F.col(c) + (F.col(f"n_{c}") - F.col(c)) * s).alias(c)
        ends.append(rows.where(f"along < {bound} AND n_along > {bound}").select("line", F.col(bound).cast("double").alias("along"), at("lon"), at("lat")))
    return inner.unionByName(ends[0]).unionByName(ends[1])


def smoothed(points: DataFrame, sigma: float) -> DataFrame:
    """line, seq, lon, lat: Gaussian means along each line (line, seq, along, lon, lat) over what lies within three sigma; its ends stay."""
    reach = f"{float(3 * sigma)!r}D"
    near = F.expr(f"collect_list(struct(along, lon, lat)) OVER (PARTITION BY line ORDER BY along RANGE BETWEEN {reach} PRECEDING AND {reach} FOLLOWING)")
    own = Window.partitionBy("line")
    rows = points.withColumns({"near": near, "first": F.min("seq").over(own), "last": F.max("seq").over(own)})
    weight = lambda p: F.exp(-F.pow(p["along"] - F.col("along"), 2) / (2 * sigma**2))
    total = lambda value: F.aggregate("near", F.lit(0.0), lambda acc, p: acc + value(p))
    mean = lambda c: total(lambda p: weight(p) * p[c]) / total(weight)
    end = (F.col("seq") == F.col("first")) | (F.col("seq") == F.col("last"))
    return rows.select("line", "seq", *[F.when(end, F.col(c)).otherwise(mean(c)).alias(c) for c in ("lon", "lat")])


def ordered_lines(sections: list[list[str]], rounds: int = 2000, seed: int = 1) -> list[list[str]]:
    """Seats of lines in consecutive sections with few crossings, by seeded annealing. A crossing is a pair of lines that swap sides."""
    rng = random.Random(seed)
    seats = [sorted(s) for s in sections]

    def crossings(a: list[str], b: list[str]) -> int:
        common = [x for x in a if x in b]
        place = {x: i for i, x in enumerate(b)}
        return sum(place[x] > place[y] for i, x in enumerate(common) for y in common[i + 1 :])

    def cost(i: int) -> int:
        return sum(crossings(seats[j], seats[j + 1]) for j in (i - 1, i) if 0 <= j < len(seats) - 1)

    for step in range(rounds):
        i = rng.randrange(len(seats)) if seats else 0
        if not seats or len(seats[i]) < 2:
            continue
        a, b = rng.sample(range(len(seats[i])), 2)
        before = cost(i)
        seats[i][a], seats[i][b] = seats[i][b], seats[i][a]
        worse = cost(i) - before
        if worse > 0 and rng.random() >= math.exp(-worse / max(1e-9, 1 - step / rounds)):
            seats[i][a], seats[i][b] = seats[i][b], seats[i][a]
    return seats


def namesakes(pairs: DataFrame, same: float) -> DataFrame:
    """Pairs of one name (a, b, metres) as ``same place`` (b is suppressed) or ``namesake``."""
    return pairs.withColumn("finding", F.when(F.col("metres") <= same, "same place").otherwise("namesake")).withColumn("suppressed", F.when(F.col("metres") <= same, F.col("b")))
