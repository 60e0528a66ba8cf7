"""Borders that neighbours share: cut into arcs where they meet, each arc simplified once, rings put together again.

Rings are area, ring, seq, lon, lat. An arc is a stretch of border with the same areas on it all along, so both neighbours get the same vertices back
and no gap opens between them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.operators.joins import cut
from quillon.operators.lines import simplify


def arcs(rings: DataFrame) -> DataFrame:
    """area, ring, arc (from 1), path, shape (the path or its reverse, whichever is smaller), flipped, key (of the shape), alone (the ring's only arc).

    A vertex ends arcs where other than two edges meet, or where the areas of its edges differ. A ring without such a vertex is one arc from its
    least vertex on, so that the hole and what fills it begin alike.
    """
    w, whole = Window.partitionBy("area", "ring").orderBy("seq"), Window.partitionBy("area", "ring")
    rows = rings.select("area", "ring", "seq", F.struct("lon", "lat").alias("p"))
    last = F.row_number().over(whole.orderBy(F.desc("seq")))
    rows = rows.withColumns({"last": last, "first": F.first("p").over(w)}).where("NOT (last = 1 AND p = first)").drop("last", "first")  # rings may be closed or not
    rows = rows.withColumns({"k": F.row_number().over(w) - 1, "n": F.count(F.lit(1)).over(whole)})
    rows = cut(rows.withColumn("next", F.coalesce(F.lead("p").over(w), F.first("p").over(w))))
    edges = rows.where("p <> next").groupBy(F.least("p", "next").alias("u"), F.greatest("p", "next").alias("v")).agg(F.sort_array(F.collect_set("area")).alias("areas"))
    met = edges.select(F.explode(F.array("u", "v")).alias("p"), "areas").groupBy("p").agg(F.count(F.lit(1)).alias("edges"), F.count_distinct("areas").alias("kinds"))
    ends = met.where("edges <> 2 OR kinds > 1").select("p", F.lit(True).alias("ends"))
    rows = rows.join(ends, "p", "left").withColumn("ends", F.coalesce("ends", F.lit(False)))
    start = F.coalesce(F.min(F.when(F.col("ends"), F.col("k"))).over(whole), F.min_by("k", "p").over(whole))
    rows = rows.withColumn("t", F.pmod(F.col("k") - start, F.col("n")))
    turn = whole.orderBy("t")
    rows = rows.withColumn("arc", F.sum(F.when(F.col("ends") | (F.col("t") == 0), 1).otherwise(0)).over(turn))
    parts = rows.groupBy("area", "ring", "arc").agg(F.array_sort(F.collect_list(F.struct("t", "p"))).alias("x"), F.max_by("next", "t").alias("end"))
    parts = parts.select("area", "ring", "arc", F.concat(F.transform("x", lambda q: q["p"]), F.array("end")).alias("path"), (F.count(F.lit(1)).over(whole) == 1).alias("alone"))
    shape = F.least(F.col("path"), F.reverse("path"))
    parts = parts.withColumn("shape", shape).withColumn("flipped", F.col("shape") != F.col("path"))
    return parts.withColumn("key", F.concat_ws(":", F.xxhash64("shape").cast("string"), F.xxhash64(F.lit(1), "shape").cast("string")))


def simplified_borders(rings: DataFrame, metres: float) -> DataFrame:
    """area, ring, seq (from 1), lon, lat: the rings, closed, with each shared arc simplified once to that tolerance. Ends of arcs stay; a ring that is one arc
    and would be left with fewer than four vertices stays as it is, on both of its sides."""
    found = cut(arcs(rings))
    one = found.groupBy("key").agg(F.first("shape").alias("shape"), F.max("alone").alias("alone"))
    points = one.select(F.col("key").alias("line"), F.posexplode("shape").alias("seq", "p")).select("line", "seq", "p.lon", "p.lat")
    thin = simplify(points, metres).groupBy(F.col("line").alias("key")).agg(F.array_sort(F.collect_list(F.struct("seq", "lon", "lat"))).alias("x"))
    thin = thin.join(one, "key").select("key", F.when(F.col("alone") & (F.size("x") < 4), F.col("shape")).otherwise(F.transform("x", lambda q: F.struct(q["lon"].alias("lon"), q["lat"].alias("lat")))).alias("thin"))
    back = found.join(thin, "key").withColumn("path", F.when(F.col("flipped"), F.reverse("thin")).otherwise(F.col("thin")))
    # an arc begins where the one before ended
    rest = F.when(F.col("arc") == 1, F.col("path")).otherwise(F.slice("path", F.lit(2), F.size("path")))
    rows = back.select("area", "ring", "arc", F.posexplode(rest).alias("i", "p"))
    order = Window.partitionBy("area", "ring").orderBy("arc", "i")
    return rows.select("area", "ring", F.row_number().over(order).alias("seq"), "p.lon", "p.lat")
