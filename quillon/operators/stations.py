"""Stations and track: which track a station belongs to, and which fast lines only run past it.

Both are rule-driven joins: candidates come from one distance join, rules are columns beside them, and precedence is a CASE.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.operators.graph import components
from quillon.operators.joins import cut, within

#: Fixed values, in metres: how far a station's track lies from it, by kind; track of a line that calls there; track that runs right through a station
#: that no line is known to call at; links of a station at most. Names of stations that aren't open.
RADIUS, CALLS, THROUGH, LINKS = {"rail": 700.0, "metro": 300.0, "tram": 90.0}, 800.0, 65.0, 12
NOT_OPEN = "在建|规划|建设中|未开通|暂未开通|暂缓开通|暫緩開通|预留|預留|緊急|紧急"
#: Which kinds of track a kind of station may have.
TRACK_OF = {"rail": ("rail", "mrail"), "metro": ("metro", "mrail", "tram"), "tram": ("tram",)}

#: Classes of fast lines, those with fast trains only; metres: on the line, clearly nearer, the throat of a station, a rival station, a stop of
#: the same name, a station that was looked up.
FAST, DEDICATED = ("hsr350", "hsr250", "hsr200"), ("hsr350", "hsr250")
ON_LINE, MARGIN, THROAT, RIVAL, SAME_NAME, LISTED = 60.0, 60.0, 1_113.0, 1_113.0, 3_340.0, 557.0


def station_tracks(stations: DataFrame, vertices: DataFrame, calls: DataFrame | None = None, passed: DataFrame | None = None) -> DataFrame:
    """station, way, line, node, metres, rule: the track places that stations (id, name, kind, lon, lat) are linked to.

    ``vertices`` (way, line, kind, node, tip: an end of its way, lon, lat) are those of all track. ``calls`` (station, line) says which lines call at a
    metro station, with a NULL line where it is known that none does; where it speaks of a line, it decides. ``passed`` (station, line) is
    left out. Ways of a line that touch end to end are one track, linked once, at its nearest place; a station has LINKS links at most, trams apart.
    """
    spark = stations.sparkSession
    track = vertices.select("way", "line", F.col("kind").alias("track"), "node", "tip", F.col("lon").alias("r_lon"), F.col("lat").alias("r_lat"))
    near = within(stations.withColumnRenamed("id", "station"), track, CALLS).drop("r_lon", "r_lat", "lon", "lat")
    fits = F.lit(False)
    for kind, tracks in TRACK_OF.items():
        fits = fits | ((F.col("kind") == kind) & F.col("track").isin(*tracks))
    near = near.where(fits)
    if passed is not None:
        near = near.join(passed.select("station", "line").distinct(), ["station", "line"], "left_anti")
    if calls is None:
        calls = spark.createDataFrame([], near.select("station", "line").schema)
    told = calls.groupBy("station").agg(F.count("line").alias("n_calls"))
    near = near.join(told, "station", "left").join(calls.where("line IS NOT NULL").select("station", "line", F.lit(True).alias("stops")).distinct(), ["station", "line"], "left")
    near = near.join(calls.where("line IS NOT NULL").select("line", F.lit(True).alias("judged")).distinct(), "line", "left")
    own = F.when(F.col("track") == "tram", RADIUS["tram"])
    for kind, metres in RADIUS.items():
        own = own.when(F.col("kind") == kind, metres)
    speaks = (F.col("kind") == "metro") & (F.col("track") == "metro") & F.col("n_calls").isNotNull() & F.col("judged").isNotNull()
    closed = F.coalesce(F.col("name").rlike(NOT_OPEN), F.lit(False))
    rule = (
        F.when(speaks & F.col("stops").isNotNull(), F.when(F.col("metres") <= CALLS, "calls"))
        .when(speaks & ((F.col("n_calls") > 0) | (F.col("metres") > THROUGH) | closed), None)
        .when(F.col("metres") <= own, F.when(speaks, "through").otherwise("distance"))
    )
    linked = near.withColumn("rule", rule).where("rule IS NOT NULL")
    best = cut(linked.groupBy("station", "way", "line", "track").agg(F.min(F.struct("metres", "node", "rule")).alias("x")).select("station", "way", "line", "track", "x.*"))
    tips = vertices.where("tip").select("way", F.col("node").alias("tip")).distinct()
    way = F.struct("station", "way")
    met = best.select("station", "line", "way").join(tips, "way").groupBy("station", "line", "tip").agg(F.min(way).alias("u"), F.collect_set(way).alias("v"))
    one = components(met.select("u", F.explode("v").alias("v")))
    best = best.withColumn("node_", way).join(one.withColumnRenamed("node", "node_"), "node_", "left").withColumn("one", F.coalesce("component", "node_"))
    order = Window.partitionBy("one").orderBy("metres", "node", "way")
    best = best.withColumn("turn", F.row_number().over(order)).where("turn = 1")
    order = Window.partitionBy("station", F.col("track") == "tram").orderBy("metres", "node", "way")
    return best.withColumn("turn", F.row_number().over(order)).where(F.col("turn") <= LINKS).select("station", "way", "line", "node", "metres", "rule")


def passing(stations: DataFrame, vertices: DataFrame, turnouts: DataFrame, timetable: DataFrame, listed: DataFrame, reach: float = RADIUS["rail"]) -> DataFrame:
    """station, line, metres, reason, kept: the fast lines that run past stations (id, name, lon, lat) without a stop.

    Evidence of the track (``vertices``: line, class, node, lon, lat; ``turnouts``: node): the station isn't on the line, and there is no turnout near
    it, or a station of another name is clearly nearer. Evidence of the ``timetable`` (name, lon, lat, fast): trains stop, but none of them is fast. A
    station that is ``listed`` (name, lon, lat) was looked up; one that isn't found exactly once is an error. Where the track takes all fast
    lines away but fast trains stop, nothing is taken (``kept``); and the last line of a station always stays, its nearest.
    """
    own = stations.select(F.col("id").alias("station"), "name", "lon", "lat")
    at = lambda df, **more: df.select(*[F.col(c).alias(n) for n, c in more.items()], F.col("lon").alias("r_lon"), F.col("lat").alias("r_lat"))
    found = within(at(listed, l_name="name").withColumn("entry", F.monotonically_increasing_id()).withColumnsRenamed({"r_lon": "lon", "r_lat": "lat"}), at(own, station="station", name="name"), LISTED).where("l_name = name")
    found = cut(found.select("entry", "station"))
    n = listed.count()
    if n and found.groupBy("entry").count().where("count = 1").count() != n:
        raise ValueError("a listed station isn't found exactly once")
    looked = found.select("station", F.lit(True).alias("looked")).distinct()
    branches = vertices.join(turnouts.select("node", F.lit(True).alias("turnout")).distinct(), "node", "left")
    near = within(own, at(branches, line="line", cls="class", turnout="turnout"), max(reach, THROAT))
    lines = near.groupBy("station", "name", "line").agg(F.min("metres").alias("metres"), F.min_by("cls", F.struct("metres", "cls")).alias("cls"), F.max((F.col("metres") <= THROAT) & F.col("turnout").isNotNull()).alias("turnout"))
    lines = cut(lines.where(F.col("metres") <= reach))
    fast = cut(lines.where(F.col("cls").isin(*FAST)).join(looked, "station", "left"))
    pairs = within(own, at(own, other="station", o_name="name"), RIVAL).where("station <> other AND name <> o_name").select("station", "other", "o_name")
    rivals = fast.select("station", "line").join(pairs, "station").join(lines.select(F.col("station").alias("other"), "line", F.col("metres").alias("o_metres")), ["other", "line"])
    rivals = rivals.groupBy("station", "line").agg(F.min(F.struct("o_metres", "o_name")).alias("rival"))
    stops = within(own, at(timetable, t_name="name", fast="fast"), SAME_NAME).where("name = t_name").groupBy("station").agg(F.max("fast").alias("fast_stops"))
    fast = fast.join(rivals, ["station", "line"], "left").join(stops, "station", "left")
    reason = (
        F.when(F.col("looked"), "looked up: fast trains do not stop").when(F.col("metres") <= ON_LINE, None).when(~F.col("turnout"), "plain track, no turnout near")
        .when(F.col("rival.o_metres") < F.col("metres") - MARGIN, F.concat(F.lit("nearer to "), F.col("rival.o_name")))
    )
    w = Window.partitionBy("station")
    fast = fast.withColumn("reason", reason).withColumn("all", F.bool_and(F.col("reason").isNotNull()).over(w))
    kept = F.coalesce(F.col("fast_stops") & F.col("all") & F.col("looked").isNull(), F.lit(False))
    slow = F.coalesce(~F.col("fast_stops"), F.lit(False)) & F.col("cls").isin(*DEDICATED)
    fast = cut(fast.withColumn("kept", kept).withColumn("reason", F.when(F.col("reason").isNotNull() | ~slow, F.col("reason")).otherwise("no fast train in the timetable")).where("reason IS NOT NULL"))
    n_lines = lines.groupBy("station").agg(F.count(F.lit(1)).alias("n_lines"))
    order = w.orderBy("metres", "line")
    fast = fast.join(n_lines, "station").withColumns({"n": F.count(F.lit(1)).over(w), "turn": F.row_number().over(order)})
    return fast.where("kept OR n < n_lines OR turn > 1").select("station", "line", "metres", "reason", "kept")
