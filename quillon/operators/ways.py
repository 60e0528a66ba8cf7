"""Tracks and their lines: splitting at junctions, owners, shared track, connectors, yards, termini, fits and identities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.operators.graph import components
from quillon.operators.joins import cut, within
from quillon.operators.network import near_segments

#: km/h by class of track, and the minutes between a station and its tracks.
SPEEDS = {"hsr350": 300.0, "hsr250": 220.0, "hsr200": 160.0, "main": 100.0, "branch": 60.0, "metro": 36.0, "mrail": 70.0, "w": 4.5}
RAIL_HUB_MINUTES, METRO_HUB_MINUTES = 12.0, 3.0


def split_at_junctions(paths: DataFrame, forced: DataFrame | None = None) -> DataFrame:
    """line, piece, a, b, first, last: paths (line, seq, node) cut where two paths or more meet, at every end of a path, and at forced nodes
    (node); pieces that return to their own start go."""
    order = Window.partitionBy("line").orderBy("seq")
    own = Window.partitionBy("line")
    rows = paths.withColumns({"low": F.min("seq").over(own), "high": F.max("seq").over(own)})
    end = (F.col("seq") == F.col("low")) | (F.col("seq") == F.col("high"))
    uses = rows.groupBy("node").agg((F.count_distinct("line") >= 2).alias("shared"), F.bool_or(end).alias("tip"))
    cuts = uses.where("shared OR tip").select("node")
    if forced is not None:
        cuts = cuts.unionByName(forced.select("node"))
    cuts = cuts.distinct().withColumn("cut", F.lit(True))
    at = rows.join(cuts, "node", "left").where("cut").withColumns({"to": F.lead("seq").over(order), "b": F.lead("node").over(order), "piece": F.row_number().over(order)})
    return at.where("to IS NOT NULL AND node <> b").select("line", "piece", F.col("node").alias("a"), "b", F.col("seq").alias("first"), F.col("to").alias("last"))


def minutes(metres: Column, kind: Column) -> Column:
    """Running time over a stretch of track of a class."""
    speed = F.coalesce(*[F.when(kind == k, F.lit(v)) for k, v in SPEEDS.items()])
    return metres / 1000 / speed * 60


def timed_edges(edges: DataFrame, stations: DataFrame) -> DataFrame:
    """u, v, minutes: edges (u, v, metres, kind) by their running time, and an edge between each station (id, node, mode) and its track node that
    costs the time to change there. Stations are nodes of their own, by negative numbers."""
    track = edges.select("u", "v", minutes(F.col("metres"), F.col("kind")).alias("minutes"))
    hub = F.when(F.col("mode") == "metro", METRO_HUB_MINUTES).otherwise(RAIL_HUB_MINUTES)
    return track.unionByName(stations.select((-F.col("id")).alias("u"), F.col("node").alias("v"), hub.alias("minutes")))


def inferred_owners(tracks: DataFrame) -> DataFrame:
    """way, owner, how: owners of tracks (way, name, owner, a, b, lon, lat) without one. The only owner of the name, else the one owner of that
    name whose track it meets at its ends (again and again, as tracks are settled), else that of the nearest track of the name."""
    known = cut(tracks.where("owner IS NOT NULL").select("way", "name", "owner", "a", "b", "lon", "lat"))
    todo = cut(tracks.where("owner IS NULL").select("way", "name", "a", "b", "lon", "lat"))
    only = known.groupBy("name").agg(F.min("owner").alias("owner"), F.count_distinct("owner").alias("n")).where("n = 1").drop("n")
    found = cut(todo.join(only, "name").select("way", "owner", F.lit("name").alias("how")))
    todo = cut(todo.join(only.select("name"), "name", "left_anti"))
    ends = lambda df: df.select("name", "owner", F.explode(F.array("a", "b")).alias("node")).distinct()
    at = cut(ends(known))
    while True:
        met = todo.select("way", "name", "a", "b", F.explode(F.array("a", "b")).alias("node")).join(at, ["name", "node"])
        new = cut(met.groupBy("way", "name", "a", "b").agg(F.min("owner").alias("owner"), F.count_distinct("owner").alias("n")).where("n = 1").drop("n"))
        if not new.limit(1).count():
            break
        found = cut(found.unionByName(new.select("way", "owner", F.lit("ends").alias("how"))))
        todo = cut(todo.join(new.select("way"), "way", "left_anti"))
        at = cut(at.unionByName(ends(new)).distinct())
    near = todo.select("way", "name", "lon", "lat").join(known.select("name", "owner", F.col("lon").alias("k_lon"), F.col("lat").alias("k_lat")), "name")
    far = F.hypot((F.col("k_lon") - F.col("lon")) * F.cos(F.radians("lat")), F.col("k_lat") - F.col("lat"))
    best = near.groupBy("way").agg(F.min(F.struct(far.alias("far"), "owner")).alias("x")).select("way", F.col("x.owner").alias("owner"), F.lit("nearest").alias("how"))
    return found.unionByName(best)


def grown(own: DataFrame, members: DataFrame, points: DataFrame) -> DataFrame:
    """line, way: the tracks a line has (line, way), and members of its relation (line, way) that touch these, or what touches those, and so on.
    ``points``: way, node of every point of a track. Only what was added last looks for more."""
    found = front = cut(own.select("line", "way").distinct())
    while True:
        reach = front.join(points, "way").select("line", "node").distinct()
        new = reach.join(points, "node").select("line", "way").distinct().join(members, ["line", "way"], "left_semi").join(found, ["line", "way"], "left_anti")
        front = cut(new)
        if not front.limit(1).count():
            return found
        found = cut(found.unionByName(front))


def merged_connectors(tracks: DataFrame, aliases: DataFrame, longest: float, least_parent: float) -> DataFrame:
    """company, name, parent: short lines that go to the line they bridge. ``tracks``: company, name, way, km, a, b; ``aliases``: name, parent,
    the pairs that are confirmed. Both ends must meet that parent, of the same company, which is a real line."""
    sizes = tracks.groupBy("company", "name").agg(F.sum("km").alias("km"))
    ends = tracks.select("company", "name", F.explode(F.array("a", "b")).alias("node"))
    short = sizes.where(F.col("km") < longest).join(aliases, "name").select("company", "name", "parent")
    parents = sizes.where(F.col("km") >= least_parent).select("company", F.col("name").alias("parent"))
    able = short.where("name <> parent").join(parents, ["company", "parent"])
    met = able.join(ends, ["company", "name"]).join(ends.distinct().select("company", F.col("name").alias("parent"), "node"), ["company", "parent", "node"])
    return met.groupBy("company", "name", "parent").agg(F.count(F.lit(1)).alias("n")).where("n >= 2").drop("n")


def yards_drawn(yards: DataFrame, lines: DataFrame, named: DataFrame, reach: float, named_reach: float, mid_lat: float, parts: int = 8) -> DataFrame:
    """seg of the yard track worth drawing. Pieces (seg, u, v, a_lon, a_lat, b_lon, b_lat) that touch are one group; a group stays, whole, if it
    leaves the drawn lines (segments) by more than ``reach`` anywhere, or if a name (lon, lat) lies on it."""
    links = yards.select("u", "v")
    groups = components(links).withColumnRenamed("node", "u")
    own = cut(yards.join(groups, "u").select("seg", "component", "a_lon", "a_lat", "b_lon", "b_lat"))
    k = F.explode(F.sequence(F.lit(0), F.lit(parts)))
    at = lambda c: (F.col(f"a_{c}") + (F.col(f"b_{c}") - F.col(f"a_{c}")) * F.col("k") / parts).alias(c)
    samples = own.withColumn("k", k).select((F.col("seg") * (parts + 1) + F.col("k")).alias("id"), "component", at("lon"), at("lat"))
    beside = near_segments(samples.select("id", "lon", "lat"), lines, reach, mid_lat).select("id").distinct()
    leaves = samples.join(beside, "id", "left_anti").select("component")
    spots = named.select(F.monotonically_increasing_id().alias("id"), "lon", "lat")
    by_name = near_segments(spots, own, named_reach, mid_lat).select("seg").join(own, "seg").select("component")
    return own.join(leaves.unionByName(by_name).distinct(), "component", "left_semi").select("seg")


def terminus_sidings(sidings: DataFrame, running: DataFrame, stations: DataFrame, at_station: float, short: float) -> DataFrame:
    """way, name: sidings (way, name, a, b, a_lon, a_lat, b_lon, b_lat) that lead a line into its terminus: from where its running track (the same
    columns) stops, to a station (id, lon, lat) that the running track stops short of. Distances in metres."""
    tips = running.select("name", F.explode(F.array("a", "b")).alias("node")).groupBy("name", "node").count().where("count = 1").select("name", "node")
    ways = lambda near, far: sidings.select("way", "name", F.col(near).alias("node"), F.col(f"{far}_lon").alias("lon"), F.col(f"{far}_lat").alias("lat"))
    leads = ways("a", "b").unionByName(ways("b", "a")).join(tips, ["name", "node"])
    at = stations.select(F.col("id").alias("station"), F.col("lon").alias("r_lon"), F.col("lat").alias("r_lat"))
    calls = within(leads, at, at_station).where(F.col("metres") < at_station).select("way", "name", "station", F.col("r_lon").alias("lon"), F.col("r_lat").alias("lat"))
    spots = calls.select("station", "lon", "lat").distinct().withColumnRenamed("station", "id")
    segments = running.withColumnRenamed("way", "seg")
    return calls.join(_reached(spots, segments, short), ["station", "name"], "left_anti").select("way", "name").distinct()


def _reached(spots: DataFrame, segments: DataFrame, metres: float) -> DataFrame:
    """station, name: the lines whose track lies within reach of a station."""
    middle = spots.agg(F.avg("lat")).first()[0] or 0.0
    near = near_segments(spots, segments.select("seg", "a_lon", "a_lat", "b_lon", "b_lat"), metres, float(middle))
    return near.join(segments.select("seg", "name"), "seg").select(F.col("id").alias("station"), "name").distinct()


def away_stretches(samples: DataFrame, tracks: DataFrame, limit: float, least: float, mid_lat: float) -> DataFrame:
    """line, low, high: stretches of lines (id, line, along, lon, lat of their samples, in order) farther than ``limit`` from their own tracks (seg,
    line, a_lon, a_lat, b_lon, b_lat), at least ``least`` metres long."""
    own = tracks.withColumnRenamed("line", "t_line")
    near = near_segments(samples.select("id", "lon", "lat"), own.drop("t_line"), limit, mid_lat).join(own.select("seg", "t_line"), "seg")
    by = near.select("id", F.col("t_line").alias("line")).distinct().withColumn("near", F.lit(True))
    order = Window.partitionBy("line").orderBy("along")
    rows = samples.join(by, ["id", "line"], "left").withColumn("far", F.col("near").isNull())
    rows = rows.withColumn("run", F.sum(F.when(F.col("far") & ~F.coalesce(F.lag("far").over(order), F.lit(False)), 1).otherwise(0)).over(order))
    return rows.where("far").groupBy("line", "run").agg(F.min("along").alias("low"), F.max("along").alias("high")).where(F.col("high") - F.col("low") >= least).drop("run")


def bound_by_name(ways: DataFrame, records: DataFrame) -> DataFrame:
    """way, id: the record (name, id, west, south, east, north; no box: anywhere) that bears exactly the way's name and whose box holds its middle
    (lon, lat); NULL where none or several do."""
    box = F.col("west").isNull() | (F.col("lon").between(F.col("west"), F.col("east")) & F.col("lat").between(F.col("south"), F.col("north")))
    # records of one name and box are one row, with their least and their greatest id: a way's records are one if these are equal
    boxes = records.groupBy("name", "west", "south", "east", "north").agg(F.min("id").alias("low"), F.max("id").alias("high"))
    found = ways.join(boxes, "name").where(box).groupBy("way").agg(F.min("low").alias("id"), F.max("high").alias("high"))
    found = found.select("way", F.when(F.col("id") == F.col("high"), F.col("id")).alias("id"))
    return ways.select("way").join(found, "way", "left")


def depot_findings(labels: DataFrame, tracks: DataFrame, table: DataFrame, reach: float) -> DataFrame:
    """finding, name: labels (name, lon, lat) far from any yard track (fan, lon, lat), fans with labels of several names, and rows of the names
    table (name) that no label bears."""
    at = tracks.select("fan", F.col("lon").alias("r_lon"), F.col("lat").alias("r_lat"))
    spots = labels.withColumn("label", F.monotonically_increasing_id())
    near = cut(within(spots, at, reach))
    far = spots.join(near.select("label"), "label", "left_anti").select(F.lit("label far from track").alias("finding"), "name")
    best = near.groupBy("label", "name").agg(F.min(F.struct("metres", "fan")).alias("x")).select("name", F.col("x.fan").alias("fan"))
    double = best.groupBy("fan").agg(F.min("name").alias("name"), F.count_distinct("name").alias("n")).where("n > 1").select(F.lit("fan with several names").alias("finding"), "name")
    lost = table.select("name").distinct().join(labels.select("name"), "name", "left_anti").select(F.lit("row at no depot").alias("finding"), "name")
    return far.unionByName(double).unionByName(lost)


def supplemented(relations: DataFrame, supplement: DataFrame, extract_sha256: str) -> DataFrame:
    """Relations (id, tags) with the tags of a later scan (id, tags, extract_sha256) laid over their own. An error if the scan belongs to another
    extract or lacks a relation: a missing tag is unknown, not absent."""
    extra = supplement.select("id", F.col("tags").alias("s_tags"), "extract_sha256")
    rows = relations.join(extra, "id", "left")
    fail = lambda text: F.raise_error(F.lit(text)).cast("map<string,string>")
    over = F.map_concat(F.map_filter("tags", lambda k, v: ~F.array_contains(F.map_keys("s_tags"), k)), "s_tags")
    tags = F.when(F.col("s_tags").isNull(), fail("the scan lacks a relation")).when(F.col("extract_sha256") != extract_sha256, fail("the scan belongs to another extract")).otherwise(over)
    return rows.select(*[c for c in relations.columns if c != "tags"], tags.alias("tags"))
