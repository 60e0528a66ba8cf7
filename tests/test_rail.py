"""Rail and timetable operators on hand-made edges."""

import math
import zipfile

import pytest
from pyspark.sql import functions as F

from quillon.functions import geo, scalars
from quillon.operators import aggregates, graph, joins, lines, network, quality, search, timetable
from quillon.sources import readers, tiles, writers
from quillon.streaming import windows


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_times_and_dates(spark):
    assert one(spark, scalars.parse_time(F.lit("31:07:09"))) == 31 * 3600 + 7 * 60 + 9
    assert one(spark, scalars.parse_time(F.lit("7:05:09"))) == 25509
    assert one(spark, scalars.parse_time(F.lit("10:60:00"))) is None
    assert one(spark, scalars.format_time(F.lit(112029))) == "31:07:09"
    assert str(one(spark, scalars.parse_date(F.lit("20260228")))) == "2026-02-28"
    assert one(spark, scalars.parse_date(F.lit("20251131"))) is None
    assert one(spark, scalars.half_up(F.lit(-1.5))) == -1


def test_speeds_and_colours(spark):
    assert one(spark, scalars.parse_speeds(F.lit("100; 60 mph"))) == [97, 100]
    assert one(spark, scalars.parse_speeds(F.lit("80;walk"))) is None
    assert [one(spark, scalars.grade(F.lit(s))) for s in (400, 350, 300, 250, 200, 160, 120)] == [7, 6, 5, 4, 3, 2, 1]
    assert one(spark, scalars.colour(F.lit("#AbC"))) == "#aabbcc" and one(spark, scalars.colour(F.lit("red"))) is None
    assert one(spark, scalars.lightness(F.lit("#ff0000"))) == 0.5


def test_geometry(spark):
    at = lambda *x: [F.lit(float(v)) for v in x]
    assert one(spark, geo.haversine(*at(0, 0, 1, 0))) == pytest.approx(6_371_000 * math.pi / 180, abs=1e-6)
    assert one(spark, geo.bearing(*at(0, 0, 0, 1))) == pytest.approx(0) and one(spark, geo.bearing(*at(0, 1, 0, 0))) == pytest.approx(180)
    assert one(spark, geo.bearing(*at(179.9, 0, -179.9, 0))) == pytest.approx(90) and one(spark, geo.bearing(*at(0, 0, 0, 1e-6))) is None
    assert one(spark, geo.turn(*at(0, 0, 1, 0, 1, 1))) == pytest.approx(90)
    x, y = geo.mercator(*at(12.5, 41.9))
    lon, lat = geo.from_mercator(x, y)
    assert one(spark, lon) == pytest.approx(12.5) and one(spark, lat) == pytest.approx(41.9)
    assert geo.decode_path(geo.encode_path([(-120.2, 38.5), (-120.95, 40.7)])) == [(-120.2, 38.5), (-120.95, 40.7)]
    assert geo.encode_path([(-120.2, 38.5)]) == "_p~iF~ps|U" and geo.decode_path("_p~") == []
    assert all(geo.tile_of(*geo.tile_at(n)) == n for n in range(3000)) and geo.tile_at(0) == (0, 0, 0)
    assert geo.simplified([(0, 0), (0.5, 0.00001), (1, 0), (1, 1)], 5) == [0, 2, 3]


STOPS = "trip_id long, seq long, stop_id long, arr_s long, dep_s long"


def test_timetable_reasons(spark):
    rows = [(1, 1, 1, None, 10), (1, 2, 2, 100, 90), (1, 3, 3, 50, None), (2, 1, 1, 0, 10), (2, 2, 2, 100, 110), (2, 3, 3, 200, 5), (3, 1, 1, 0, 60), (3, 2, 2, 60, 70), (4, 1, 1, 0, 0)]
    got = {r.trip_id: r.reason for r in timetable.reasons(spark.createDataFrame(rows, STOPS)).collect()}
    assert got == {1: "departure_before_arrival", 2: "ok", 3: "nonpositive_interstation_travel_time", 4: "single_stop"}


def test_active_is_half_open(spark):
    runs = spark.createDataFrame([(1, 100, 200), (2, 200, 300), (3, 90_000, 180_000)], "trip_id long, start_at long, end_at long")
    assert [r.trip_id for r in timetable.active_at(runs, F.lit(200)).collect()] == [2]
    at = spark.createDataFrame([(100,), (199,), (200,), (100_000,), (180_000,)], "t long")
    assert sorted((r.t, r.trip_id) for r in timetable.active_series(runs, at, 3600).collect()) == [(100, 1), (199, 1), (200, 2), (100_000, 3)]


def test_position(spark):
    stops = spark.createDataFrame([(1, 1, 1, 0, 0), (1, 2, 2, 100, 150), (1, 3, 3, 250, 250)], STOPS)
    runs = spark.sql("SELECT 1L AS trip_id, DATE '1970-01-01' AS service_date, 'G' AS train_type, 0L AS start_at, 250L AS end_at")
    places = spark.createDataFrame([(1, 0.0, 0.0), (2, 1.0, 0.0), (3, 1.0, 1.0)], "stop_id long, lon double, lat double")
    at = lambda t: timetable.position_at(stops, runs, places, F.lit(t)).collect()
    (r,) = at(50)
    assert (r.status, r.lon, r.progress, r.seconds_to_next, r.next_event) == ("running", 0.5, 0.5, 50, "arrival") and r.heading == pytest.approx(90)
    (r,) = at(120)
    assert (r.status, r.lon, r.seconds_to_next, r.next_event) == ("dwell", 1.0, 30, "departure")
    assert at(250) == [] and at(-1) == []


def test_calendar(spark):
    weekly = spark.sql("SELECT 1L AS service_id, array(1, 2) AS weekdays, DATE '2026-03-02' AS start, DATE '2026-03-10' AS end")
    more = spark.sql("SELECT 1L AS service_id, DATE '2026-03-02' AS date, 2 AS kind, 1 AS seq UNION ALL SELECT 1L, DATE '2026-03-08', 1, 2")
    assert sorted(str(r.date) for r in timetable.expand_calendar(weekly, more).collect()) == ["2026-03-03", "2026-03-08", "2026-03-09", "2026-03-10"]


def test_joins(spark):
    a = spark.createDataFrame([(1, 0.0, 0.0), (2, 10.0, 50.0)], "id long, lon double, lat double")
    b = spark.createDataFrame([(1, 0.01, 0.0), (2, 0.02, 0.0), (3, 9.0, 50.0), (4, 0.01, 0.0)], "b long, r_lon double, r_lat double")
    assert sorted((r.id, r.b) for r in joins.within(a, b, 1500.0).collect()) == [(1, 1), (1, 4)]
    got = sorted((r.id, r.rank, r.b) for r in joins.nearest(a, b, "id", "b", 2, 1000.0).collect())
    assert got[:2] == [(1, 1, 1), (1, 2, 4)] and (2, 1, 3) in got
    left = spark.createDataFrame([(1, 5), (1, 0)], "k long, t long")
    right = spark.createDataFrame([(1, 1, "x"), (1, 5, "y")], "k long, t2 long, v string")
    assert sorted((r.t, r.last_v) for r in joins.as_of(left, right, ["k"], "t", "t2", ["v"]).collect()) == [(0, None), (5, "y")]


def test_aggregates(spark):
    votes = spark.createDataFrame([("l", "b", 2), ("l", "a", 1), ("l", "a", 1)], "line string, v string, w long")
    assert aggregates.weighted_mode(votes, "line", "v", "w").first()["v"] == "a"
    assert aggregates.absorb([("a", 5), ("b", 1), ("a", 4)], 2) == [("a", 10)]
    assert aggregates.absorb([("a", 5), ("b", 1)], 2) == [("a", 6)]
    assert aggregates.shards([5, 5, 11, 1], 10) == [0, 0, 1, 2]
    items = spark.createDataFrame([("x", i, n) for i, n in enumerate([5, 5, 11, 1])], "g string, k long, size long")
    assert [r.shard for r in aggregates.sharded(items, "g", "k", "size", 10).orderBy("k").collect()] == [0, 0, 1, 2]
    with pytest.raises(Exception, match="more than one v"):
        aggregates.uniform(votes, "line", "v").collect()


def test_graph(spark):
    edges = spark.createDataFrame([(1, 2, 5), (2, 3, 5), (3, 4, 5), (3, 5, 1), (7, 8, 1)], "u long, v long, metres long")
    assert {(r.node, r.component) for r in graph.components(edges).collect()} == {(1, 1), (2, 1), (3, 1), (4, 1), (5, 1), (7, 7), (8, 7)}
    assert [r.node for r in graph.turnouts(edges).collect()] == [3]
    start = spark.createDataFrame([(1,)], "node long")
    assert {(r.node, r.cost) for r in graph.shortest(edges, start, "metres", 11).collect()} == {(1, 0), (2, 5), (3, 10), (5, 11)}
    assert {(r.u, r.v, r.metres, r.pieces) for r in graph.contract(edges).collect()} == {(1, 3, 10, 2), (3, 4, 5, 1), (3, 5, 1, 1), (7, 8, 1, 1)}
    labels = spark.createDataFrame([(1, "a")], "node long, label string")
    assert {(r.node, r.round) for r in graph.adopt(edges, labels).collect()} == {(1, 0), (2, 1), (3, 2), (4, 3), (5, 3)}
    assert {r.node for r in graph.adopt_from_components(edges, labels).collect()} == {2, 3, 4, 5}


def test_lines(spark):
    assert lines.stitch([[(0, 0), (1, 0)], [(1.00001, 0), (2, 0)]], 5) == [[(0, 0), (1, 0), (1.00001, 0), (2, 0)]]
    assert [round(a) for a, _ in lines.project_stops([(0, 0), (0.5, 0), (1, 0)], [(0, 0), (1, 0)])[0]] == [0, 55660, 111320]
    assert lines.project_stops([(1, 0), (0, 0)], [(0, 0), (1, 0)]) == (None, lines.NO_ORDER)
    assert lines.project_stops([(0, 0), (0.5, 0.5)], [(0, 0), (1, 0)]) == (None, lines.TOO_FAR)
    kept = lines.one_track([[(0, 0), (0.02, 0)], [(0, 0.0001), (0.01, 0.0001), (0.01, 0.01)]], 30)
    assert len(kept) == 2 and min(y for _, y in kept[1]) > 0.0002
    points = spark.createDataFrame([(1, 1, 0.0, 0.0), (1, 2, 0.001, 0.0)], "line long, seq long, lon double, lat double")
    assert lines.resample(points, 50.0).count() == 4
    assert lines.cumulative(points).agg(F.max("along")).first()[0] == pytest.approx(111.195, abs=0.01)
    assert writers.coded_paths(points).first()["codes"] == [0, 0, 100, 0]


def test_search_and_quality(spark):
    e = spark.createDataFrame([("city", 1, "Ab"), ("line", 2, "Ab line"), ("city", 3, "Cab"), ("city", 4, "xyz")], "kind string, id long, name string")
    assert {r.id: (r.tier, r.round) for r in search.search(e, "AB").collect()} == {1: (0, 0), 2: (1, 1), 3: (2, 1)}
    a, b = spark.createDataFrame([("x",), ("y",)], "k string"), spark.createDataFrame([("y",), ("z",)], "k string")
    assert {(r.k, r.finding) for r in quality.unmatched(a, b, "k").collect()} == {("x", "missing"), ("z", "unexpected")}


def test_streams_match_batches(spark, tmp_path):
    rows = [(i, f"2026-01-01 00:{i % 60:02d}:00", i % 3, "a", float(i)) for i in range(50)]
    df = spark.createDataFrame(rows, "event_id long, t string, user_id long, event_type string, value double").withColumn("ts", F.col("t").cast("timestamp_ntz")).drop("t")
    df.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = windows.event_stream(spark, f"{tmp_path}/in", df.schema)
    q = windows.tumbling(stream, "10 minutes", "1 hour").writeStream.format("memory").queryName("tumbled").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/c1").start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("tumbled").collect())) == sorted(map(tuple, windows.tumbling(df, "10 minutes").collect()))
    q = windows.last_positions(stream, "1 hour").writeStream.format("memory").queryName("lasts").outputMode("update").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/c2").start()
    q.awaitTermination(120)
    last = {r.user_id: r.value for r in spark.sql("SELECT user_id, max_by(value, n) AS value FROM lasts GROUP BY user_id").collect()}
    assert last == {u: float(max(i for i in range(50) if i % 3 == u)) for u in range(3)}
    q = windows.dedupe_stream(stream, ["user_id"], "1 hour").writeStream.format("memory").queryName("once").outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/c3").start()
    q.awaitTermination(120)
    assert spark.table("once").count() == 3


def test_sources(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "feed.zip", "w") as z:
        z.writestr("deep/stops.txt", "﻿stop_id,stop_name\n1,A\n2,\n")
    assert [tuple(r) for r in readers.feed_table(spark, str(tmp_path / "feed.zip"), "stops", ["stop_id", "stop_name"]).collect()] == [("1", "A"), ("2", "")]
    (tmp_path / "f.json").write_text('{"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"n": "a"}, "geometry": {"type": "MultiLineString", "coordinates": [[[0, 0], [1, 1]], [[2, 2], [3, 3]]]}}, {"type": "Feature", "properties": {}, "geometry": {"type": "Point", "coordinates": [5, 6]}}]}')
    got = readers.features(spark, str(tmp_path / "f.json"))
    assert [(r.feature, r.part, len(r.path), r.path[0].lon) for r in got.orderBy("feature", "part").collect()] == [(0, 0, 2, 0.0), (0, 1, 2, 2.0), (1, 0, 1, 5.0)]
    writers.write_features(got.where("part = 0 AND feature = 0"), f"{tmp_path}/out")
    assert "LineString" in spark.read.text(f"{tmp_path}/out").first()["value"]
    (tmp_path / "tiles/3/5").mkdir(parents=True)
    (tmp_path / "tiles/3/5/2.pbf").write_bytes(b"abc")
    spark.dataSource.register(tiles.TileSource)
    assert [tuple(r) for r in spark.read.format("tiles").load(str(tmp_path / "tiles")).collect()] == [(3, 5, 2, 3, bytearray(b"abc"))]
    ways = spark.createDataFrame([(1, {"railway": "rail"}, [11, 12])], "way_id long, tags map<string,string>, refs array<long>")
    nodes = spark.createDataFrame([(11, 0.0, 0.0), (12, 1.0, 0.0), (13, 9.0, 9.0)], "node_id long, lon double, lat double")
    assert [p.lon for p in readers.wanted_nodes(ways, nodes).first()["path"]] == [0.0, 1.0]
    (tmp_path / "r.tsv").write_text("a\tb\n1\t\n")
    assert tuple(readers.rule_table(spark, str(tmp_path / "r.tsv"), ["a", "b"]).first()) == ("1", None)


def test_network(spark):
    x, y = geo.shifted(F.lit(116.404), F.lit(39.915))
    bx, by = geo.unshifted(x, y)
    got = spark.range(1).select(x.alias("x"), y.alias("y"), bx.alias("bx"), by.alias("by")).first()
    assert got.x == pytest.approx(116.41024449916938, abs=1e-6) and got.y == pytest.approx(39.91640428150164, abs=1e-6)
    assert math.isclose(got.bx, 116.404, abs_tol=1e-7) and math.isclose(got.by, 39.915, abs_tol=1e-7)
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (4, 5)], "u long, v long")
    values = spark.createDataFrame([(1, 7), (3, 7), (5, 8)], "node long, value long")
    assert {(r.node, r.value) for r in network.propagated(edges, values).collect()} == {(1, 7), (3, 7), (5, 8), (2, 7)}
    seats = network.ordered_lines([["a", "b"], ["b", "a"], ["a", "b"]])
    assert seats[0] == seats[1] == seats[2]
    points = spark.createDataFrame([(1, 0.0, 0.0001), (2, 0.0, 1.0)], "id long, lon double, lat double")
    segments = spark.createDataFrame([(9, -1.0, 0.0, 1.0, 0.0)], "seg long, a_lon double, a_lat double, b_lon double, b_lat double")
    (r,) = network.snapped(points, segments, 5000.0, 0.0).collect()
    assert (r.id, r.seg, r.share) == (1, 9, 0.5) and r.metres == pytest.approx(11.132)
    line = lines.cumulative(spark.createDataFrame([(1, 1, 0.0, 0.0), (1, 2, 1.0, 0.0)], "line long, seq long, lon double, lat double"))
    cut = network.clipped_path(line, spark.createDataFrame([(1, 10_000.0, 20_000.0)], "line long, low double, high double")).collect()
    assert sorted(r.along for r in cut) == [10_000.0, 20_000.0]
    with pytest.raises(Exception, match="conflicting"):
        network.corrected(values, spark.createDataFrame([(1, 1), (1, 2)], "node long, value long"), "node", "value").collect()
