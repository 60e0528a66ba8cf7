"""Tracks and their lines on small networks worked out by hand, or against brute force."""

import json
import random

import pytest
from pyspark.sql import functions as F

from quillon.operators import ways
from quillon.sources import writers

SEGMENT = "seg long, u long, v long, a_lon double, a_lat double, b_lon double, b_lat double"


def test_split_at_junctions(spark):
    paths = {1: [1, 2, 3, 4], 2: [5, 3, 6], 3: [7, 8, 9, 7], 4: [4, 10]}
    rows = spark.createDataFrame([(line, i, n) for line, p in paths.items() for i, n in enumerate(p)], "line long, seq long, node long")
    got = sorted((r.line, r.a, r.b, r["first"], r["last"]) for r in ways.split_at_junctions(rows).collect())
    assert got == [(1, 1, 3, 0, 2), (1, 3, 4, 2, 3), (2, 3, 6, 1, 2), (2, 5, 3, 0, 1), (4, 4, 10, 0, 1)]  # the ring of line 3 returns to its own start
    forced = spark.createDataFrame([(2,), (8,)], "node long")
    assert {(r.line, r.a, r.b) for r in ways.split_at_junctions(rows, forced).collect()} >= {(1, 1, 2), (1, 2, 3), (3, 7, 8), (3, 8, 7)}


def test_owners(spark):
    tracks = [
        (1, "N", "X", 1, 2, 0.0, 0.0), (2, "N", "Y", 9, 10, 9.0, 0.0), (3, "N", None, 2, 3, 1.0, 0.0), (4, "N", None, 3, 4, 2.0, 0.0), (5, "N", None, 4, 9, 5.0, 0.0),
        (6, "N", None, 50, 51, 8.0, 0.0), (7, "M", "Z", 60, 61, 0.0, 0.0), (8, "M", None, 70, 71, 5.0, 5.0), (9, "K", None, 80, 81, 0.0, 0.0),
    ]
    df = spark.createDataFrame(tracks, "way long, name string, owner string, a long, b long, lon double, lat double")
    got = {r.way: (r.owner, r.how) for r in ways.inferred_owners(df).collect()}
    # 3 meets X alone, then 4 meets 3; 5 meets Y alone at first, before 4 is X's; 6 is nearest Y; M has one owner; K has none
    assert got == {3: ("X", "ends"), 5: ("Y", "ends"), 4: got[4], 6: ("Y", "nearest"), 8: ("Z", "name")} and got[4][0] in ("X", "Y")


def test_grown(spark):
    rng = random.Random(2)
    points = [(w, rng.randrange(60)) for w in range(40) for _ in range(3)]
    members = [(line, w) for line in (1, 2) for w in range(40) if rng.random() < 0.6]
    own = [(1, members[0][1]), (2, 39)]
    at = {}
    for w, n in points:
        at.setdefault(w, set()).add(n)
    want = set(own)
    while True:
        more = {(line, w) for line, w in members if (line, w) not in want and any(at[w] & at[x] for k, x in want if k == line)}
        if not more:
            break
        want |= more
    df = spark.createDataFrame
    got = ways.grown(df(own, "line long, way long"), df(members, "line long, way long"), df(points, "way long, node long"))
    assert {tuple(r) for r in got.collect()} == want


def test_connectors(spark):
    tracks = [
        ("c", "Main", 1, 4.0, 1, 2), ("c", "Main", 2, 3.0, 3, 4), ("c", "Variant", 3, 0.4, 2, 3), ("c", "Branch", 4, 0.4, 4, 5), ("d", "Variant", 5, 0.4, 2, 3),
        ("c", "Tiny", 6, 0.2, 7, 8), ("c", "Small", 7, 0.3, 8, 7),
    ]
    aliases = spark.createDataFrame([("Variant", "Main"), ("Branch", "Main"), ("Tiny", "Small")], "name string, parent string")
    got = ways.merged_connectors(spark.createDataFrame(tracks, "company string, name string, way long, km double, a long, b long"), aliases, 0.6, 5.0)
    assert [tuple(r) for r in got.collect()] == [("c", "Variant", "Main")]


def test_yards(spark):
    line = [(1, 1, 2, 100.0, 30.0, 100.1, 30.0)]
    yards = [(1, 11, 12, 100.01, 30.0001, 100.02, 30.0001), (2, 21, 22, 100.03, 30.0001, 100.04, 30.002), (3, 22, 23, 100.04, 30.0001, 100.05, 30.0001), (4, 31, 32, 100.07, 30.0001, 100.08, 30.0001)]
    named = spark.createDataFrame([(100.075, 30.0002)], "lon double, lat double")
    got = ways.yards_drawn(spark.createDataFrame(yards, SEGMENT), spark.createDataFrame(line, SEGMENT), named, 40.0, 60.0, 30.0)
    assert sorted(r.seg for r in got.collect()) == [2, 3, 4]  # 1 lies in the line's own stroke; 3 touches 2, which leaves it; 4 has a name


def test_terminus(spark):
    kinds = "way long, name string, a long, b long, a_lon double, a_lat double, b_lon double, b_lat double"
    running = spark.createDataFrame([(1, "L", 1, 2, 100.0, 30.0, 100.02, 30.0)], kinds)
    sidings = [(2, "L", 2, 3, 100.02, 30.0, 100.03, 30.0), (3, "L", 2, 4, 100.02, 30.0, 100.02, 30.01), (4, "L", 5, 3, 100.05, 30.0, 100.03, 30.0), (5, "M", 2, 3, 100.02, 30.0, 100.03, 30.0), (6, "L", 1, 6, 100.0, 30.0, 99.9995, 30.0)]
    stations = spark.createDataFrame([(1, 100.0301, 30.0), (2, 99.9995, 30.0)], "id long, lon double, lat double")
    got = ways.terminus_sidings(spark.createDataFrame(sidings, kinds), running, stations, 60.0, 100.0)
    assert [tuple(r) for r in got.collect()] == [(2, "L")]  # 3 ends at no station, 4 begins elsewhere, 5 is another line's, at 6 the line is there


def test_stretches_away_from_the_own_track(spark):
    samples = [(i, "A", 100.0 * i, 100 + 0.001 * i, 30.0 if i < 10 or i > 20 else 30.01) for i in range(40)] + [(100 + i, "B", 100.0 * i, 100 + 0.001 * i, 30.0) for i in range(5)]
    tracks = spark.createDataFrame([(1, "A", 99.9, 30.0, 100.1, 30.0), (2, "C", 99.9, 30.01, 100.1, 30.01)], "seg long, line string, a_lon double, a_lat double, b_lon double, b_lat double")
    df = spark.createDataFrame(samples, "id long, line string, along double, lon double, lat double")
    got = sorted((r.line, r.low, r.high) for r in ways.away_stretches(df, tracks, 50.0, 300.0, 30.0).collect())
    assert got == [("A", 1000.0, 2000.0), ("B", 0.0, 400.0)]


def test_names_bind_one_record(spark):
    records = spark.createDataFrame([("N", 1, None, None, None, None), ("M", 2, 0.0, 0.0, 1.0, 1.0), ("M", 3, 5.0, 5.0, 6.0, 6.0), ("K", 4, None, None, None, None), ("K", 5, None, None, None, None)], "name string, id long, west double, south double, east double, north double")
    tracks = spark.createDataFrame([(1, "N", 0.0, 0.0), (2, "M", 0.5, 0.5), (3, "M", 5.5, 5.5), (4, "M", 3.0, 3.0), (5, "K", 0.0, 0.0), (6, "n", 0.0, 0.0)], "way long, name string, lon double, lat double")
    assert {r.way: r.id for r in ways.bound_by_name(tracks, records).collect()} == {1: 1, 2: 2, 3: 3, 4: None, 5: None, 6: None}


def test_depots(spark):
    labels = spark.createDataFrame([("a", 100.0, 30.0), ("b", 100.001, 30.0), ("c", 101.0, 30.0)], "name string, lon double, lat double")
    tracks = spark.createDataFrame([(7, 100.0, 30.001)], "fan long, lon double, lat double")
    table = spark.createDataFrame([("a",), ("gone",)], "name string")
    got = sorted(tuple(r) for r in ways.depot_findings(labels, tracks, table, 500.0).collect())
    assert got == [("fan with several names", "a"), ("label far from track", "c"), ("row at no depot", "gone")]


def test_supplement(spark):
    relations = spark.createDataFrame([(1, {"a": "old", "b": "x"}), (2, {})], "id long, tags map<string,string>")
    scan = spark.createDataFrame([(1, {"a": "new"}, "s"), (2, {"c": "y"}, "s")], "id long, tags map<string,string>, extract_sha256 string")
    assert {r.id: r.tags for r in ways.supplemented(relations, scan, "s").collect()} == {1: {"a": "new", "b": "x"}, 2: {"c": "y"}}
    with pytest.raises(Exception, match="another extract"):
        ways.supplemented(relations, scan, "t").collect()
    with pytest.raises(Exception, match="lacks a relation"):
        ways.supplemented(relations, scan.where("id = 1"), "s").collect()


def test_minutes(spark):
    edges = spark.createDataFrame([(1, 2, 10_000.0, "main"), (2, 3, 4_000.0, "metro")], "u long, v long, metres double, kind string")
    stations = spark.createDataFrame([(1, 1, "rail"), (3, 3, "metro")], "id long, node long, mode string")
    got = {(r.u, r.v): round(r.minutes, 6) for r in ways.timed_edges(edges, stations).collect()}
    assert got == {(1, 2): 6.0, (2, 3): round(4 / 36 * 60, 6), (-1, 1): 12.0, (-3, 3): 3.0}


def test_sections_and_columns(spark, tmp_path):
    path = f"{tmp_path}/t"
    spark.createDataFrame([("stops", 1), ("named", 2)], "section string, x long").write.partitionBy("section").parquet(path)
    writers.refresh_section(spark.createDataFrame([("stops", 9)], "section string, x long"), path)
    assert {(r.section, r.x) for r in spark.read.parquet(path).collect()} == {("stops", 9), ("named", 2)}
    df = spark.createDataFrame([(2, "b", None, None), (1, "a", 5, None)], "k long, n string, g long, h long")
    out = writers.columnar(df, ["k"], ["n"], ["g", "h"])
    assert json.loads(out.toJSON().first()) == {"n": ["a", "b"], "g": [5, None]} and out.columns == ["n", "g"]
    assert out.select(F.size("n")).first()[0] == 2
