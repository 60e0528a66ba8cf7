"""Queries against their SQL on small tables of shapes that only larger tables have: stops at one place, ways of many hops, many rows of a name."""

import math
import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__

BASE = "/root/testdata/sf0.001"
#: So many stops later, places repeat.
AGAIN = 97 * 53

pytestmark = pytest.mark.skipif(not os.path.isdir(BASE), reason="no test data")


def tables(spark, folder, stops, trips=None, **more):
    """The smallest tables with other stops (id: nation) and trips (lists of stops); ``more``: tables given as rows of a query."""
    made = {"supplier": spark.createDataFrame([(k, f"Stop {k}", n, 1.0) for k, n in stops.items()], "s_suppkey long, s_name string, s_nationkey int, s_acctbal double")}
    if trips is not None:
        rows = [(o, s, i + 1) for o, trip in enumerate(trips) for i, s in enumerate(trip)]
        line = spark.createDataFrame(rows, "l_orderkey long, l_suppkey long, l_linenumber int")
        own = spark.read.parquet(f"{BASE}/lineitem.parquet")
        fill = {"l_partkey": F.lit(7), "l_quantity": F.lit(9.0), "l_shipdate": F.lit("2024-01-01").cast("timestamp_ntz")}
        made["lineitem"] = line.select(*[(F.col(c) if c in line.columns else fill.get(c, F.lit("0"))).cast(kind).alias(c) for c, kind in own.dtypes])
    for name in os.listdir(BASE):
        if name.split(".")[0] not in made | more:
            os.symlink(f"{BASE}/{name}", folder / name)
    for name, df in (made | more).items():
        df.write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def same(spark, folder, name):
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(folder):
        inner = "/*.parquet" if os.path.isdir(f"{folder}/{f}") else ""
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{folder}/{f}{inner}'")
    df = __spark_entry__.queries()[name](spark, folder)
    got = sorted(tuple(r) for r in df.collect())
    want = con.execute(f"SELECT {', '.join(f'"{c}"' for c in df.columns)} FROM ({__spark_entry__.oracle_sql()[name]}) q").fetchall()
    assert want
    assert got == sorted(want)


@pytest.mark.parametrize("name", ["adopt_unlabelled", "route_seconds", "shortest_paths"])
def test_hops_end_where_the_sql_ends(spark, tmp_path, name):
    """A chain of stops at one place: no metres, so only the number of hops bounds it."""
    chain = [AGAIN * j for j in (0, 1, 2, 4, 5, 7, 8, 10, 11)]
    same(spark, tables(spark, tmp_path, dict.fromkeys(chain, 1), [list(p) for p in zip(chain, chain[1:])]), name)


def test_station_links_of_own_stop(spark, tmp_path):
    stops = [1, 1 + AGAIN, 3, 3 + 2 * AGAIN, 2, 2 + 3 * AGAIN]
    same(spark, tables(spark, tmp_path, dict.fromkeys(stops, 1), [[a, b] for a in stops for b in stops if a != b]), "station_links")


def test_station_links_to_track_of_other_stops(spark, tmp_path):
    """Track within reach of a station counts whichever stop it was drawn for."""
    folder = tables(spark, tmp_path, dict.fromkeys([3, 3 + 3 * AGAIN, 9], 1), [[]] * 20 + [[3, 9]])
    same(spark, folder, "station_links")
    got = {(r.station, r.way, r.node) for r in __spark_entry__.queries()["station_links"](spark, folder).collect()}
    assert got == {(3, 20, 3020), (3 + 3 * AGAIN, 20, 3020), (9, 20, 9020)}


def test_line_gaps_between_pieces_at_one_place(spark, tmp_path):
    same(spark, tables(spark, tmp_path, {4: 1, 4 + AGAIN: 1, 9: 1, 9 + AGAIN: 2}), "line_gaps")


def test_assembled_runs_in_order_where_places_repeat(spark, tmp_path):
    stops = dict.fromkeys([10, 25, 47, 60, 10 + AGAIN, 25 + AGAIN, 60 + AGAIN], 1) | dict.fromkeys([5, 88, 5 + AGAIN], 2)
    same(spark, tables(spark, tmp_path, stops), "assembled_runs")


@pytest.mark.parametrize("name", ["walk_edges", "station_changes", "within_distance", "nearest_stop", "knn_stops", "snap_to_line", "nearest_cities", "identities_by_name"])
def test_many_stops_at_one_place(spark, tmp_path, name):
    same(spark, tables(spark, tmp_path, {k + AGAIN * i: k % 3 for k in (0, 3, 4, 17, 57, 58, 101) for i in range(7)}), name)


@pytest.mark.parametrize("name", ["walk_edges", "station_changes", "nearest_stop", "snap_to_line"])
def test_pairs_do_not_multiply_where_places_repeat(spark, tmp_path, monkeypatch, name):
    """Ten times the stops at the same places: no more pairs are measured."""
    from quillon.operators import graph, joins, network

    counts = []

    def counted(f):
        def run(*args, **more):
            out = f(*args, **more)
            counts[-1] += out.count()
            return out

        return run

    monkeypatch.setattr(graph, "within", counted(joins.within))
    monkeypatch.setattr(network, "near_segments", counted(network.near_segments))
    monkeypatch.setattr(joins, "within", counted(joins.within))
    for n in (30, 300):
        folder = tmp_path / str(n)
        folder.mkdir()
        counts.append(0)
        stops = {k + AGAIN * 30 * i: 1 for k in (3, 4, 17) for i in range(n)}
        __spark_entry__.queries()[name](spark, tables(spark, folder, stops)).count()
    assert counts[1] <= counts[0]


@pytest.mark.parametrize("name", ["same_name_pairs", "named_nearby", "lines_at_points", "loose_ends"])
def test_a_name_is_part_of_the_distance_joins_key(spark, name):
    text = __spark_entry__.queries()[name](spark, BASE)._jdf.queryExecution().optimizedPlan().toString()
    joins = [row for row in text.splitlines() if "Join Inner" in row and "o_x" in row]
    assert any("name" in row or "line" in row for row in joins)


@pytest.mark.parametrize("name", ["hidden_pairs", "astray_lines"])
def test_pieces_at_one_place_are_measured_once(spark, tmp_path, monkeypatch, name):
    from quillon.operators import drawn

    counts, near = [], drawn.near_segments

    def counted(*args, **more):
        out = near(*args, **more)
        counts.append(out.count())
        return out

    monkeypatch.setattr(drawn, "near_segments", counted)
    for n in (30, 60):
        folder = tmp_path / str(n)
        folder.mkdir()
        same(spark, tables(spark, folder, {k + AGAIN * i: 1 for k in range(3, 16) for i in range(n)} | {200: 1, 204: 1}), name)
    assert counts[-1] <= counts[0]


def test_single_copies_of_lines_out_and_back(spark, tmp_path):
    """Ten stops in a row and back beside them: about half of the line stays; with a detour too."""
    folder = tables(spark, tmp_path, dict.fromkeys(range(1, 11), 1) | dict.fromkeys([20, 25, 31, 40], 2))
    paths = {}
    for line, stops in ((1, range(1, 11)), (2, [20, 25, 31, 40])):
        at = [(100.0 + s % 97 * 0.05, 20.0 + s % 53 * 0.05) for s in stops]
        paths[line] = sum(2 * 6371000.0 * math.asin(math.sqrt(math.sin(math.radians(d - b) / 2) ** 2 + math.cos(math.radians(b)) * math.cos(math.radians(d)) * math.sin(math.radians(c - a) / 2) ** 2)) for (a, b), (c, d) in zip(at, at[1:]))
    got = {(r.line, r.part): (r.low, r.high) for r in __spark_entry__.queries()["single_copies"](spark, folder).collect()}
    assert set(got) == {(1, 1), (2, 1)} and all(low == 0 for low, _ in got.values())
    assert all(abs(got[line, 1][1] - metres) < 1_000 for line, metres in paths.items())


def test_noded_legs_without_length(spark, tmp_path):
    """Two stops in a row at one place: their leg is there, and cut into no edges."""
    same(spark, tables(spark, tmp_path, dict.fromkeys([3, 40, 40 + AGAIN, 77 + AGAIN, 90 + AGAIN], 1) | {20: 2, 61: 2, 95: 2}), "noded_legs")


def test_lines_at_points_do_not_pair_all_points_of_a_name(spark, monkeypatch):
    """Against all pairs in plain Python; where points crowd together, no more pairs are measured for ten times the points."""
    import random

    from quillon.operators import conform, joins

    rng, counts = random.Random(3), []

    def counted(*args, **more):
        out = joins.within(*args, **more)
        counts[-1] += out.count()
        return out

    def far(p, q):
        h = math.sin(math.radians(q[1] - p[1]) / 2) ** 2 + math.cos(math.radians(p[1])) * math.cos(math.radians(q[1])) * math.sin(math.radians(q[0] - p[0]) / 2) ** 2
        return 2 * 6371000.0 * math.asin(math.sqrt(h))

    def found(points, stops):
        counts.append(0)
        rows = conform.lines_at(spark.createDataFrame(points, "id long, name string, lon double, lat double"), spark.createDataFrame(stops, "line string, name string, lon double, lat double"), 8_000.0, 20_000.0).collect()
        return {r.id: r.lines for r in rows}

    monkeypatch.setattr(conform, "within", counted)
    points = [(i, f"n{i % 2}", 179.6 + rng.random() * 0.4 if i % 3 else -180 + rng.random() * 0.3, 60 + rng.random() * 0.4) for i in range(60)]
    stops = [(f"L{i}", f"n{i % 3}", 179.6 + rng.random() * 0.4, 60 + rng.random() * 0.4) for i in range(9)]
    own = {p[0]: {s[0] for s in stops if far(p[2:], s[2:]) <= 8_000 or (p[1] == s[1] and far(p[2:], s[2:]) <= 20_000)} for p in points}
    want = {p[0]: sorted(set().union(*(own[q[0]] for q in points if p[1] == q[1] and far(p[2:], q[2:]) <= 20_000))) for p in points}
    assert found(points, stops) == want
    for n in (30, 300):
        assert found([(i, "n0", 100.001 + i * 1e-5, 20.001) for i in range(n)], [("L1", "n1", 100.02, 20.02)]) == {i: ["L1"] for i in range(n)}
    assert counts[2] <= counts[1] < 30
