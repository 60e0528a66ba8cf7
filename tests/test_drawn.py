"""Distance joins anywhere on the globe, projections, rate limits and checks of drawn lines, against brute force."""

import itertools
import math
import os
import random

import numpy as np
import pytest

from quillon.functions import geo
from quillon.operators import conform, drawn, joins, lines
from quillon.streaming import windows

R = 6_371_000.0


def metres(a, b):
    h = math.sin(math.radians(b[1] - a[1]) / 2) ** 2 + math.cos(math.radians(a[1])) * math.cos(math.radians(b[1])) * math.sin(math.radians(b[0] - a[0]) / 2) ** 2
    return 2 * R * math.asin(math.sqrt(min(1.0, h)))


@pytest.mark.parametrize("reach", [5_000.0, 400_000.0, 5_000_000.0])
def test_within_reaches_over_the_poles_and_the_date_line(spark, reach):
    rng = random.Random(3)
    spots = [(0, 89.99), (170, 89.9), (-100, 89.95), (0, -90), (90, -89.97), (179.999, 10), (-179.999, 10.001), (180, 10), (-180, 10), (0, 0), (359.999, 0), (60, 80), (60.2, 80.01)]
    spots += [(rng.uniform(-180, 180), math.degrees(math.asin(rng.uniform(-1, 1)))) for _ in range(60)]
    a = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(spots)], "a long, lon double, lat double")
    b = a.selectExpr("a AS b", "lon AS r_lon", "lat AS r_lat")
    got = sorted((r.a, r.b) for r in joins.within(a, b, reach).collect())
    assert got == [(i, j) for i, p in enumerate(spots) for j, q in enumerate(spots) if metres(p, q) <= reach]


def test_nearest_finds_what_lies_far_away(spark):
    left = spark.createDataFrame([(1, 0.0, 0.0), (2, 179.0, -60.0)], "a long, lon double, lat double")
    right = spark.createDataFrame([(7, 100.0, 10.0), (8, -179.5, -61.0)], "b long, r_lon double, r_lat double")
    got = {(r.a, r["rank"]): r.b for r in joins.nearest(left, right, "a", "b", k=3, metres=1000.0).collect()}
    assert got == {(1, 1): 7, (1, 2): 8, (2, 1): 8, (2, 2): 7}


def test_many_bands(spark, monkeypatch):
    bands = spark.createDataFrame([(float(10 * i), float(10 * i + 7), f"b{i}") for i in range(30)], "low double, high double, name string")
    rows = spark.createDataFrame([(i, i * 1.5) for i in range(250)], "id long, x double")
    few = sorted((r.id, r.name) for r in joins.band(rows, bands, "x").collect())
    monkeypatch.setattr(joins, "RULES", 5)
    assert sorted((r.id, r.name) for r in joins.band(rows, bands, "x").collect()) == few and len(few) > 100


def test_projection_is_the_best_monotone_one():
    rng = random.Random(5)
    for _ in range(30):
        path = [(100 + i * 0.01, 30 + rng.uniform(0, 0.01)) for i in range(7)] + [(100.06 - i * 0.01, 30.012 + rng.uniform(0, 0.01)) for i in range(7)]
        stops = [(100 + rng.uniform(0, 0.06), 30 + rng.uniform(0, 0.02)) for _ in range(3)]
        k = lines.M * math.cos(math.radians(path[0][1]))
        flat = np.array(path) * (k, lines.M)
        along = np.concatenate(([0], np.cumsum(np.hypot(*np.diff(flat, axis=0).T))))
        options = []
        for s in np.array(stops) * (k, lines.M):
            own = []
            for i, (a, b) in enumerate(zip(flat, flat[1:], strict=False)):
                t = min(1, max(0, (s - a) @ (b - a) / ((b - a) @ (b - a))))
                own.append((along[i] + t * (along[i + 1] - along[i]), float(np.hypot(*(a + t * (b - a) - s)))))
            options.append([o for o in own if o[1] <= 1500])
        sep = [max(0.01, min(100, 0.1 * metres(p, q))) for p, q in zip(stops, stops[1:], strict=False)]
        fits = [c for c in itertools.product(*options) if all(y[0] - x[0] >= d for x, y, d in zip(c, c[1:], sep, strict=False))]
        found, reason = lines.project_stops(stops, path)
        if not fits:
            assert found is None and reason in (lines.NO_ORDER, lines.TOO_FAR)
        else:
            assert sum(o**2 for _, o in found) == pytest.approx(min(sum(o**2 for _, o in c) for c in fits))
            assert all(y[0] - x[0] >= d - 1e-9 for x, y, d in zip(found, found[1:], sep, strict=False))


def test_projection_gives_reasons_and_tries_the_reverse(spark):
    path = [(1, i, 100 + 0.01 * i, 30.0) for i in range(4)]
    paths = spark.createDataFrame([(line, *p[1:]) for line in (1, 2, 3) for p in path], "line long, seq long, lon double, lat double")
    stops = spark.createDataFrame([(1, 1, 100.0, 30.0), (1, 2, 100.02, 30.001), (2, 1, 100.02, 30.0), (2, 2, 100.0, 30.0), (3, 1, 100.0, 30.0), (3, 2, 100.0, 31.0)], "line long, seq long, lon double, lat double")
    rows = lines.station_projection(stops, paths).collect()
    assert sorted((r.line, r.seq, round(r.along)) for r in rows if r.reason is None) == [(1, 1, 0), (1, 2, 1928), (2, 1, 964), (2, 2, 2892)]
    assert [(r.line, r.reason) for r in rows if r.reason] == [(3, lines.TOO_FAR)]


def passing(events, ttl, gap):
    """Ids of the events (id, user, kind, second) that pass, one by one."""
    last, by, out = {}, {}, set()
    for i, user, kind, at in sorted(events, key=lambda e: (e[3], e[0])):
        if at - by.get((user, kind), -1e9) >= ttl and at - last.get(user, -1e9) >= gap:
            by[user, kind] = last[user] = at
            out.add(i)
    return out


def test_rate_limits_count_from_the_last_that_passed(spark, tmp_path):
    rng = random.Random(4)
    events = [(i, rng.choice([1, 2, 3]), rng.choice("abc"), rng.randrange(3000)) for i in range(600)] + [(1000 + i, 9, "a", 200 * i) for i in range(9)]
    df = spark.createDataFrame(events, "event_id long, user_id long, event_type string, s long").selectExpr("event_id", "user_id", "event_type", "timestamp_seconds(s + 1700000000) AS ts")
    for ttl, gap in [(300, 0), (300, 15), (0, 60)]:
        assert {r.event_id for r in windows.accepted(df, ["user_id"], "event_type", ttl, gap).collect()} == passing(events, ttl, gap)
    assert {i for i in passing(events, 300, 0) if i >= 1000} == {1000, 1002, 1004, 1006, 1008}  # every second one, not the first alone

    for k in range(3):  # the same events in three files, in order of time
        df.where(f"ts >= timestamp_seconds({1700000000 + 1000 * k}) AND ts < timestamp_seconds({1700000000 + 1000 * (k + 1)})").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        for name in os.listdir(f"{tmp_path}/in"):
            path = f"{tmp_path}/in/{name}"
            if name.endswith(".parquet") and os.stat(path).st_mtime > 1_000_000_000:
                os.utime(path, (1000 + k, 1000 + k))
    stream = windows.accepted_stream(windows.event_stream(spark, f"{tmp_path}/in", df.schema), "10 minutes", 300, 15)
    query = stream.writeStream.format("memory").queryName("passed").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
    query.awaitTermination()
    assert {r.event_id for r in spark.table("passed").collect()} == passing(events, 300, 15)


PIECES = "piece long, line string, colour string, off double, a_lon double, a_lat double, b_lon double, b_lat double"


def test_a_line_drawn_twice(spark):
    rows = [(1, "A", "c", 0.0, 100.0, 30.0, 100.1, 30.0), (2, "A", "c", 0.0, 100.01, 30.0003, 100.09, 30.0003), (3, "B", "c", 0.0, 100.0, 31.0, 100.1, 31.0), (4, "B", "c", 0.0, 100.1, 31.0, 100.2, 31.0)]
    every = drawn.samples(spark.createDataFrame(rows, PIECES), 100)
    found = {r.line: r.metres for r in drawn.twice(every, 3.0, 60.0).collect()}
    assert set(found) == {"A"} and 12_000 < found["A"] < 17_000  # both stretches count; B's pieces only meet end to end


def test_company_sides(spark):
    rows = [(1, "A", "c1", 1.0, 100.0, 30.0, 100.1, 30.0), (2, "B", "c2", -1.0, 100.1, 30.0, 100.0, 30.0), (3, "C", "c3", 1.0, 100.05, 29.9, 100.05, 30.1), (4, "D", "c1", 1.0, 100.0, 30.0, 100.1, 30.0)]
    beside = drawn.company(spark.createDataFrame(rows, PIECES), 10, 50.0, 30.0)
    assert {(r.line, r.other, r.side) for r in beside.select("line", "other", "side").distinct().collect()} == {("A", "B", 1.0), ("B", "A", -1.0), ("B", "D", -1.0), ("D", "B", 1.0)}
    assert {(r.line, r.other) for r in drawn.hidden(beside).collect()} == {("A", "B"), ("B", "D")}


def test_written_numbers(spark):
    signs = "零一二三四五六七八九"
    write = lambda n: (signs[n // 100] + "百" if n > 99 else "") + ("零" if n > 99 and 0 < n % 100 < 10 else "") + ((signs[n // 10 % 10] if n > 19 and n // 10 % 10 > 0 else "") + "十" if n // 10 % 10 else "") + (signs[n % 10] if n % 10 else "")
    df = spark.createDataFrame([(n, write(n)) for n in range(1, 400)], "n int, x string")
    got = df.select("n", conform.written_number(conform.F.col("x")).alias("v")).collect()
    assert all(r.v == str(r.n) for r in got)
    odd = [("六三", "63"), ("零", "0"), ("", None), ("7", None), (None, None)]
    assert [r[0] for r in spark.createDataFrame([(x,) for x, _ in odd], "x string").select(conform.written_number(conform.F.col("x"))).collect()] == [v for _, v in odd]
    lines = [("青山九号线支线", "青山9号线支线"), ("河口四十号线", "河口40号线"), ("号线", "号线"), ("乙线", "乙线"), ("8号线", "8号线"), (None, None)]
    assert [r[0] for r in spark.createDataFrame([(x,) for x, _ in lines], "x string").select(conform.numbered(conform.F.col("x"))).collect()] == [v for _, v in lines]


def test_own_script(spark):
    names = [
        ("青山綫 Green Hills Line", "青山綫"), ("Green hills 青山綫", "青山綫"), ("K 青山綫", "K青山綫"), ("青山綫2 East", "青山綫2"), ("Ligne Verte", "Ligne Verte"), ("臺南", "台南"),
        ("青山（支）", "青山"), ("A => 青山", "A"), ("2\ufe0f\u20e3 青山", "2青山"), ("", ""), (None, ""), ("青山Express", "青山Express"), ("Line 7 青山", "Line7青山"),
    ]
    df = spark.createDataFrame([(x,) for x, _ in names], "x string")
    assert [r[0] for r in df.select(conform.own_script(conform.F.col("x"))).collect()] == [v for _, v in names]


def _calls(monkeypatch):
    """No query may call Python once for each line: groups of pandas are counted as an error."""
    from pyspark.sql.pandas.group_ops import PandasCogroupedOps, PandasGroupedOpsMixin

    def no(*_args, **_kw):
        raise AssertionError("a call for each line")

    monkeypatch.setattr(PandasGroupedOpsMixin, "applyInPandas", no)
    monkeypatch.setattr(PandasCogroupedOps, "applyInPandas", no)


def test_lines_are_simplified_in_batches(spark, monkeypatch):
    rows = [(k, s, 100 + 0.1 * s, 20 + 0.3 * (s == k % 4)) for k in range(40) for s in range(1 + k % 6)] + [(None, 0, 1.0, 2.0), (None, 1, 1.0, 2.0)]
    points = spark.createDataFrame(rows, "line long, seq long, lon double, lat double")
    want = []
    for line in {r[0] for r in rows}:
        own = sorted(r for r in rows if r[0] == line)
        want += [own[i] for i in geo.simplified([r[2:] for r in own], 20_000.0)]
    _calls(monkeypatch)
    assert sorted(map(str, map(tuple, lines.simplify(points, 20_000.0).collect()))) == sorted(map(str, want))


def test_stops_are_projected_in_batches(spark, monkeypatch):
    rows = [(k, s, 100 + 0.1 * s * (-1) ** k, 20 + 0.01 * (k % 3)) for k in range(30) for s in range(4)]
    stops = spark.createDataFrame(rows + [(99, 0, 1.0, 1.0), (None, 0, 100.0, 20.0)], "line long, seq long, lon double, lat double")
    paths = spark.createDataFrame([(k, s, 100 + 0.35 * s * (-1) ** (k // 2), 20.0) for k in range(30) for s in range(2)] + [(None, 0, 100.0, 20.0), (None, 1, 101.0, 20.0)], "line long, seq long, lon double, lat double")
    want = []
    for line in [*range(30), 99, None]:
        own = [r for r in rows if r[0] == line] or ([(99, 0, 1.0, 1.0)] if line == 99 else [(None, 0, 100.0, 20.0)])
        way = [(100 + 0.35 * s * (-1) ** (line // 2), 20.0) for s in range(2)] if line is not None and line < 30 else [] if line == 99 else [(100.0, 20.0), (101.0, 20.0)]
        found, reason = lines.project_stops([r[2:] for r in own], way, 1500.0)
        if reason == lines.NO_ORDER:
            found, reason = lines.project_stops([r[2:] for r in own], way[::-1], 1500.0)
        want += [(line, r[1], *f, None) for r, f in zip(own, found, strict=True)] if found else [(line, None, None, None, reason)]
    _calls(monkeypatch)
    assert sorted(map(str, map(tuple, lines.station_projection(stops, paths).collect()))) == sorted(map(str, want))


def test_many_parts_are_stitched_quickly():
    """A chain of 6,000 pieces beside 6,000 that all begin at one place: looking at all pairs would take hours."""
    chain = [[(100 + 1e-3 * i, 20.0), (100 + 1e-3 * (i + 1), 20.0)] for i in range(6_000)]
    star = [[(50.0, 20.0), (50.0, 21.0 + 1e-2 * i)] for i in range(6_000)]
    out = lines.stitch(chain + star, 5.0)
    assert [len(p) for p in out] == [6_001] + [3] * 3_000
    assert out[0] == [p[0] for p in chain] + [chain[-1][1]]
    assert out[1] == [star[0][1], (50.0, 20.0), star[1][1]]


@pytest.mark.parametrize("seed", range(5))
def test_stitching_equals_the_plain_loop(seed):
    rng = random.Random(seed)

    def plain(parts, reach):
        far = lambda a, b: math.hypot((a[0] - b[0]) * lines.M * math.cos(math.radians(a[1])), (a[1] - b[1]) * lines.M)
        parts = [list(p) for p in parts if len(p) > 1]
        while True:
            ways = [(far(parts[i][a], parts[j][b]), i, j, -a, -b) for i in range(len(parts)) for j in range(i + 1, len(parts)) for a in (0, -1) for b in (0, -1)]
            d, i, j, a, b = min(ways, default=(math.inf, 0, 0, 0, 0))
            if d > reach:
                return [p + [p[0]] if len(p) > 3 and p[0] != p[-1] and far(p[0], p[-1]) <= reach else p for p in parts]
            x, y = parts[i][:: 1 if a else -1], parts[j][:: -1 if b else 1]
            parts[i] = x + (y[1:] if x[-1] == y[0] else y)
            del parts[j]

    for _ in range(60):
        g, lat = rng.choice([3, 6]), rng.choice([0, 20, -60])
        parts = [[(100 + rng.randrange(g) * 0.05, lat + rng.randrange(g) * 0.05) for _ in range(rng.randint(1, 4))] for _ in range(rng.randint(0, 10))]
        reach = rng.choice([0.0, 3_000.0, 6_000.0])
        assert lines.stitch(parts, reach) == plain(parts, reach)
