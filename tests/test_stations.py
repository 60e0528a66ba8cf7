"""Each rule of station links and of lines that run past has a case."""

import pytest

from quillon.operators import stations

D = 1 / 111_320  # degrees of a metre at the equator
STATIONS = "id int, name string, kind string, lon double, lat double"
TRACK = "way int, line string, kind string, node int, tip boolean, lon double, lat double"


def linked(spark, places, track, calls=None, passed=None):
    rows = stations.station_tracks(
        spark.createDataFrame(places, STATIONS), spark.createDataFrame(track, TRACK),
        None if calls is None else spark.createDataFrame(calls, "station int, line string"), None if passed is None else spark.createDataFrame(passed, "station int, line string"),
    ).collect()
    return {(r.station, r.way): (r.node, round(r.metres), r.rule) for r in rows}


def test_links_by_kind_and_distance(spark):
    places = [(1, "R", "rail", 0.0, 0.0), (2, "M", "metro", 1.0, 0.0), (3, "T", "tram", 2.0, 0.0)]
    at = lambda way, line, kind, x, far: (way, line, kind, way * 10, False, x + far * D, 0.0)
    track = [at(11, "a", "rail", 0, 690), at(12, "b", "rail", 0, 710), at(13, "c", "metro", 0, 5), at(14, "d", "mrail", 0, 9), at(15, "e", "tram", 0, 9)]
    track += [at(21, "a", "rail", 1, 5), at(22, "b", "metro", 1, 290), at(23, "c", "metro", 1, 310), at(24, "d", "mrail", 1, 290), at(25, "e", "tram", 1, 80), at(26, "f", "tram", 1, 100)]
    track += [at(31, "a", "metro", 2, 5), at(32, "b", "tram", 2, 80), at(33, "c", "tram", 2, 95)]
    assert set(linked(spark, places, track)) == {(1, 11), (1, 14), (2, 22), (2, 24), (2, 25), (3, 32)}
    assert set(linked(spark, places, track, passed=[(1, "a")])) == {(1, 14), (2, 22), (2, 24), (2, 25), (3, 32)}


def test_call_lists_decide(spark):
    places = [(1, "A", "metro", 0.0, 0.0), (2, "B", "metro", 1.0, 0.0), (3, "C", "metro", 2.0, 0.0), (4, "D（在建）", "metro", 3.0, 0.0), (5, "E", "metro", 4.0, 0.0)]
    at = lambda way, line, x, far: (way, line, "metro", way * 10, False, x + far * D, 0.0)
    track = [at(11, "calls", 0, 790), at(12, "runs past", 0, 10), at(13, "unjudged", 0, 200)]
    track += [at(21, "runs past", 1, 60), at(22, "runs past 2", 1, 70), at(31, "runs past", 2, 250), at(41, "runs past", 3, 10), at(51, "runs past", 4, 200)]
    calls = [(1, "calls"), (2, None), (3, None), (4, None), (9, "runs past"), (9, "runs past 2")]
    got = linked(spark, places, track, calls)
    assert {k: v[2] for k, v in got.items()} == {(1, 11): "calls", (1, 13): "distance", (2, 21): "through", (5, 51): "distance"}


def test_one_link_for_each_track_and_twelve_at_most(spark):
    places = [(1, "R", "rail", 0.0, 0.0)]
    touching = [(1, "a", "rail", 1, True, 100 * D, 0.0), (1, "a", "rail", 2, True, 300 * D, 0.0), (2, "a", "rail", 2, True, 300 * D, 0.0), (2, "a", "rail", 3, True, 500 * D, 0.0)]
    other = [(3, "b", "rail", 2, True, 300 * D, 0.0), (4, "a", "rail", 9, True, 200 * D, 0.0)]
    assert linked(spark, places, touching + other) == {(1, 1): (1, 100, "distance"), (1, 3): (2, 300, "distance"), (1, 4): (9, 200, "distance")}
    many = [(w, f"l{w}", "rail", w, True, (10 + w) * D, 0.0) for w in range(30)]
    assert set(linked(spark, places, many)) == {(1, w) for w in range(12)}
    assert linked(spark, [], many) == {}


LINES = "line string, class string, node int, lon double, lat double"


def passed(spark, places, track, turnouts=(), timetable=(), listed=()):
    frame = lambda rows, kinds: spark.createDataFrame(list(rows), kinds)
    rows = stations.passing(
        frame([(i, n, x, y) for i, n, x, y in places], "id int, name string, lon double, lat double"), frame(track, LINES), frame([(t,) for t in turnouts], "node int"),
        frame(timetable, "name string, lon double, lat double, fast boolean"), frame(listed, "name string, lon double, lat double"),
    ).collect()
    return {(r.station, r.line): (r.reason, r.kept) for r in rows}


def test_fast_lines_that_run_past(spark):
    x = lambda far: far * D
    slow, fast = ("old", "main", 1, x(10), 0.0), ("fast", "hsr350", 2, x(200), 0.0)
    here = [(1, "A", 0.0, 0.0)]
    none, near = ("plain track, no turnout near", False), lambda n: (f"nearer to {n}", False)
    assert passed(spark, here, [slow, fast]) == {(1, "fast"): none}
    assert passed(spark, here, [fast]) == {}  # never the last line
    assert passed(spark, here, [slow, fast], turnouts=[2]) == {}
    assert passed(spark, here, [slow, ("fast", "hsr350", 2, x(50), 0.0)]) == {}  # on the line
    assert passed(spark, here, [slow, ("freight", "main", 2, x(200), 0.0)]) == {}
    rival = [*here, (2, "B", x(220), 0.0)]
    both = [slow, fast, ("old", "main", 3, x(215), 0.0)]
    assert passed(spark, rival, both, turnouts=[2]) == {(1, "fast"): near("B")}
    assert passed(spark, [*here, (2, "A", x(220), 0.0)], both, turnouts=[2]) == {}  # of the same name
    assert passed(spark, [*here, (2, "B", x(350), 0.0)], both, turnouts=[2]) == {}  # no nearer by enough


def test_timetable_and_look_ups(spark):
    slow, fast = ("old", "main", 1, 10 * D, 0.0), ("fast", "hsr350", 2, 50 * D, 0.0)
    here = [(1, "A", 0.0, 0.0)]
    assert passed(spark, here, [slow, fast], timetable=[("A", 0.02, 0.0, False)]) == {(1, "fast"): ("no fast train in the timetable", False)}
    assert passed(spark, here, [slow, fast], timetable=[("A", 0.02, 0.0, True), ("A", 0.02, 0.0, False)]) == {}
    assert passed(spark, here, [slow, fast], timetable=[("A", 0.04, 0.0, False), ("B", 0.0, 0.0, False)]) == {}
    mixed = ("fast", "hsr200", 2, 50 * D, 0.0)  # old lines carry slow trains too
    assert passed(spark, here, [slow, mixed], timetable=[("A", 0.0, 0.0, False)]) == {}
    away = ("fast", "hsr350", 2, 200 * D, 0.0)
    assert passed(spark, here, [slow, away], timetable=[("A", 0.0, 0.0, True)]) == {(1, "fast"): ("plain track, no turnout near", True)}  # the two disagree
    assert passed(spark, here, [slow, fast], timetable=[("A", 0.0, 0.0, True)], listed=[("A", 0.001, 0.0)]) == {(1, "fast"): ("looked up: fast trains do not stop", False)}
    for listed in ([("B", 0.0, 0.0)], [("A", 0.1, 0.0)]):
        with pytest.raises(ValueError, match="exactly once"):
            passed(spark, here, [slow, fast], listed=listed)
