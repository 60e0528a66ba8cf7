"""Event-time operators. Each works on a batch and on a stream alike; ``ts`` is cast to TIMESTAMP, which watermarks need."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, folder: str, schema, files_per_trigger: int = 1) -> DataFrame:
    """Parquet files of a folder as a stream, a few files a micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def timed(events: DataFrame, late: str | None = None) -> DataFrame:
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return rows.withWatermark("ts", late) if late else rows


def tumbling(events: DataFrame, width: str, late: str | None = None, slide: str | None = None) -> DataFrame:
    """event_type, window_start, n, total for each (sliding, if ``slide``) window."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    out = timed(events, late).groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select("event_type", F.col("w.start").alias("window_start"), "n", "total")


def sessions(events: DataFrame, gap: str, late: str | None = None) -> DataFrame:
    """user_id, session_start, session_end (last event plus gap), n."""
    out = timed(events, late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return out.select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def dedupe_stream(events: DataFrame, keys: list[str], within: str) -> DataFrame:
    return timed(events, within).dropDuplicatesWithinWatermark(keys)


class Limiter:
    """Which requests of one asker pass: none within ``ttl`` seconds of the last that passed for the same thing, nor within ``gap`` of the
    last that passed at all. State: (time of the last, {thing: time of its last}), in microseconds."""

    def __init__(self, ttl: int, gap: int):
        self.ttl, self.gap = ttl * 1_000_000, gap * 1_000_000

    def passed(self, times: list[int], things: list[str], last: int | None, by_thing: dict[str, int]) -> tuple[list[bool], int | None]:
        out = []
        for at, thing in zip(times, things, strict=True):
            before = by_thing.get(thing)
            ok = (before is None or at - before >= self.ttl) and (last is None or at - last >= self.gap)
            if ok:
                by_thing[thing] = last = at
            out.append(ok)
        return out, last


def accepted(events: DataFrame, by: list[str], thing: str, ttl: int, gap: int) -> DataFrame:
    """Events that a cache of ``ttl`` seconds for each thing and a limit of one in ``gap`` seconds for each asker let pass.

    What counts is the last event that passed, so one asker's events are read in order; they stream through, and only the times of the
    last that passed are held.
    """
    rows = timed(events).withColumns({"l_key": F.to_json(F.struct(*by)), "l_us": F.unix_micros("ts"), "l_thing": F.coalesce(F.col(thing).cast("string"), F.lit(""))})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        limiter, key, last, by_thing = Limiter(ttl, gap), None, None, {}
        for pdf in batches:
            keep = []
            for k, part in pdf.groupby("l_key", sort=False):
                if k != key:
                    key, last, by_thing = k, None, {}
                ok, last = limiter.passed(part["l_us"].tolist(), part["l_thing"].tolist(), last, by_thing)
                keep.append(part[ok])
            if keep:
                yield pd.concat(keep)

    passed = rows.repartition("l_key").sortWithinPartitions("l_key", "l_us", "event_id").mapInPandas(run, rows.schema)
    return passed.drop("l_key", "l_us", "l_thing")


def accepted_stream(events: DataFrame, late: str, ttl: int, gap: int) -> DataFrame:
    """user_id, event_id, event_type of the events that pass, micro-batch by micro-batch (see ``accepted``; keyed state, times out)."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last, things, times = state.get if state.exists else (-1, [], [])
        by_thing, limiter = dict(zip(things, times, strict=True)), Limiter(ttl, gap)
        pdf = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        at = pdf["ts"].astype("datetime64[us, UTC]" if pdf["ts"].dt.tz is not None else "datetime64[us]").astype("int64").tolist()
        ok, last = limiter.passed(at, pdf["event_type"].tolist(), None if last < 0 else last, by_thing)
        state.update((-1 if last is None else last, list(by_thing), list(by_thing.values())))
        state.setTimeoutTimestamp(max((last or 0) // 1000 + 1000 * max(ttl, gap), state.getCurrentWatermarkMs() + 1))
        yield pdf.loc[ok, ["user_id", "event_id", "event_type"]]

    rows = timed(events, late).select("user_id", "event_id", "event_type", "ts")
    return rows.groupBy("user_id").applyInPandasWithState(run, "user_id long, event_id long, event_type string", "last long, things array<string>, times array<long>", "append", "EventTimeTimeout")


def late_rows(events: DataFrame, order: str, seconds: int) -> DataFrame:
    """Rows behind the largest time seen before them (in arrival order, by hour of arrival key) by more than ``seconds``."""
    w = Window.partitionBy("user_id").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    seen = timed(events).withColumn("high", F.max("ts").over(w))
    return seen.where(F.unix_micros("high") - F.unix_micros("ts") > seconds * 1_000_000)


def last_positions(events: DataFrame, late: str) -> DataFrame:
    """user_id, event_type, value, n: after each micro-batch the latest event of each user and how many came (keyed state, times out)."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        ts, kind, value, n = state.get if state.exists else (-1, "", 0.0, 0)
        for pdf in batches:
            n += len(pdf)
            last = pdf.loc[pdf["ts"].idxmax()]
            at = int(last["ts"].value)
            if at >= ts:
                ts, kind, value = at, str(last["event_type"]), float(last["value"])
        state.update((ts, kind, value, n))
        state.setTimeoutTimestamp(max(ts // 1_000_000 + 3_600_000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"user_id": [key[0]], "event_type": [kind], "value": [value], "n": [n]})

    rows = timed(events, late)
    return rows.groupBy("user_id").applyInPandasWithState(run, "user_id long, event_type string, value double, n long", "ts long, event_type string, value double, n long", "update", "EventTimeTimeout")


def stream_static_positions(events: DataFrame, places: DataFrame, key: str) -> DataFrame:
    """Events of a stream with the attributes of a small dimension."""
    return timed(events).join(places, key, "left")
