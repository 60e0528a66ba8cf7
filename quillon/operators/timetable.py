"""Timetable operators: calendars, validation with reasons, legs, instances and positions at an instant."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.geo import bearing, between, haversine
from quillon.functions.scalars import half_up, natural_key
from quillon.operators.joins import as_of

DAY = 86_400


def expand_calendar(weekly: DataFrame, exceptions: DataFrame) -> DataFrame:
    """service_id, date: days of the weekly pattern (weekdays: array of ISO numbers, start, end), with exceptions added (1) or removed (2).

    An exception outside the service's span counts too; of several on one day the last (by ``seq``) holds.
    """
    days = weekly.select("service_id", "weekdays", F.explode(F.sequence("start", "end")).alias("date"))
    days = days.where(F.array_contains("weekdays", F.weekday("date") + 1)).select("service_id", "date")
    last = exceptions.groupBy("service_id", "date").agg(F.max_by("kind", "seq").alias("kind"))
    added = last.where("kind = 1").select("service_id", "date")
    removed = last.where("kind = 2").select("service_id", "date")
    return days.unionByName(added).distinct().join(removed, ["service_id", "date"], "left_anti")


def normalised(stops: DataFrame) -> DataFrame:
    """Stop times with endpoint placeholders settled: the first arrival is its departure, the last departure its arrival."""
    by_trip = Window.partitionBy("trip_id")
    first, last = F.min("seq").over(by_trip), F.max("seq").over(by_trip)
    return stops.withColumns({"arr_s": F.when(F.col("seq") == first, F.col("dep_s")).otherwise(F.col("arr_s")), "dep_s": F.when(F.col("seq") == last, F.col("arr_s")).otherwise(F.col("dep_s"))})


def reasons(stops: DataFrame, longest: int = 7 * DAY) -> DataFrame:
    """trip_id, reason: the first failing row's reason of each trip, or ``ok``. In a row the first check wins."""
    order = Window.partitionBy("trip_id").orderBy("seq")
    before = F.lag("dep_s").over(order)
    reason = (
        F.when(F.col("arr_s").isNull() | F.col("dep_s").isNull(), "invalid_time")
        .when(F.col("dep_s") < F.col("arr_s"), "departure_before_arrival")
        .when(F.col("arr_s") <= before, "nonpositive_interstation_travel_time")
        .when(F.col("dep_s") - F.first("dep_s").over(order) > longest, "too_long")
    )
    rows = normalised(stops).withColumn("reason", reason)
    failed = rows.groupBy("trip_id").agg(F.min(F.when(F.col("reason").isNotNull(), F.struct("seq", "reason"))).alias("bad"), F.count(F.lit(1)).alias("n"))
    return failed.select("trip_id", F.when(F.col("n") < 2, "single_stop").otherwise(F.coalesce("bad.reason", F.lit("ok"))).alias("reason"))


def exemplars(rejects: DataFrame, k: int = 8) -> DataFrame:
    """reason, n, ids: how many trips have each reason, and the k least of their ids as text."""
    ranked = rejects.withColumn("rank", F.row_number().over(Window.partitionBy("reason").orderBy("trip_id")))
    few = F.sort_array(F.collect_list(F.when(F.col("rank") <= k, F.col("trip_id"))))
    return ranked.groupBy("reason").agg(F.count(F.lit(1)).alias("n"), F.array_join(few, ",").alias("ids"))


def legs(stops: DataFrame, places: DataFrame) -> DataFrame:
    """Each stop but the first with the leg that leads to it: seconds, metres and km/h. ``places``: stop_id, lon, lat."""
    order = Window.partitionBy("trip_id").orderBy("seq")
    at = places.select("stop_id", "lon", "lat")
    rows = stops.join(at, "stop_id").withColumns({f"prev_{c}": F.lag(c).over(order) for c in ("stop_id", "dep_s", "lon", "lat")})
    rows = rows.where(F.col("prev_stop_id").isNotNull())
    rows = rows.withColumns({"seconds": F.col("arr_s") - F.col("prev_dep_s"), "metres": half_up(haversine(F.col("prev_lon"), F.col("prev_lat"), F.col("lon"), F.col("lat")))})
    return rows.withColumn("kmh", F.when(F.col("seconds") > 0, F.col("metres") * 3.6 / F.col("seconds")))


def instances(stops: DataFrame, trips: DataFrame) -> DataFrame:
    """One row for each run: trip_id, service_date, train_type, start and end in seconds since the epoch."""
    ends = stops.groupBy("trip_id").agg(F.min_by("dep_s", "seq").alias("first_s"), F.max_by("arr_s", "seq").alias("last_s"))
    midnight = F.datediff("service_date", F.lit("1970-01-01").cast("date")).cast("long") * DAY
    return trips.join(ends, "trip_id").withColumns({"start_at": midnight + F.col("first_s"), "end_at": midnight + F.col("last_s")}).select("trip_id", "service_date", "train_type", "start_at", "end_at")


def active_at(runs: DataFrame, t: Column) -> DataFrame:
    """Runs with start <= t < end."""
    return runs.where((F.col("start_at") <= t) & (t < F.col("end_at")))


def active_series(runs: DataFrame, instants: DataFrame, bucket: int = 6 * 3600) -> DataFrame:
    """Active runs of many instants (``t``): a range join turned into an equi-join on time buckets, then the exact test.

    A run is copied once for each bucket that it touches, so work follows the runs' lengths, not their number times the instants'.
    """
    cut = lambda x: F.floor(x / bucket).cast("long")
    spread = runs.where("end_at > start_at").withColumn("bucket", F.explode(F.sequence(cut(F.col("start_at")), cut(F.col("end_at") - 1))))
    return instants.withColumn("bucket", cut(F.col("t"))).join(spread, "bucket").where("start_at <= t AND t < end_at").drop("bucket")


def position_at(stops: DataFrame, runs: DataFrame, places: DataFrame, t: Column) -> DataFrame:
    """Status, place, progress, heading and next event of every run that is active at t.

    Between stops a run moves evenly in time along the straight leg; at a stop it dwells. NULL coordinates stay NULL.
    """
    order = Window.partitionBy("trip_id", "service_date").orderBy("seq")
    midnight = F.datediff("service_date", F.lit("1970-01-01").cast("date")).cast("long") * DAY
    rows = active_at(runs, t).join(normalised(stops), "trip_id").join(places.select("stop_id", "lon", "lat"), "stop_id", "left")
    rows = rows.withColumns({"arr": midnight + F.col("arr_s"), "dep": midnight + F.col("dep_s")})
    rows = rows.withColumns({f"next_{c}": F.lead(c).over(order) for c in ("stop_id", "arr", "lon", "lat")})
    here = rows.where((F.col("arr") <= t) & (t < F.coalesce(F.col("next_arr"), F.col("end_at") + 1)))
    here = here.withColumn("turn", F.row_number().over(Window.partitionBy("trip_id", "service_date").orderBy(F.desc("seq")))).where("turn = 1")
    dwell = t < F.col("dep")
    share = F.when(dwell | F.col("next_arr").isNull(), 0.0).otherwise((t - F.col("dep")) / (F.col("next_arr") - F.col("dep")))
    return here.select(
        "trip_id", "service_date", F.when(dwell, "dwell").otherwise("running").alias("status"), "stop_id", "next_stop_id",
        between(F.col("lon"), F.coalesce("next_lon", "lon"), share).alias("lon"), between(F.col("lat"), F.coalesce("next_lat", "lat"), share).alias("lat"),
        share.alias("progress"), bearing(F.col("lon"), F.col("lat"), F.col("next_lon"), F.col("next_lat")).alias("heading"),
        (F.when(dwell, F.col("dep")).otherwise(F.col("next_arr")) - t).alias("seconds_to_next"), F.when(dwell, "departure").otherwise("arrival").alias("next_event"),
    )


def positions_along(stops: DataFrame, runs: DataFrame, shapes: DataFrame, t: Column) -> DataFrame:
    """Status and place on its shape of every run at t: scheduled before it starts, dwell at a stop, running between two, finished from its
    end on.

    ``stops`` have the ``distance`` of each stop along the trip's shape; ``shapes``: trip_id, along, lon, lat of every vertex. Between stops
    a run moves evenly in time along the shape. The vertex behind it comes from an as-of join. Heading is that of the leg it is on, NULL
    unless it moves.
    """
    order = Window.partitionBy("trip_id", "service_date").orderBy("seq")
    midnight = F.datediff("service_date", F.lit("1970-01-01").cast("date")).cast("long") * DAY
    rows = runs.join(normalised(stops), "trip_id").withColumns({"arr": midnight + F.col("arr_s"), "dep": midnight + F.col("dep_s")})
    rows = rows.withColumns({f"next_{c}": F.lead(c).over(order) for c in ("stop_id", "arr", "distance")})
    status = F.when(t < F.col("start_at"), "scheduled").when(t >= F.col("end_at"), "finished").when((F.col("arr") <= t) & (t < F.col("dep")), "dwell").otherwise("running")
    holds = F.when(status == "scheduled", F.col("seq") == F.min("seq").over(Window.partitionBy("trip_id", "service_date")))
    holds = holds.when(status == "finished", F.col("next_arr").isNull()).otherwise(((F.col("arr") <= t) & (t < F.col("dep"))) | ((F.col("dep") <= t) & (t < F.col("next_arr"))))
    here = rows.withColumns({"status": status, "holds": holds}).where("holds")
    moving = F.col("status") == "running"
    here = here.withColumn("progress", F.when(moving, (t - F.col("dep")) / (F.col("next_arr") - F.col("dep"))).when(F.col("status") == "finished", 1.0).otherwise(0.0))
    here = here.withColumn("at", F.col("distance") + F.when(moving, (F.col("next_distance") - F.col("distance")) * F.col("progress")).otherwise(0.0))
    along = Window.partitionBy("trip_id").orderBy("along")
    legs = shapes.withColumns({f"to_{c}": F.lead(c).over(along) for c in ("along", "lon", "lat")})
    on = as_of(here, legs, ["trip_id"], "at", "along", ["along", "lon", "lat", "to_along", "to_lon", "to_lat"])
    length = F.col("last_to_along") - F.col("last_along")
    share = F.when(length > 0, (F.col("at") - F.col("last_along")) / length).otherwise(0.0)
    at = lambda c: between(F.col(f"last_{c}"), F.coalesce(f"last_to_{c}", f"last_{c}"), share)
    heading = bearing(F.col("last_lon"), F.col("last_lat"), F.col("last_to_lon"), F.col("last_to_lat"))
    event = F.when(F.col("status") == "finished", F.lit(None).cast("string")).when(moving, "arrival").otherwise("departure")
    due = F.when(F.col("status") == "scheduled", F.col("start_at")).when(moving, F.col("next_arr")).when(F.col("status") == "dwell", F.col("dep"))
    return on.select("trip_id", "service_date", "status", "stop_id", F.when(moving, F.col("next_stop_id")).alias("next_stop_id"), "progress", at("lon").alias("lon"), at("lat").alias("lat"),
                     F.when(moving & (F.col("next_distance") > F.col("distance")), heading).alias("heading"), event.alias("next_event"), (due - t).alias("seconds_to_next"))


def trip_list(active: DataFrame, calls: DataFrame, query: str | None, types: list[str], box: tuple[float, float, float, float] | None = None) -> DataFrame:
    """trip_id, rank: the trips shown, in order. ``active``: trip_id, number, train_type, renderable, lon, lat; ``calls``: trip_id, stop_name.

    A query keeps trips whose number, or a stop of which, holds it (blanks and case don't count); the trip of that very number comes first.
    Without one, trips with a drawable path come first. Then by number, in natural order. A box keeps drawable trips inside it.
    """
    rows = active.where(F.col("train_type").isin(*types))
    key = "".join((query or "").upper().split())
    if key:
        named = calls.where(F.contains("stop_name", F.lit(key))).select("trip_id").distinct().withColumn("named", F.lit(True))
        rows = rows.join(named, "trip_id", "left").where(F.contains(F.upper("number"), F.lit(key)) | F.col("named"))
        first = F.when(F.upper("number") == key, 0).otherwise(1)
    else:
        first = F.when(F.col("renderable"), 0).otherwise(1)
    if box:
        rows = rows.where(F.col("renderable") & F.col("lon").between(box[0], box[2]) & F.col("lat").between(box[1], box[3]))
    return rows.withColumn("first", first).select("trip_id", "number", "first", natural_key(F.col("number")).alias("key"))


def stale(snapshots: DataFrame, today: Column, days: int = 3) -> DataFrame:
    """Snapshots (feed, day) with their age in days and whether that is more than allowed."""
    age = F.datediff(today, F.col("day"))
    return snapshots.withColumns({"age": age, "stale": age > days})


def ranked_instances(runs: DataFrame, t: Column, by: list[str]) -> DataFrame:
    """Runs ranked within ``by``: active first, then future (nearest first), then past (latest end first)."""
    group = F.when((F.col("start_at") <= t) & (t < F.col("end_at")), 0).when(F.col("start_at") > t, 1).otherwise(2)
    key = F.when(group == 2, -F.col("end_at")).otherwise(F.col("start_at"))
    rows = runs.withColumns({"state": group, "sort_key": key})
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy("state", "sort_key", "trip_id"))).drop("sort_key")


def preferred_instance(runs: DataFrame, t: Column, by: list[str]) -> DataFrame:
    return ranked_instances(runs, t, by).where("rank = 1").drop("rank")
