"""Conforming operators: names, identities, evidence and display properties of lines and stations, as column expressions and joins."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.scalars import colour, grade, parse_speeds
from quillon.operators.joins import cut, within
from quillon.operators.network import M


def filled(*values: Column) -> Column:
    """The first value that is neither NULL nor empty."""
    return F.coalesce(*[F.when(v != "", v) for v in values])


# --- names ------------------------------------------------------------------------------------------------------------

#: Brackets that no attached name may hold; what ends the name in a longer text; the digits of written numbers.
BRACKETS = r"[()（）\[\]【】{}「」]"
NAME_END = r"[:：(（]|→|➡|=>|-->|⇒"
HAN, HAN_DIGITS, HAN_PLACES = "一-鿿", "零一二三四五六七八九", {"十": 10, "百": 100}
#: Letters, and what stands between the words of a name in them.
_LATIN = "A-Za-zÀ-ÿ .'\\-"


def script_runs(text: Column) -> Column:
    """A text cut where its script changes: runs of Han signs, of Latin words with their blanks, and of all else."""
    return F.regexp_extract_all(text, F.lit(f"[{HAN}]+|[{_LATIN}]+|[^{HAN}{_LATIN}]+"), F.lit(0))


def own_script(name: Column) -> Column:
    """The part of a name in its own script.

    The name ends at the first sign of NAME_END. Where any of its runs is Han, a translation goes: a Latin last run that is set off by a
    blank, and a Latin first run in small letters right before a Han one (a single capital is part of the name). Blanks between the rest close up,
    and one variant sign is made uniform.
    """
    plain = F.trim(F.get(F.split(F.translate(F.coalesce(name, F.lit("")), "\ufe0f\u20e3", ""), NAME_END, 2), F.lit(0)))
    runs = script_runs(plain)
    is_han = lambda r: F.coalesce(r.rlike(f"^[{HAN}]"), F.lit(False))
    is_latin = lambda r: r.rlike(f"^[{_LATIN}]") & r.rlike("[A-Za-zÀ-ÿ]")

    def stays(run: Column, i: Column) -> Column:
        last = (i > 0) & (i == F.size(runs) - 1) & run.startswith(" ")
        first = (i == 0) & run.rlike("[a-zß-ÿ]") & is_han(F.get(runs, i + 1))
        return ~(is_latin(run) & (last | first))

    kept = F.array_join(F.filter(runs, stays), "")
    return F.when(F.exists(runs, is_han), F.translate(F.regexp_replace(kept, r"\s", ""), "臺", "台")).otherwise(plain)


def written_number(text: Column) -> Column:
    """The value of a number written in Han digits, as text, sign by sign: a digit waits, a place sign takes what waits (or one) so many times,
    digits in a row are read as decimals. NULL for an empty text or any other sign."""
    signs = F.filter(F.split(text, ""), lambda c: c != "")
    number = "struct<total:bigint,held:bigint,waits:boolean>"

    def step(acc: Column, sign: Column) -> Column:
        digit = (F.instr(F.lit(HAN_DIGITS), sign) - 1).cast("bigint")
        place = F.lit(0).cast("bigint")
        for name, value in HAN_PLACES.items():
            place = F.when(sign == name, F.lit(value).cast("bigint")).otherwise(place)
        taken = F.struct((acc["total"] + F.when(acc["waits"], acc["held"]).otherwise(F.lit(1)) * place).alias("total"), F.lit(0).cast("bigint").alias("held"), F.lit(False).alias("waits"))
        read = F.struct(acc["total"].alias("total"), (acc["held"] * 10 + digit).alias("held"), F.lit(True).alias("waits"))
        return F.when(place > 0, taken).when(digit >= 0, read).cast(number)

    start = F.struct(F.lit(0).cast("bigint").alias("total"), F.lit(0).cast("bigint").alias("held"), F.lit(False).alias("waits")).cast(number)
    value = F.aggregate(signs, start, step)
    return F.when(F.size(signs) > 0, (value["total"] + value["held"]).cast("string"))


def numbered(line: Column) -> Column:
    """Numbers that are written in Han digits right before the word for a numbered line, in decimal digits."""
    parts = F.split(line, "号线", -1)
    signs = f"[{HAN_DIGITS[1:]}{''.join(HAN_PLACES)}]"

    def counted(part: Column, i: Column) -> Column:
        tail = F.regexp_extract(part, f"{signs}+$", 0)
        head = F.substring(part, F.lit(1), F.char_length(part) - F.char_length(tail))
        return F.when((i == F.size(parts) - 1) | (tail == ""), part).otherwise(F.concat(head, written_number(tail)))

    return F.array_join(F.transform(parts, counted), "号线")


def attached(n: Column, other: Column) -> Column:
    """Another name of a thing called ``n``, where it is known, differs and holds no bracket; else NULL."""
    return F.when((other != "") & ~other.eqNullSafe(n) & ~other.rlike(BRACKETS), other)


# --- identity ---------------------------------------------------------------------------------------------------------


def line_of_route(route: dict[str, Column], master: dict[str, Column]) -> tuple[Column, Column, Column]:
    """(network, line name, colour) of a route from its tags and those of its master (network, operator, name, ref, colour)."""
    network = F.coalesce(filled(route["network"], master["network"], route["operator"], master["operator"]), F.lit(""))
    own = F.get(F.split(F.coalesce(route["name"], F.lit("")), r":\s", 2), F.lit(0))
    name = F.coalesce(filled(master["name"], own, route["ref"], network), F.lit(""))
    prefixed = (network != "") & F.startswith(name, F.concat(network, F.lit(":")))
    name = F.when(prefixed, F.substr(name, F.char_length(network) + 2)).otherwise(name)
    return F.trim(network), F.trim(F.regexp_replace(name, r"\s+", " ")), colour(filled(route["colour"], master["colour"]))


def bound_identities(routes: DataFrame, candidates: DataFrame, on: list[str]) -> DataFrame:
    """Routes with the canonical key of the one candidate that equals them in every column of ``on`` (NULLs are equal, arrays in any order)."""
    kinds = {f.name: f.dataType.simpleString() for f in routes.schema}
    key = lambda df, c: F.array_sort(df[c]) if kinds[c].startswith("array") else df[c]
    own = candidates.select(*[key(candidates, c).alias(f"c_{c}") for c in on], "canonical")
    one = own.groupBy(*[f"c_{c}" for c in on]).agg(F.min("canonical").alias("canonical"), F.count_distinct("canonical").alias("n")).where("n = 1").drop("n")
    match = F.lit(True)
    for c in on:
        match = match & key(routes, c).eqNullSafe(F.col(f"c_{c}"))
    return routes.join(one, match, "left").drop(*[f"c_{c}" for c in on])


def left_to_neighbours(lines: DataFrame, abroad: DataFrame, cities: DataFrame, home: str) -> DataFrame:
    """line, owner: lines (line, relations, lon, lat) of which a neighbour (country, relation) has a relation too go to the country of the
    nearest city (country, city, lon, lat) among home's and those neighbours'; only those that leave home come back."""
    shared = lines.select("line", "lon", "lat", F.explode("relations").alias("relation")).join(abroad, "relation")
    claims = shared.select("line", "lon", "lat", "country").unionByName(shared.select("line", "lon", "lat", F.lit(home).alias("country"))).distinct()
    at = cities.select("country", "city", F.col("lon").alias("c_lon"), F.col("lat").alias("c_lat"))
    far = F.hypot((F.col("c_lon") - F.col("lon")) * F.cos(F.radians("lat")), F.col("c_lat") - F.col("lat"))
    best = claims.join(at, "country").groupBy("line").agg(F.min(F.struct(far.alias("far"), "city", "country")).alias("best"))
    return best.select("line", F.col("best.country").alias("owner")).where(F.col("owner") != home)


# --- evidence and display ---------------------------------------------------------------------------------------------


def speed_evidence(design: list[Column], limit: Column) -> Column:
    """struct(speed, limited): the design speed if every design tag given holds one value and all agree; else a single operating limit,
    marked as such; else NULL."""
    given = [F.when(d != "", d) for d in design]
    values = [parse_speeds(d) for d in given]
    present = F.filter(F.array(*given), lambda x: x.isNotNull())
    single = F.lit(True)
    for d, v in zip(given, values, strict=True):
        single = single & (d.isNull() | F.coalesce(F.size(v) == 1, F.lit(False)))
    agreed = F.array_distinct(F.filter(F.array(*[F.get(v, F.lit(0)) for v in values]), lambda x: x.isNotNull()))
    allowed = parse_speeds(limit)
    designed = (F.size(present) > 0) & single & (F.size(agreed) == 1)
    return F.when(designed, F.struct(F.get(agreed, F.lit(0)).alias("speed"), F.lit(False).alias("limited"))).when(F.size(allowed) == 1, F.struct(F.get(allowed, F.lit(0)).alias("speed"), F.lit(True).alias("limited")))


def display(kind: Column, main_kinds: list[str], speed: Column, estimated: Column, own_colour: Column, source: Column) -> dict[str, Column]:
    """Columns of a line's look: its class or the grade of its speed, the speed, whether it is estimated, its colour (lines without a speed
    only) and where the speed comes from."""
    look = F.when(speed.isNotNull(), grade(speed).cast("string")).when(kind.isin(*main_kinds), "main").otherwise("branch")
    return {
        "look": look, "speed": speed, "estimated": F.when(speed.isNotNull() & estimated, F.lit(1)),
        "colour": F.when(speed.isNull(), own_colour), "source": F.when(speed.isNotNull(), filled(source)),
    }


def colour_votes(tracks: DataFrame, services: DataFrame, least: float = 0.25, weak: float = 0.5) -> DataFrame:
    """line, colour: the best colour that services give their lines. ``tracks``: way, line, km, tram; ``services``: service, colour, tram, way.

    Lines that aren't tramways (half their length or less is tram track) are voted on by services that aren't trams, over track that isn't
    tram track; tramways by every service over all their track. A service scores the share of the line that it covers times the share of
    its own length on the line, and a point less where either is under ``weak``; under ``least`` it has no vote. Ties: the larger colour.
    """
    sizes = tracks.groupBy("line").agg((2 * F.sum(F.when(F.col("tram"), F.col("km")).otherwise(0.0)) > F.sum("km")).alias("tramway"))
    way = tracks.join(sizes, "line")
    runs = services.select("service", "colour", F.col("tram").alias("tram_service"), "way").distinct().join(way, "way")
    counts = F.col("tramway") | ~F.col("tram")
    line_km = way.where(counts).groupBy("line").agg(F.sum("km").alias("line_km"))
    # a service's length is taken once for each of the two votes: over all track, and over that which isn't tram track
    own = runs.groupBy("service", "colour", "tram_service").agg(F.sum("km").alias("all_km"), F.sum(F.when(~F.col("tram"), F.col("km")).otherwise(0.0)).alias("plain_km"))
    on = runs.where(counts & (F.col("tramway") | ~F.col("tram_service"))).groupBy("service", "colour", "tram_service", "line", "tramway").agg(F.sum("km").alias("km"))
    both = on.join(own, ["service", "colour", "tram_service"]).join(line_km, "line")
    cover, mostly = F.col("km") / F.col("line_km"), F.col("km") / F.when(F.col("tramway"), F.col("all_km")).otherwise(F.col("plain_km"))
    both = both.withColumns({"cover": cover, "mostly": mostly}).where((F.col("cover") >= least) & (F.col("mostly") >= least))
    score = F.col("cover") * F.col("mostly") - F.when((F.col("cover") < weak) | (F.col("mostly") < weak), 1.0).otherwise(0.0)
    best = both.groupBy("line", "tramway", "colour").agg(F.max(score).alias("score"))
    best = best.groupBy("line", "tramway").agg(F.max(F.struct("score", "colour")).alias("best"))
    return best.where(F.col("best.score") > F.when(F.col("tramway"), -0.95).otherwise(0.0)).select("line", F.col("best.colour").alias("colour"))


# --- places -----------------------------------------------------------------------------------------------------------


def first_per_cell(points: DataFrame, by: list[str], order: list[str], per_degree: int = 300) -> DataFrame:
    """One point for each key and rounded cell: the first by ``order``."""
    cell = [F.round(F.col(c) * per_degree).cast("long") for c in ("lon", "lat")]
    rank = F.row_number().over(Window.partitionBy(*by, *cell).orderBy(*order))
    return points.withColumn("c_rank", rank).where("c_rank = 1").drop("c_rank")


def named_nearby(points: DataFrame, names: DataFrame, metres: float) -> DataFrame:
    """Points (id, name, lon, lat) with the ``value`` of the nearest row of their own name within reach (ties: the smaller value), else NULL."""
    rows = names.select(F.col("name").alias("r_name"), F.col("lon").alias("r_lon"), F.col("lat").alias("r_lat"), "value")
    pairs = within(points.select("id", "name", "lon", "lat"), rows, metres, by={"name": "r_name"})
    best = pairs.groupBy("id").agg(F.min(F.struct("metres", "value")).alias("best")).select("id", F.col("best.value").alias("value"))
    return points.join(best, "id", "left")


def _lines_within(points: DataFrame, rows: DataFrame, metres: float, by: tuple[str, ...] = ()) -> DataFrame:
    """id, held: all lines that have a row (line, lon, lat) within reach of a point (id, lon, lat) and of its ``by``.

    Small cells are compared first: two cells that lie within reach whatever places of theirs are taken share all lines, and two that can't be within reach share
    none. Only lines that stay in doubt for a point are looked for row by row.
    """
    side = metres / M / 5
    radius = M * side * math.sqrt(0.5) * 1.001  # M is more than a degree has
    cell = lambda c: F.floor(F.col(c) / side).cast("long")
    middle = lambda c: (F.col(c) + 0.5) * side
    spot = lambda lon, lat: [middle("x").alias(lon), F.least(F.lit(90.0), F.greatest(F.lit(-90.0), middle("y"))).alias(lat)]
    theirs = {c: f"r_{c}" for c in by}
    rows = rows.select(*by, "line", "lon", "lat").distinct()
    placed, key = points.withColumns({"x": cell("lon"), "y": cell("lat")}), [*by, "x", "y"]
    lenders = rows.groupBy(*by, cell("lon").alias("x"), cell("lat").alias("y")).agg(F.collect_set("line").alias("lent"))
    met = within(placed.select(*key).distinct().select(*key, *spot("lon", "lat")), lenders.select(*spot("r_lon", "r_lat"), "lent", *[F.col(c).alias(o) for c, o in theirs.items()]), metres + 2 * radius, by=theirs)
    met = met.select(*key, F.explode("lent").alias("line"), (F.col("metres") <= metres - 2 * radius).alias("sure")).groupBy(*key, "line").agg(F.max("sure").alias("sure"))
    met = met.groupBy(*key).agg(F.collect_set(F.when(F.col("sure"), F.col("line"))).alias("sure"), F.collect_set(F.when(~F.col("sure"), F.col("line"))).alias("doubt"))
    every = cut(placed.join(cut(met), key).select("id", *by, "lon", "lat", "sure", "doubt"))
    asked = every.select("id", *by, "lon", "lat", F.explode("doubt").alias("line"))
    others = rows.select(F.col("line").alias("r_line"), F.col("lon").alias("r_lon"), F.col("lat").alias("r_lat"), *[F.col(c).alias(o) for c, o in theirs.items()])
    lent = within(asked, others, metres, by={**theirs, "line": "r_line"}).groupBy("id").agg(F.collect_set("line").alias("held"))
    return every.select("id", F.col("sure").alias("held")).unionByName(lent).groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("held"))).alias("held"))


def lines_at(points: DataFrame, stops: DataFrame, same_place: float, same_name: float) -> DataFrame:
    """id, lines (sorted): the lines whose stops (line, name, lon, lat) lie at a point (id, name, lon, lat), whatever they are called, or near
    it under its name; points of one name near each other share their lines."""
    own = points.select("id", "name", "lon", "lat")
    here = _lines_within(own, stops, same_place).unionByName(_lines_within(own, stops, same_name, ("name",)))
    here = cut(here.groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("held"))).alias("held")))
    # what points of a name lend one another; their own lines are among these
    lent = _lines_within(own, own.join(here, "id").select("name", "lon", "lat", F.explode("held").alias("line")), same_name, ("name",))
    found = here.unionByName(lent).groupBy("id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("held")))).alias("lines"))
    return points.select("id").join(found, "id", "left").withColumn("lines", F.coalesce("lines", F.array().cast("array<string>")))


def depot_names(named: DataFrame, rules: DataFrame) -> DataFrame:
    """Named ground (country, id, name, form, share) that names a depot. ``rules`` has a row of patterns for each country: never, strict, more.

    A yard or depot by its own tag always does, unless its name never is one; railway ground with a depot word does; other ground if a
    third of a fan lies in it and it has a depot word, or by a strict name alone.
    """
    r = named.join(rules, "country").where((F.col("name") != "") & ~F.expr("regexp_like(name, never)"))
    more, strict = F.expr("regexp_like(name, more)"), F.expr("regexp_like(name, strict)")
    tagged = F.col("form").isin("railway=yard", "railway=depot")
    ground = F.when(F.col("form") == "landuse=railway", more).otherwise(((F.col("share") >= 1 / 3) & more) | strict)
    return r.where(tagged | ground).select(*named.columns)


def drawn_at(features: DataFrame, rules: DataFrame, names: list[str]) -> DataFrame:
    """Rows for a tile cutter: each feature (layer, kind, properties) from its rule's lowest zoom on; where labels begin later, one row
    without its names up to there and one with them from there on. ``rules``: layer, kind, low, label."""
    rows = features.join(F.broadcast(rules), ["layer", "kind"])  # a rule table: a row for each layer and kind
    named = F.arrays_overlap(F.map_keys("properties"), F.array(*map(F.lit, names)))
    bare = F.map_filter("properties", lambda k, v: ~k.isin(*names))
    part = lambda low, high, p: F.struct(low.alias("minzoom"), high.alias("maxzoom"), p.alias("properties"))
    none, label = F.lit(None).cast("int"), F.col("label").cast("int")
    two = F.array(part(F.col("low").cast("int"), label - 1, bare), part(label, none, F.col("properties")))
    one = F.array(part(F.col("low").cast("int"), none, F.col("properties")))
    cut = F.explode(F.when((F.col("label") > F.col("low")) & named, two).otherwise(one)).alias("x")
    keep = [c for c in features.columns if c != "properties"]
    return rows.select(*keep, cut).select(*keep, "x.minzoom", "x.maxzoom", "x.properties")


# --- easing -----------------------------------------------------------------------------------------------------------


def smoothstep(t: Column) -> Column:
    """0 to 1 with level ends (fifth degree)."""
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    return t * t * t * (t * (t * 6 - 15) + 10)


def ramps(runs: DataFrame, width: float) -> DataFrame:
    """line, low, high, before, after: where the value of a run (line, start, end, value, count) eases into that of the next.

    A ramp lies before the cut where the next run counts more lines, behind it where it counts fewer, and half and half where the counts are
    equal; it takes ``width`` on a side, and 0.45 of the run at most.
    """
    order = Window.partitionBy("line").orderBy("start")
    rows = runs.withColumns({f"n_{c}": F.lead(c).over(order) for c in ("start", "end", "value", "count")}).where("n_value IS NOT NULL AND value <> n_value")
    left = F.least(F.lit(width), 0.45 * (F.col("end") - F.col("start")))
    right = F.least(F.lit(width), 0.45 * (F.col("n_end") - F.col("n_start")))
    more, fewer = F.col("count") < F.col("n_count"), F.col("count") > F.col("n_count")
    low = F.when(more, F.col("end") - left).when(fewer, F.col("n_start")).otherwise(F.col("end") - left / 2)
    high = F.when(more, F.col("end")).when(fewer, F.col("n_start") + right).otherwise(F.col("n_start") + right / 2)
    return rows.select("line", low.alias("low"), high.alias("high"), F.col("value").alias("before"), F.col("n_value").alias("after")).where("high > low")


def eased(samples: DataFrame, runs: DataFrame, width: float) -> DataFrame:
    """Samples (line, at) with the eased value there."""
    own = ramps(runs, width).groupBy("line").agg(F.array_sort(F.collect_list(F.struct("low", "high", "before", "after"))).alias("ramps"))
    base = runs.groupBy("line").agg(F.min_by("value", "start").cast("double").alias("base"))
    rows = samples.join(base, "line").join(own, "line", "left")
    inside = F.filter("ramps", lambda r: (r["low"] <= F.col("at")) & (F.col("at") <= r["high"]))
    passed = F.filter("ramps", lambda r: F.col("at") >= r["high"])
    r = F.get(inside, F.lit(0))
    on = r["before"] + (r["after"] - r["before"]) * smoothstep((F.col("at") - r["low"]) / (r["high"] - r["low"]))
    last = F.element_at(F.when(F.size(passed) > 0, passed), -1)["after"]
    return rows.select(*samples.columns, F.coalesce(on, last, F.col("base")).cast("double").alias("value"))


def distances_valid(stops: DataFrame, shapes: DataFrame, slack: float = 2.0) -> DataFrame:
    """trip_id, valid: whether the shape distances of a trip's stops (trip_id, shape_id, seq, distance) never fall, stay on the shape
    (shape_id, length; with some slack) and get ahead in all."""
    order = Window.partitionBy("trip_id").orderBy("seq")
    rows = stops.join(shapes, "shape_id", "left").withColumn("before", F.lag("distance").over(order))
    fine = F.col("distance").isNotNull() & (F.col("distance") >= 0) & (F.col("distance") + 1e-6 >= F.coalesce("before", F.lit(0.0))) & (F.col("distance") <= F.col("length") + slack)
    ahead = F.max_by("distance", "seq") > F.min_by("distance", "seq")
    return rows.groupBy("trip_id").agg((F.bool_and(F.coalesce(fine, F.lit(False))) & F.coalesce(ahead, F.lit(False))).alias("valid"))


def nearest_city(points: DataFrame, cities: DataFrame, elsewhere: str) -> DataFrame:
    """Points (id, lon, lat) with the nearest city (city, lon, lat, reach in metres) that reaches them; ties: the smaller name.

    Of cities at one place, one counts only where those before it by name don't reach as far. The search goes out in steps: a city that is found is the
    nearest, so only points without one go on.
    """
    before = Window.partitionBy("lon", "lat").orderBy("city").rowsBetween(Window.unboundedPreceding, -1)
    at = cities.withColumn("covered", F.max("reach").over(before)).where("covered IS NULL OR covered < reach")
    at = cut(at.select("city", F.col("lon").alias("r_lon"), F.col("lat").alias("r_lat"), "reach"))
    most = float(at.agg(F.max("reach")).first()[0] or 0.0)
    todo, best = points.select("id", "lon", "lat"), None
    for metres in (most / 4, most / 2, most):
        met = within(todo, at, metres).where("metres < reach").groupBy("id").agg(F.min(F.struct("metres", "city")).alias("best"))
        met = cut(met)
        best = met if best is None else best.unionByName(met)
        todo = todo.join(met.select("id"), "id", "left_anti")
    return points.join(best.select("id", F.col("best.city").alias("city")), "id", "left").withColumn("city", F.coalesce("city", F.lit(elsewhere)))

