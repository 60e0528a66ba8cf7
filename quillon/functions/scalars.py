"""Scalar functions as column expressions: times, dates, rounding, text keys, speeds and colours."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(x: Column) -> Column:
    """Round half up to a whole number: floor(x + 0.5), also for negatives."""
    return F.floor(x + F.lit(0.5)).cast("long")


def parse_time(text: Column) -> Column:
    """Seconds after service midnight of H:MM:SS, HH:MM:SS or HHH:MM:SS (hours may pass 24); NULL if malformed."""
    pattern = r"^\s*(\d{1,3}):([0-5]\d):([0-5]\d)\s*$"
    part = lambda i: F.regexp_extract(text, pattern, i).cast("long")
    return F.when(text.rlike(pattern), part(1) * 3600 + part(2) * 60 + part(3))


def format_time(seconds: Column) -> Column:
    """HH:MM:SS, hours not folded at 24."""
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    hours = F.floor(seconds / 3600).cast("long")
    return F.concat_ws(":", F.when(hours > 99, hours.cast("string")).otherwise(two(hours)), two(F.floor(seconds % 3600 / 60).cast("long")), two((seconds % 60).cast("long")))


def parse_date(text: Column) -> Column:
    """A date from yyyymmdd; NULL if there is no such day."""
    return F.when(text.rlike(r"^\d{8}$"), F.try_to_timestamp(text, F.lit("yyyyMMdd")).cast("date"))


def canonical(text: Column) -> Column:
    """A comparison key of a name: lower case, brackets and their contents gone, other signs to single blanks."""
    plain = F.regexp_replace(F.lower(text), r"\([^)]*\)|\[[^\]]*\]", " ")
    return F.trim(F.regexp_replace(plain, r"[^a-z0-9]+", " "))


def natural_key(text: Column) -> Column:
    """Sort key of labels with numbers: the first number (missing: largest), then the text."""
    digits = F.regexp_extract(text, r"(\d+)", 1)
    return F.struct(F.when(digits == "", F.lit(2**31 - 1)).otherwise(digits.cast("long")).alias("n"), F.lower(text).alias("t"))


def parse_speeds(text: Column) -> Column:
    """Distinct speeds in km/h of a ;-separated list, mph converted; NULL if any item isn't a plain speed under 1000."""
    items = F.transform(F.split(text, ";"), lambda x: F.trim(x))
    pattern = r"^(\d{1,3})( ?mph)?$"
    ok = F.forall(items, lambda x: x.rlike(pattern))
    number = lambda x: F.regexp_extract(x, pattern, 1).cast("double")
    value = lambda x: F.floor(number(x) * F.when(F.endswith(x, F.lit("mph")), F.lit(1.609344)).otherwise(F.lit(1.0)) + 0.5).cast("int")
    return F.when(ok, F.array_sort(F.array_distinct(F.transform(items, value))))


#: Lower bounds of the design grades, in km/h, fastest first.
GRADES = ((351, 7), (350, 6), (300, 5), (250, 4), (200, 3), (160, 2))


def grade(speed: Column) -> Column:
    """Grade of a design speed: 7 above 350, then 350, 300, 250, 200, 160, and 1 below."""
    out = F.when(speed.isNull(), F.lit(None).cast("int"))
    for low, g in GRADES:
        out = out.when(speed >= low, g)
    return out.otherwise(1)


def colour(text: Column) -> Column:
    """#rrggbb in lower case from #rgb or #rrggbb (sign optional); NULL otherwise."""
    raw = F.lower(F.regexp_replace(F.trim(text), "^#", ""))
    short = F.regexp_replace(raw, "^(.)(.)(.)$", "$1$1$2$2$3$3")
    return F.when(raw.rlike("^[0-9a-f]{6}$"), F.concat(F.lit("#"), raw)).when(raw.rlike("^[0-9a-f]{3}$"), F.concat(F.lit("#"), short))


def lightness(colour_: Column) -> Column:
    """HLS lightness (0 to 1) of #rrggbb."""
    part = lambda i: F.conv(F.substring(colour_, i, 2), 16, 10).cast("double")
    return (F.greatest(part(2), part(4), part(6)) + F.least(part(2), part(4), part(6))) / 510.0


def first_rule(value: Column, rules: list[tuple[str, str]], default: str) -> Column:
    """The label of the first pattern (in order) that the value matches."""
    out = F.when(F.lit(False), default)
    for pattern, label in rules:
        out = out.when(value.rlike(pattern), label)
    return out.otherwise(default)


def keep_tags(tags: Column, keys: list[str]) -> Column:
    """A tag map with the listed keys that have a value."""
    return F.map_filter(tags, lambda k, v: k.isin(*keys) & v.isNotNull())


def drop_repeats(items: Column) -> Column:
    """An array without elements equal to the one before."""
    return F.filter(items, lambda x, i: (i == 0) | (x != F.get(items, i - 1)))
