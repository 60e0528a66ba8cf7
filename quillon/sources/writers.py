"""Writers: feature lines, shards of bounded size and integer-coded graphs, each by way of Spark's committers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.operators.aggregates import sharded


def write_features(rows: DataFrame, path: str) -> None:
    """One GeoJSON feature a line from properties (map) and path (array of structs lon, lat)."""
    points = F.transform("path", lambda p: F.array(p["lon"], p["lat"]))
    geometry = F.struct(F.lit("LineString").alias("type"), points.alias("coordinates"))
    feature = F.struct(F.lit("Feature").alias("type"), F.col("properties"), geometry.alias("geometry"))
    rows.select(F.to_json(feature).alias("value")).write.mode("overwrite").text(path)


def write_shards(items: DataFrame, by: str, key: str, size: str, limit: int, path: str) -> None:
    """Items in shards of at most ``limit`` (unless a single item is larger), as partitions that a reader prunes."""
    placed = items.join(sharded(items, by, key, size, limit).select(by, key, "shard"), [by, key])
    placed.repartition(by, "shard").sortWithinPartitions(key).write.mode("overwrite").partitionBy(by, "shard").parquet(path)


def coded_paths(points: DataFrame) -> DataFrame:
    """line, codes: coordinates in steps of 1e-5 degree (half up), each but the first as its difference from the one before."""
    w = Window.partitionBy("line").orderBy("seq")
    step = lambda c: F.floor(F.col(c) * 1e5 + 0.5).cast("long")
    rows = points.withColumns({"x": step("lon"), "y": step("lat")})
    rows = rows.withColumns({"dx": F.col("x") - F.coalesce(F.lag("x").over(w), F.lit(0)), "dy": F.col("y") - F.coalesce(F.lag("y").over(w), F.lit(0))})
    codes = F.array_sort(F.collect_list(F.struct("seq", "dx", "dy")))
    return rows.groupBy("line").agg(F.flatten(F.transform(codes, lambda c: F.array(c["dx"], c["dy"]))).alias("codes"))


def refresh_section(df: DataFrame, path: str, by: str = "section") -> None:
    """Write the sections that ``df`` has and leave the others of the table as they are."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def columnar(df: DataFrame, order: list[str], always: list[str], optional: list[str]) -> DataFrame:
    """One row with an array for each column, all in the same order; optional columns only if some row has a value there.

    It is a small file that a page reads whole, so all its rows are gathered in one.
    """
    row = F.struct(*order, *[F.col(c).alias(f"c_{c}") for c in always + optional])
    one = df.agg(F.array_sort(F.collect_list(row)).alias("rows"))
    counts = df.agg(*[F.count(c).alias(c) for c in optional]).first() if optional else {}
    kept = always + [c for c in optional if counts[c]]
    return one.select(*[F.col("rows").getField(f"c_{c}").alias(c) for c in kept])
