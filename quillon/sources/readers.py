"""Readers: timetable feeds in zips or folders, feature collections, tab-separated rule tables, and tagged elements."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def feed_table(spark: SparkSession, path: str, name: str, columns: list[str]) -> DataFrame:
    """A table of a zipped feed, all columns as text. Exactly one member may have that base name, in whatever folder; a BOM is fine.

    Zips are read by Spark's own reader, so any store that it knows will do; one task reads one zip.
    """

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for content in pdf["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    found = [m for m in z.namelist() if m.rsplit("/", 1)[-1] == f"{name}.txt"]
                    if len(found) != 1:
                        raise ValueError(f"{len(found)} members are called {name}.txt")
                    with z.open(found[0]) as member:
                        for chunk in pd.read_csv(io.TextIOWrapper(member, "utf-8-sig"), dtype=str, keep_default_na=False, chunksize=50_000):
                            yield chunk.reindex(columns=columns)

    zips = spark.read.format("binaryFile").load(path).select("content")
    return zips.mapInPandas(rows, ", ".join(f"`{c}` string" for c in columns))


def feed_folder(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.csv(f"{folder}/{name}.txt", header=True, inferSchema=False)


FEATURES = "struct<type:string,features:array<struct<properties:map<string,string>,geometry:struct<type:string,coordinates:string>>>>"


def features(spark: SparkSession, path: str) -> DataFrame:
    """feature, part, kind, properties, path: rows of a GeoJSON file; Multi* geometries come part by part."""
    schema = "type string, features array<struct<properties:map<string,string>,geometry:struct<type:string,coordinates:string>>>"
    rows = spark.read.schema(schema).json(path, multiLine=True).select(F.posexplode("features").alias("feature", "f"))
    kind, text = F.col("f.geometry.type"), F.col("f.geometry.coordinates")
    line = "array<array<double>>"
    parts = F.when(kind == "Point", F.array(F.array(F.from_json(text, "array<double>")))).when(kind == "LineString", F.array(F.from_json(text, line)))
    parts = parts.when(kind.isin("MultiLineString", "Polygon"), F.from_json(text, f"array<{line}>")).when(kind == "MultiPolygon", F.flatten(F.from_json(text, f"array<array<{line}>>")))
    out = rows.select("feature", kind.alias("kind"), F.col("f.properties").alias("properties"), F.posexplode(parts).alias("part", "points"))
    return out.withColumn("path", F.transform("points", lambda p: F.struct(F.get(p, F.lit(0)).alias("lon"), F.get(p, F.lit(1)).alias("lat")))).drop("points")


def rule_table(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A tab-separated table with a header that must name exactly these columns; empty cells are NULL."""
    df = spark.read.csv(path, sep="\t", header=True, nullValue="")
    if df.columns != columns:
        raise ValueError(f"{path} has columns {df.columns}, not {columns}")
    return df


def checked_bytes(spark: SparkSession, path: str, sha256: str) -> DataFrame:
    """Content of a pinned file; an error if its checksum differs."""
    rows = spark.read.format("binaryFile").load(path)
    right = F.sha2("content", 256) == sha256
    return rows.select("path", F.when(right, F.col("content")).otherwise(F.raise_error(F.lit("checksum differs")).cast("binary")).alias("content"))


def wanted_nodes(ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """Lean read: ways (way_id, tags, refs) with their coordinates, joining only the nodes that some way names."""
    refs = ways.select("way_id", F.posexplode("refs").alias("seq", "node_id"))
    needed = nodes.join(refs.select("node_id").distinct(), "node_id", "left_semi")
    placed = refs.join(needed, "node_id").groupBy("way_id").agg(F.array_sort(F.collect_list(F.struct("seq", "lon", "lat"))).alias("p"))
    return ways.join(placed, "way_id").select("way_id", "tags", F.transform("p", lambda x: F.struct(x["lon"].alias("lon"), x["lat"].alias("lat"))).alias("path"))
