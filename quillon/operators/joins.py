"""Joins that Spark has no operator for, as compositions of equi-joins: distance, nearest, as-of, band and first-wins joins."""

from __future__ import annotations

import atexit
import math
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.functions.geo import EARTH_M, haversine


#: A rule table of more rows than this isn't broadcast.
RULES = 10_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, spark.checkpoint.dir; only a local master gets one of its own where that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="quillon-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


_cuts: list[tuple[SparkSession, str]] = []


def cut(df: DataFrame) -> DataFrame:
    """The rows of ``df`` as a table in the session's shared folder: lineage ends here, and so does what the plan knows of partitions.

    A checkpoint keeps the partitioning of the plan that it cuts. Over rounds of joins these nest, and planning takes twice as long with
    every round; a written table has none, and its size is known. Tables go when the driver's process ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quillon-cut-{uuid.uuid4().hex}"
    _cuts.append((spark, path))
    typed = df.withColumns({c: F.col(c).cast("string") for c, kind in df.dtypes if kind == "void"})
    typed.write.parquet(path)
    return spark.read.schema(typed.schema).parquet(path)


def _clean() -> None:
    for spark, path in _cuts:
        try:
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # noqa: BLE001  the session may be gone already
            pass
    _cuts.clear()


atexit.register(_clean)


def _cells(lat_band: Column, lat_deg: float, metres: float) -> Column:
    """How many cells a band of latitudes is cut into: each is as wide as the reach at the far edge of the neighbouring bands."""
    edge = F.greatest(F.abs((lat_band - 1) * lat_deg), F.abs((lat_band + 2) * lat_deg))
    half = math.sin(min(math.pi / 2, metres / (2 * EARTH_M)))
    sine = F.lit(half) / F.cos(F.radians(F.least(edge, F.lit(90.0))))
    width = F.when((edge >= 89.999) | (sine >= 1), F.lit(360.0)).otherwise(F.degrees(2 * F.asin(F.least(sine, F.lit(1.0)))) * 1.000001)
    return F.greatest(F.lit(1), F.floor(360.0 / width)).cast("long")


def within(left: DataFrame, right: DataFrame, metres: float, left_at: tuple[str, str] = ("lon", "lat"), right_at: tuple[str, str] = ("r_lon", "r_lat"), by: dict[str, str] | None = None) -> DataFrame:
    """Pairs at most ``metres`` apart, with their distance, anywhere on the globe.

    Bands of latitude are as high as the reach, and cut into cells as wide as it; cells go round the globe. Left rows go to the cells around
    them in their own and the two neighbouring bands, right rows to their own. Columns of both sides must differ in name; each pair
    comes once.
    """
    lat_deg = max(1e-9, math.degrees(min(math.pi, metres / EARTH_M)) * 1.000001)
    band = lambda at: F.floor(F.col(at[1]) / lat_deg).cast("long")
    place = lambda at, n: F.least(F.floor(F.pmod(F.col(at[0]) + 180.0, F.lit(360.0)) / 360.0 * n).cast("long"), n - 1)
    a = left.withColumn("c_y", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda i: band(left_at) + i)))
    a = a.withColumn("c_n", _cells(F.col("c_y"), lat_deg, metres))
    around = F.array_distinct(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda i: F.pmod(place(left_at, F.col("c_n")) + i, F.col("c_n"))))
    a = a.withColumn("c_x", F.explode(around)).drop("c_n")
    b = right.withColumn("c_y", band(right_at))
    b = b.withColumn("c_x", place(right_at, _cells(F.col("c_y"), lat_deg, metres)))
    b = b.withColumnsRenamed({"c_x": "o_x", "c_y": "o_y"})
    match = (F.col("c_x") == F.col("o_x")) & (F.col("c_y") == F.col("o_y"))
    for c, other in (by or {}).items():
        match = match & (F.col(c) == F.col(other))
    joined = a.join(b, match).drop("c_x", "c_y", "o_x", "o_y")
    distance = haversine(F.col(left_at[0]), F.col(left_at[1]), F.col(right_at[0]), F.col(right_at[1]))
    return joined.withColumn("metres", distance).where(F.col("metres") <= metres)


def first_at_place(rows: DataFrame, order: list[str], most: int, at: tuple[str, ...] = ("r_lon", "r_lat"), by: tuple[str, ...] = ()) -> DataFrame:
    """The first few rows (by ``order``) of each place, and of each value of ``by`` there: where many rows share a place, no more can be among the nearest."""
    turn = F.row_number().over(Window.partitionBy(*at, *by).orderBy(*order))
    return rows.withColumn("p_turn", turn).where(F.col("p_turn") <= most).drop("p_turn")


def within_by_places(left: DataFrame, right: DataFrame, metres: float, left_at: tuple[str, str] = ("lon", "lat"), right_at: tuple[str, str] = ("r_lon", "r_lat")) -> DataFrame:
    """The same pairs as ``within``, for tables in which many rows share a place: distances are taken between places, whose rows are joined then."""
    places = cut(within(left.select(*left_at).distinct(), right.select(*right_at).distinct(), metres, left_at, right_at))
    return left.join(places, list(left_at)).join(right, list(right_at))


def nearest(left: DataFrame, right: DataFrame, key: str, right_key: str, k: int = 1, metres: float = 50_000.0, **at) -> DataFrame:
    """The k nearest right rows of each left row, ties to the smaller key. The reach begins at a quarter of ``metres`` and doubles for those that found too few, until it goes
    half round the globe: then what there is has been found. Of right rows at one place only the first k count."""
    todo, right, found = cut(left), cut(first_at_place(right, [right_key], k, at.get("right_at", ("r_lon", "r_lat")))), None
    metres = metres / 4
    while True:
        pairs = within(todo, right, metres, **at)
        rank = Window.partitionBy(key).orderBy("metres", right_key)
        ranked = pairs.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k)
        ranked = ranked.withColumn("n_found", F.count(F.lit(1)).over(Window.partitionBy(key)))
        last = metres >= math.pi * EARTH_M
        done = cut(ranked if last else ranked.where(F.col("n_found") >= k))
        found = done if found is None else found.unionByName(done)
        if last:
            break
        todo = cut(todo.join(done.select(key).distinct(), key, "left_anti"))
        if not todo.limit(1).count():
            break
        metres = math.pi * EARTH_M if metres * 4 > 2_000_000 else metres * 2
    return found.drop("n_found")


def band(left: DataFrame, bands: DataFrame, value: str, low: str = "low", high: str = "high") -> DataFrame:
    """Rows with the band [low, high) that holds their value. Bands don't overlap; up to RULES of them are broadcast, more are met by an
    as-of join on their lower bounds, salted so that rows don't gather in one task."""
    if bands.limit(RULES + 1).count() <= RULES:
        return left.join(F.broadcast(bands), (F.col(value) >= F.col(low)) & (F.col(value) < F.col(high)))
    salts = 64
    spread = bands.withColumn("b_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    rows = left.withColumn("b_salt", F.pmod(F.xxhash64(value), F.lit(salts)).cast("int"))
    out = as_of(rows, spread, ["b_salt"], value, low, bands.columns).where(F.col(value) < F.col(f"last_{high}"))
    return out.select(*left.columns, *[F.col(f"last_{c}").alias(c) for c in bands.columns])


def as_of(left: DataFrame, right: DataFrame, by: list[str], at: str, right_at: str, take: list[str]) -> DataFrame:
    """Each left row with the columns ``take`` of the last right row of its key at or before its time (union and window: no range join)."""
    a = left.withColumns({"o_at": F.col(at), "o_side": F.lit(1), "o_take": F.lit(None).cast(right.select(F.struct(*take)).schema[0].dataType)})
    b = right.select(*by, F.col(right_at).alias("o_at"), F.lit(0).alias("o_side"), F.struct(*take).alias("o_take"))
    both = a.unionByName(b, allowMissingColumns=True)
    order = Window.partitionBy(*by).orderBy("o_at", "o_side").rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("o_take", F.last("o_take", ignorenulls=True).over(order)).where("o_side = 1")
    return seen.select(*left.columns, *[F.col("o_take").getField(c).alias(f"last_{c}") for c in take])


def first_wins(left: DataFrame, right: DataFrame, key: str, order: list[str], how: str = "left") -> DataFrame:
    """A lookup in which the first right row (by order) of each key counts."""
    rank = Window.partitionBy(key).orderBy(*order)
    return left.join(right.withColumn("f_rank", F.row_number().over(rank)).where("f_rank = 1").drop("f_rank"), key, how)


def unique_or_null(right: DataFrame, key: str, value: str) -> DataFrame:
    """key, value: the value where a key has exactly one, else NULL."""
    return right.groupBy(key).agg(F.when(F.count_distinct(value) == 1, F.max(value)).alias(value))


def same_name_pairs(points: DataFrame, low: float, high: float) -> DataFrame:
    """Pairs (a, b) of points (id, name, lon, lat) of one name whose distance lies in [low, high]; a is the smaller id.

    The name and a grid cell form the join key, so a common name is split by place.
    """
    b = points.select(F.col("id").alias("b"), F.col("name").alias("r_name"), F.col("lon").alias("r_lon"), F.col("lat").alias("r_lat"))
    pairs = within(points.withColumnRenamed("id", "a"), b, high, by={"name": "r_name"})
    return pairs.where("a < b").where(F.col("metres") >= low).select("a", "b", "name", "metres")
