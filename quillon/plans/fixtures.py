"""Rail-shaped views over the TPC-H-like tables: stops, trips, stop times, legs and tracks; and the same as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


class Tables:
    """The tables of a folder, and views derived from them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def stop(self) -> DataFrame:
        return self.supplier.select(
            F.col("s_suppkey").alias("stop_id"), F.col("s_name").alias("stop_name"), F.col("s_nationkey").alias("nation_key"),
            (F.lit(100.0) + F.col("s_suppkey") % 97 * F.lit(0.05)).alias("lon"), (F.lit(20.0) + F.col("s_suppkey") % 53 * F.lit(0.05)).alias("lat"),
        )

    def trip(self) -> DataFrame:
        letter = F.substring("o_orderpriority", 1, 1)
        kind = F.when(letter == "1", "G").when(letter == "2", "D").when(letter == "3", "C").otherwise("other")
        return self.orders.select(F.col("o_orderkey").alias("trip_id"), (F.col("o_custkey") % 8).alias("service_id"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("o_orderkey") % 28).cast("int")).alias("service_date"), kind.alias("train_type"), F.col("o_custkey").alias("line_id"))

    def trip_stop(self) -> DataFrame:
        order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_suppkey", "l_partkey", "l_shipdate", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus")
        rows = self.lineitem.withColumn("seq", F.row_number().over(order).cast("long"))
        arr = (F.col("seq") - 1) * 1800 + F.col("l_partkey") % 2400
        return rows.select(F.col("l_orderkey").alias("trip_id"), "seq", F.col("l_suppkey").alias("stop_id"), arr.alias("arr_s"), (arr + F.floor("l_quantity").cast("long") * 10 - 60).alias("dep_s"))

    def track(self) -> DataFrame:
        order = Window.partitionBy("trip_id").orderBy("seq")
        pairs = self.trip_stop().select("stop_id", F.lag("stop_id").over(order).alias("prev")).where("prev IS NOT NULL AND prev <> stop_id")
        return pairs.select(F.least("stop_id", "prev").alias("u"), F.greatest("stop_id", "prev").alias("v")).distinct()

    def points(self) -> DataFrame:
        """A point for each customer, spread over the stops' area by a multiplicative hash."""
        h = F.col("c_custkey") * 7919
        return self.customer.select(F.col("c_custkey").alias("point_id"), (F.lit(100.0) + h % 9973 * F.lit(0.0005)).alias("lon"), (F.lit(20.0) + h % 9967 * F.lit(0.00025)).alias("lat"))


#: The same views for the oracle; a query's SQL follows these after a comma or the final SELECT.
VIEWS = """
stop AS (
    SELECT s_suppkey AS stop_id, s_name AS stop_name, s_nationkey AS nation_key,
           100e0 + (s_suppkey % 97) * 5e-2 AS lon, 20e0 + (s_suppkey % 53) * 5e-2 AS lat
    FROM supplier
),
trip AS (
    SELECT o_orderkey AS trip_id, o_custkey % 8 AS service_id, DATE '2024-01-01' + CAST(o_orderkey % 28 AS INTEGER) AS service_date, o_custkey AS line_id,
           CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'G' WHEN '2' THEN 'D' WHEN '3' THEN 'C' ELSE 'other' END AS train_type
    FROM orders
),
trip_stop AS (
    SELECT trip_id, seq, stop_id, (seq - 1) * 1800 + jit AS arr_s, (seq - 1) * 1800 + jit + q * 10 - 60 AS dep_s
    FROM (SELECT l_orderkey AS trip_id, l_suppkey AS stop_id, l_partkey % 2400 AS jit, CAST(floor(l_quantity) AS BIGINT) AS q,
                 row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_partkey, l_shipdate,
                                    l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus) AS seq
          FROM lineitem) r
),
settled AS (
    SELECT trip_id, seq, stop_id,
           CASE WHEN seq = min(seq) OVER t THEN dep_s ELSE arr_s END AS arr_s,
           CASE WHEN seq = max(seq) OVER t THEN arr_s ELSE dep_s END AS dep_s
    FROM trip_stop WINDOW t AS (PARTITION BY trip_id)
),
runs AS (
    SELECT trip_id, service_date, train_type, line_id, d * 86400 + first_s AS start_at, d * 86400 + last_s AS end_at
    FROM (SELECT *, date_diff('day', DATE '1970-01-01', service_date) AS d FROM trip)
    JOIN (SELECT trip_id, arg_min(dep_s, seq) AS first_s, arg_max(arr_s, seq) AS last_s FROM trip_stop GROUP BY trip_id) USING (trip_id)
),
track AS (
    SELECT DISTINCT least(stop_id, p) AS u, greatest(stop_id, p) AS v
    FROM (SELECT stop_id, lag(stop_id) OVER (PARTITION BY trip_id ORDER BY seq) AS p FROM trip_stop)
    WHERE p IS NOT NULL AND p <> stop_id
),
points AS (
    SELECT c_custkey AS point_id, 100e0 + ((c_custkey * 7919) % 9973) * 5e-4 AS lon, 20e0 + ((c_custkey * 7919) % 9967) * 25e-5 AS lat FROM customer
)
"""


def metres_sql(a: str, b: str) -> str:
    """Great-circle metres between a.lon, a.lat and b.lon, b.lat."""
    return (
        f"(2e0 * 6371000e0 * asin(sqrt(pow(sin(radians({b}.lat - {a}.lat) / 2), 2)"
        f" + cos(radians({a}.lat)) * cos(radians({b}.lat)) * pow(sin(radians({b}.lon - {a}.lon) / 2), 2))))"
    )
