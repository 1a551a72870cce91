"""Shared inputs of the registered queries: the driver's tables read as places, points, feeds and layers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.operators.scratch import shared  # noqa: F401


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def lat_of(k: str) -> str:
    """An even latitude for a key, as SQL of either engine."""
    return f"round(degrees(asin((({k}) * 0.61803398875 % 1 * 2 - 1) * 0.99939082701)), 5)"


def lon_of(k: str) -> str:
    return f"round((({k}) * 137.50776405 + 180) % 360 - 180, 5)"


def tracts(spark: SparkSession, d: str) -> DataFrame:
    """Customers as census tracts: an 11-digit geoid (state, county, tract), a point, people and measures."""
    c, n = t(spark, d, "customer"), t(spark, d, "nation")
    j = c.join(n, c.c_nationkey == n.n_nationkey)
    return j.select(
        F.format_string("%02d%03d%06d", "n_regionkey", "n_nationkey", "c_custkey").alias("geoid"),
        F.format_string("%02d", "n_regionkey").alias("state"),
        F.format_string("%02d%03d", "n_regionkey", "n_nationkey").alias("county"),
        F.col("c_name").alias("name"),
        F.col("n_name").alias("place"),
        F.expr(lon_of("c_custkey")).alias("lon"),
        F.expr(lat_of("c_custkey")).alias("lat"),
        (F.col("c_custkey") % 700 + 20).cast("long").alias("pop"),
        (F.col("c_custkey") * 7 % 300).cast("long").alias("minority"),
        (F.col("c_custkey") * 11 % 400 + 1).cast("long").alias("white"),
        F.when(F.col("c_custkey") % 10 != 0, F.col("c_acctbal")).alias("income"),
        F.col("c_mktsegment").alias("segment"),
        F.col("c_custkey").alias("k"),
    )


TRACTS = f"""tracts AS (
  SELECT printf('%02d%03d%06d', n_regionkey, n_nationkey, c_custkey) AS geoid, printf('%02d', n_regionkey) AS state,
    printf('%02d%03d', n_regionkey, n_nationkey) AS county, c_name AS name, n_name AS place, {lon_of("c_custkey")} AS lon, {lat_of("c_custkey")} AS lat,
    CAST(c_custkey % 700 + 20 AS BIGINT) AS pop, CAST(c_custkey * 7 % 300 AS BIGINT) AS minority, CAST(c_custkey * 11 % 400 + 1 AS BIGINT) AS white,
    CASE WHEN c_custkey % 10 <> 0 THEN c_acctbal END AS income, c_mktsegment AS segment, c_custkey AS k
  FROM customer JOIN nation ON c_nationkey = n_nationkey)"""


def feed(spark: SparkSession, d: str) -> DataFrame:
    """Events as position reports: a vehicle, its place, its speed and a time in epoch milliseconds."""
    e = t(spark, d, "events")
    return e.select(
        F.col("event_id").alias("seq"),
        F.col("user_id").alias("vehicle"),
        F.expr("unix_millis(cast(ts as timestamp))").alias("ms"),
        F.expr(lon_of("event_id")).alias("lon"),
        F.expr(lat_of("event_id")).alias("lat"),
        F.col("value").alias("speed"),
        F.col("event_type").alias("kind"),
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )


FEED = f"""feed AS (
  SELECT event_id AS seq, user_id AS vehicle, CAST(epoch_us(ts) // 1000 AS BIGINT) AS ms, {lon_of("event_id")} AS lon, {lat_of("event_id")} AS lat,
    value AS speed, event_type AS kind, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k
  FROM events)"""
