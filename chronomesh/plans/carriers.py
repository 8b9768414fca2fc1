"""The driver's tables as signals, events, annotations, memberships and points, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def signal(spark: SparkSession, sf_dir: str, channel: int | None = None) -> DataFrame:
    """(channel, i, x, state, us): every user's events in order of time, or one user's, for which the filter reaches the scan."""
    e = table(spark, sf_dir, "events")
    if channel is not None:
        e = e.where(F.col("user_id") == channel)
    i = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    return e.select(F.col("user_id").alias("channel"), i.cast("long").alias("i"), F.col("value").alias("x"), F.col("event_type").alias("state"), us.alias("us"), "event_id")


SIGNAL = """signal AS (
  SELECT user_id AS channel, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, value AS x, event_type AS state, epoch_us(ts) AS us, event_id
  FROM events
)"""


def long_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(channel, i, x): every supplier's quantities in order of their lines."""
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"]
    lines = table(spark, sf_dir, "lineitem")
    i = F.row_number().over(Window.partitionBy("l_suppkey").orderBy(*order)) - 1
    return lines.select(F.col("l_suppkey").alias("channel"), i.cast("long").alias("i"), F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("price"))


LONG_SIGNAL = """long_signal AS (
  SELECT l_suppkey AS channel, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) - 1 AS i,
         l_quantity AS x, l_extendedprice AS price
  FROM lineitem
)"""


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(mode, scale, roi, channel, dist): lines as members of modes (suppliers modulo 20), with a region of interest."""
    lines = table(spark, sf_dir, "lineitem")
    return lines.select(
        (F.col("l_suppkey") % 20).alias("mode"),
        F.col("l_linenumber").cast("long").alias("scale"),
        F.concat_ws("", "l_returnflag", "l_linestatus").alias("roi"),
        (F.col("l_partkey") % 50).alias("channel"),
        F.col("l_extendedprice").alias("dist"),
        "l_orderkey",
    )


MEMBERS = """members AS (
  SELECT l_suppkey % 20 AS mode, CAST(l_linenumber AS BIGINT) AS scale, l_returnflag || l_linestatus AS roi, l_partkey % 50 AS channel, l_extendedprice AS dist, l_orderkey
  FROM lineitem
)"""


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, v, label): embeddings as points."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"), "label")


def spectrum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, ev): squared components of each embedding in descending order, times 16, as a spectrum."""
    p = points(spark, sf_dir)
    return p.select("id", F.sort_array(F.transform("v", lambda x: x * x * 16), asc=False).alias("ev"))


SPECTRUM = """spectrum AS (
  SELECT vec_id AS id, list_reverse_sort(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE) * 16)) AS ev FROM embeddings
)"""
