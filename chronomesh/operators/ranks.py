"""Ranks over whole tables without ordering them in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronomesh.sources.shared import materialize


def ranked(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """df with name: the row's place from 1 in that order, which should have no ties.

    Rows are cut by range of the order and numbered in each part; the rows of the parts
    before, a number for each part, are added. The parts are written to the shared folder, so
    that counts and places see the same ones.
    """
    parts = materialize(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranks")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = parts.groupBy("_part").agg(F.count("*").alias("_n"))
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order)).cast("long")
    return parts.withColumn(name, place).join(F.broadcast(offsets), "_part").withColumn(name, F.col(name) + F.col("_before")).drop("_part", "_before")
