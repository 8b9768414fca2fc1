"""Reading and writing of signals, logs and registries."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_log(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A CSV log with a header. Bad cells become null, the raw line of a bad row is kept in _corrupt_record; a byte-order mark is dropped from the first name.

    Without a schema, names come from the header and types from the rows, which are then read twice.
    """
    if schema is None:
        rows = spark.read.csv(path, header=True, inferSchema=True)
        return rows.toDF(*[c.lstrip("﻿") for c in rows.columns])
    rows = spark.read.csv(path, header=True, schema=f"{schema}, _corrupt_record string", mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt_record", enforceSchema=True)
    return rows.toDF(*[c.lstrip("﻿") for c in rows.columns])


def registered(rows: DataFrame, registry: list[tuple], key: str, schema: str) -> DataFrame:
    """rows with the columns of a registry written out in the program; its first column is the key. Rows without an entry get nulls."""
    entries = rows.sparkSession.createDataFrame(registry, schema)
    code = entries.columns[0]
    if len({entry[0] for entry in registry}) < len(registry):
        raise ValueError("an entry of the registry is given twice")
    return rows.join(entries, F.col(key) == F.col(code), "left").drop(code)


def in_batches(df: DataFrame, value: str, rows: int) -> DataFrame:
    """(n, low, high, whole) of one column for every `rows` rows or fewer that a task reads; no other column is read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.column(0).slice(at, rows)
                ends = pc.min_max(part).as_py()
                yield pa.RecordBatch.from_pydict({"n": [len(part)], "low": [ends["min"]], "high": [ends["max"]], "whole": [pc.sum(part).as_py()]})

    return df.select(F.col(value).cast("double").alias("x")).mapInArrow(run, "n long, low double, high double, whole double")


def found(spark: SparkSession, root: str, glob: str) -> DataFrame:
    """(path, size, modified) of the files below root."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    return files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def parameters(name, patterns: dict[str, str]) -> list:
    """Columns of the parameters in a file name; null where it has none."""
    return [F.nullif(F.regexp_extract(name, p, 1), F.lit("")).alias(key) for key, p in patterns.items()]


def quantised(df: DataFrame, bounds: DataFrame, kind: str, value: str) -> DataFrame:
    """df with the value rounded to a grid of twice its kind's error bound: never off by more than the bound. bounds: (kind, eps), a row per sensor type."""
    step = 2 * F.col("eps")
    return df.join(bounds, kind).withColumn(value, F.bround(F.col(value) / step) * step).drop("eps")


def write_signal(df: DataFrame, path: str, channel: str, index: str, rows_per_file: int = 5_000_000) -> None:
    """The canonical table: partitioned by channel and sorted by index, so that a channel or a stretch of it is pruned to its files."""
    # a number of partitions keeps Spark from merging small ones into a task or two: time goes into files, not bytes
    tasks = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.sparkSession.sparkContext.defaultParallelism)
    df.repartition(tasks, channel).sortWithinPartitions(channel, index).write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).option("compression", "zstd").partitionBy(channel).parquet(path)


def write_report(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def drawn(seed: int, place: int) -> Column:
    """A number between 0 and 1 for each id, the same in every run and partitioning."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:{place}:"), F.col("id").cast("string"))), 1, 8)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / 2**32


def drawn_normal(seed: int, place: int) -> Column:
    return F.sqrt(-2 * F.log(drawn(seed, place))) * F.cos(2 * F.pi() * drawn(seed, place + 1))


def manifold_on(ids: DataFrame, kind: str, seed: int = 42, noise: float = 0.0) -> DataFrame:
    """(id, features): a point of a known surface or curve for each id."""
    u, v = drawn(seed, 0), drawn(seed, 1)
    if kind == "sphere":
        rows = ids.select("id", *[drawn_normal(seed, 2 + 2 * k).alias(f"g{k}") for k in range(3)])
        norm = F.sqrt(sum((F.col(f"g{k}") * F.col(f"g{k}") for k in range(3)), F.lit(0.0)))
        rows = rows.select("id", F.array(*[F.col(f"g{k}") / norm for k in range(3)]).alias("features"))
    else:
        rows = ids.select("id", (2 * F.pi() * u).alias("a"), (2 * F.pi() * v).alias("b"), v.alias("h"), u.alias("u"))
        a, b, h = F.col("a"), F.col("b"), F.col("h")
        roll, bend = 1.5 * F.pi() * (1 + 2 * F.col("u")), 3 * F.pi() * (F.col("u") - 0.5)
        shapes = {
            "torus": [(1 + 0.3 * F.cos(b)) * F.cos(a), (1 + 0.3 * F.cos(b)) * F.sin(a), 0.3 * F.sin(b)],
            "swiss_roll": [roll * F.cos(roll), 21 * h, roll * F.sin(roll)],
            "s_curve": [F.sin(bend), 2 * h, F.sign(bend) * (F.cos(bend) - 1)],
            "circle": [F.cos(a), F.sin(a)],
            "figure_eight": [F.sin(a), F.sin(a) * F.cos(a)],
        }
        rows = rows.select("id", F.array(*shapes[kind]).alias("features"))
    if noise:
        size = 2 if kind in ("circle", "figure_eight") else 3
        errors = F.array(*[noise * drawn_normal(seed, 10 + 2 * k) for k in range(size)])
        rows = rows.withColumn("_e", errors).select("id", F.zip_with("features", "_e", lambda x, e: x + e).alias("features"))
    return rows


def manifold(spark: SparkSession, kind: str, n: int, seed: int = 42, noise: float = 0.0) -> DataFrame:
    """(id, features): n points of it."""
    return manifold_on(spark.range(n), kind, seed, noise)
