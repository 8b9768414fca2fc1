"""Tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, a temporary folder, but only if all executors run in this process."""
    if configured := spark.conf.get("spark.checkpoint.dir", None):
        return configured
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="chronomesh-"))
    return sc.getCheckpointDir()


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path in that folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df there and read it back, which ends its lineage."""
    path = shared_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of tables that are written: it does so for what the driver's JVM has found unused, which may else take until a job's end."""
    spark._jvm.System.gc()


class Scratch:
    """Tables that a job writes for itself in one new folder there and deletes, at the latest when it ends."""

    def __init__(self, spark: SparkSession, label: str) -> None:
        self.spark, self.path, self.n = spark, shared_path(spark, label), 0
        self.held: dict[str, DataFrame] = {}

    def table(self, df: DataFrame, label: str) -> DataFrame:
        """As materialize(), in this folder."""
        self.n += 1
        path = f"{self.path}/{label}-{self.n}"
        df.write.parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        self.held[path] = back
        return back

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that nothing will read any more."""
        for t in tables:
            path = next(p for p, own in self.held.items() if own is t)
            del self.held[path]
            delete(self.spark, path)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder in any store that Spark reaches."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def scratch(spark: SparkSession, label: str) -> Iterator[Scratch]:
    """A Scratch that is deleted as a whole at the end; what should outlive it must be written elsewhere."""
    held = Scratch(spark, label)
    try:
        yield held
    finally:
        delete(spark, held.path)
