"""Versioned state of an iterative job in a folder that outlives its driver.

A version is a folder of tables under `data`. It counts from the moment its marker, an empty
file in `commits`, is created, which happens after all its tables are complete; a job that
dies before leaves files that nothing refers to. Readers take the marker with the highest
number, so they never see a version in part. Old versions lose their marker first.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from chronomesh.sources.shared import delete


class States:
    """The committed versions under a path in any store that Spark reaches."""

    def __init__(self, spark: SparkSession, path: str, keep: int = 2) -> None:
        if keep < 1:
            raise ValueError("at least one version must stay")
        self.spark, self.path, self.keep = spark, path, keep
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._files = self._path(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def versions(self) -> list[tuple[int, str]]:
        """(number, name) of the committed versions, the latest one last; of two with one number the first name alone."""
        at = self._path(f"{self.path}/commits")
        if not self._files.exists(at):
            return []
        found: dict[int, str] = {}
        for name in sorted(s.getPath().getName() for s in self._files.listStatus(at)):
            found.setdefault(int(name.split("-")[0]), name)
        return sorted(found.items())

    def commit(self, number: int, tables: dict[str, DataFrame]) -> None:
        """Write the tables of a version, then its marker, then forget versions beyond the last `keep`."""
        name = f"{number:012d}-{uuid.uuid4().hex}"
        for table, df in tables.items():
            df.write.parquet(f"{self.path}/data/{name}/{table}")
        if not self._files.createNewFile(self._path(f"{self.path}/commits/{name}")):
            raise OSError(f"version {name} can't be committed")
        for _, old in self.versions()[: -self.keep]:
            delete(self.spark, f"{self.path}/commits/{old}")
            delete(self.spark, f"{self.path}/data/{old}")

    def read(self, table: str, number: int | None = None) -> DataFrame | None:
        """A table of the latest version, or of that number; None if there is none."""
        known = dict(self.versions())
        number = max(known, default=None) if number is None else number
        return self.spark.read.parquet(f"{self.path}/data/{known[number]}/{table}") if number in known else None

    def latest(self) -> int | None:
        return max((n for n, _ in self.versions()), default=None)
