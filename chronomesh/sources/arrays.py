"""Array archives (.npz) as a Spark data source, and Parquet footers as rows.

A scalar column is a one-dimensional array, an array column a matrix whose rows have one
length. Reading deals each file's rows out in slices: a task reads its slice of every array
alone (arrays that the archive compresses are unpacked up to there). Writing gives a file for each task under a temporary
name; the files of tasks that Spark accepts are renamed when the job commits, the others
deleted. Files are opened through pyarrow, so paths are those of stores that it knows.
"""

from __future__ import annotations

import math
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

#: Rows of a slice.
SLICE = 1 << 16


def store_of(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path) if ":" in path else (fs.LocalFileSystem(), path)


def archives(path: str) -> list[str]:
    """The .npz file at path, or those in that folder by name."""
    store, at = store_of(path)
    if store.get_file_info(at).type == fs.FileType.File:
        return [path]
    found = store.get_file_info(fs.FileSelector(at))
    return [f"{path.rstrip('/')}/{f.base_name}" for f in sorted(found, key=lambda f: f.base_name) if f.base_name.endswith(".npz") and not f.base_name.startswith((".", "_"))]


def header(member) -> tuple[tuple[int, ...], np.dtype]:
    version = np.lib.format.read_magic(member)
    shape, fortran, dtype = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(member)
    if fortran and len(shape) > 1 or dtype.hasobject or not shape or len(shape) > 2:
        raise ValueError("arrays must have one or two dimensions, rows first, and plain numbers")
    return shape, dtype


def arrays_in(path: str) -> dict[str, tuple[tuple[int, ...], np.dtype]]:
    store, at = store_of(path)
    with store.open_input_file(at) as f, zipfile.ZipFile(f) as z:
        out = {}
        for name in z.namelist():
            with z.open(name) as member:
                out[name.removesuffix(".npy")] = header(member)
        return out


def sliced(path: str, name: str, start: int, stop: int) -> np.ndarray:
    """Rows start to stop of an array, without the others."""
    store, at = store_of(path)
    with store.open_input_file(at) as f, zipfile.ZipFile(f) as z, z.open(f"{name}.npy") as member:
        shape, dtype = header(member)
        width = dtype.itemsize * math.prod(shape[1:])
        member.seek(start * width, 1)
        stop = min(stop, shape[0])
        return np.frombuffer(member.read((stop - start) * width), dtype).reshape(stop - start, *shape[1:])


@dataclass
class Slice(InputPartition):
    path: str
    start: int
    stop: int


class Reader(DataSourceReader):
    def __init__(self, path: str, schema: StructType, rows: int) -> None:
        self.path, self.schema, self.rows = path, schema, rows

    def partitions(self) -> list[Slice]:
        out = []
        for path in archives(self.path):
            known = arrays_in(path)
            sizes = {known[f.name][0][0] for f in self.schema.fields}  # a missing array is an error
            if len(sizes) > 1:
                raise ValueError(f"the arrays of {path} have different lengths")
            out += [Slice(path, at, at + self.rows) for at in range(0, max(sizes, default=0), self.rows)]
        return out or [Slice("", 0, 0)]

    def read(self, partition: Slice) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds = to_arrow_schema(self.schema)
        if not partition.path:
            return
        columns = [sliced(partition.path, f.name, partition.start, partition.stop) for f in self.schema.fields]
        yield pa.RecordBatch.from_arrays([pa.array(list(c) if c.ndim == 2 else c).cast(k.type) for c, k in zip(columns, kinds, strict=True)], schema=kinds)


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class Writer(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool) -> None:
        self.path, self.overwrite, self.job = path, overwrite, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        store, at = store_of(self.path)
        names = []
        store.create_dir(f"{at}/.writing-{self.job}")
        for n, batch in enumerate(b for b in iterator if b.num_rows):
            if any(c.null_count for c in batch.columns):
                raise ValueError("arrays can't hold nulls")
            name = f"part-{TaskContext.get().partitionId():05d}-{n:05d}-{uuid.uuid4().hex}.npz"
            columns = {f.name: np.array(c.to_pylist()) if pa.types.is_list(f.type) else c.to_numpy(zero_copy_only=False) for f, c in zip(batch.schema, batch.columns, strict=True)}
            with store.open_output_stream(f"{at}/.writing-{self.job}/{name}") as f:
                np.savez(f, **columns)
            names.append(name)
        return Written(names)

    def commit(self, messages: list[Written | None]) -> None:
        store, at = store_of(self.path)
        store.create_dir(at)
        old = [f.path for f in store.get_file_info(fs.FileSelector(at)) if f.type == fs.FileType.File] if self.overwrite else []
        for name in (n for m in messages if m for n in m.names):
            store.move(f"{at}/.writing-{self.job}/{name}", f"{at}/{name}")
        for path in old:
            store.delete_file(path)
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        store, at = store_of(self.path)
        if store.get_file_info(f"{at}/.writing-{self.job}").type == fs.FileType.Directory:
            store.delete_dir(f"{at}/.writing-{self.job}")


class Archives(DataSource):
    """Format `npz`; options: path, rows (of a slice)."""

    @classmethod
    def name(cls) -> str:
        return "npz"

    def schema(self) -> str:
        found = archives(self.options["path"])
        if not found:
            raise ValueError("there is no archive to take a schema from")
        kind = {"f": "double", "i": "long", "u": "long", "b": "boolean"}
        return ", ".join(f"`{name}` " + (f"array<{kind[t.kind]}>" if len(shape) == 2 else kind[t.kind]) for name, (shape, t) in arrays_in(found[0]).items())

    def reader(self, schema: StructType) -> Reader:
        return Reader(self.options["path"], schema, int(self.options.get("rows", SLICE)))

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        return Writer(self.options["path"], overwrite)


def footers(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, readable, n_rows, n_groups, columns, error): a row for each file under path, from its Parquet footer alone. Broken files are rows; those of no bytes aren't, as Spark skips them."""
    schema = "path string, length long, readable boolean, n_rows long, n_groups int, columns array<string>, error string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                try:
                    store, at = store_of(path)
                    with store.open_input_file(at) as f:
                        m = pq.read_metadata(f)
                    rows.append((path, length, True, m.num_rows, m.num_row_groups, m.schema.to_arrow_schema().names, None))
                except (OSError, ValueError, pa.ArrowException) as e:
                    rows.append((path, length, False, None, None, None, str(e)[:200]))
            kinds = [pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.int32(), pa.list_(pa.string()), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 7, kinds, strict=True)], [f.split(" ")[0] for f in schema.split(", ")])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")  # contents aren't read
    return files.repartition(F.col("path")).mapInArrow(run, schema)
