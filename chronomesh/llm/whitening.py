"""Whitening of embeddings by hierarchical merging of singular value decompositions.

Each partition of the fit list reduces its centred vectors to count, exact sums, singular
values and right singular vectors of full rank. Two such summaries merge without loss: the
scaled vectors of both are stacked with one row that corrects for the difference of the
means, sqrt(n1 n2 / (n1 + n2)) (m1 - m2), and decomposed again. Summaries merge in groups of
FAN, level by level, as Spark groups; one of fixed size (dimensions squared) is left. The
same tree merges the second moments of the whitened vectors for the reported error.

Components are c scaled to whole numbers x = floor(64 c) + 1000000. Means are exact: every
vector is centred as n x - S in whole numbers before it is divided by n, so large offsets
cost no digits.

Defined results: rows whose vector is null or holds null or non-finite entries drop out; a
null id stays. Vectors of different lengths count as if padded with zeros. 64 c is clipped
to 2^52 either way, deviations to the largest long. Components of no variance (a deviation under 1e-10
of the first one's) can't be whitened and aren't returned, so identical vectors alone, or no
vectors, give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronomesh.llm.common import materialize, read

SCALE, OFFSET, LIMIT = 64, 1_000_000, 2**52
COMPONENTS = 16
FAN = 16
#: Vectors that are decomposed at once.
ROWS = 1024
FLAT = 1e-10
LARGEST = 2**63 - 1

#: count, exact sums, matrix
Summary = tuple[int, list[int], np.ndarray]
SUMMARY = "part long, n long, sums array<string>, matrix binary"


def whole(v: Column) -> Column:
    """floor(SCALE * c) + OFFSET of every component; null unless all are finite."""
    finite = F.forall(v, lambda c: F.coalesce(~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) != float("inf")), F.lit(False)))
    one = lambda c: F.floor(F.greatest(F.least(F.lit(float(SCALE)) * c.cast("double"), F.lit(float(LIMIT))), F.lit(-float(LIMIT)))).cast("long") + F.lit(OFFSET)
    return F.when(v.isNotNull() & finite, F.transform(v, one))


def matrix_of(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), dims)


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - sums, exact: 64-bit where that suffices, else whole numbers of any size."""
    room = n * max(1, int(np.abs(x).max(initial=0))) + max(map(abs, sums), default=0) < LARGEST
    x = x if room else x.astype(object)
    return n * x - np.array(sums, np.int64 if room else object)


def decomposed(rows: np.ndarray) -> np.ndarray:
    """Singular values times right singular vectors of rows: as many rows as dimensions, at most."""
    _, s, vt = np.linalg.svd(rows, full_matrices=False)
    return s[:, None] * vt


def summary(x: np.ndarray) -> Summary:
    n, sums = len(x), [int(s) for s in x.astype(object).sum(0)] if np.abs(x).max(initial=0) > LARGEST // max(1, len(x)) else x.sum(0).tolist()
    return n, sums, decomposed(centred(x, n, sums).astype(float) / n)


def apart(a: Summary, b: Summary) -> np.ndarray:
    """The row that corrects for the difference of the means, from exact sums."""
    top = np.array([s * b[0] - t * a[0] for s, t in zip(a[1], b[1], strict=True)], object)
    return (top.astype(float) / (a[0] * b[0]) * math.sqrt(a[0] * b[0] / (a[0] + b[0])))[None, :]


def merged(a: Summary, b: Summary) -> Summary:
    """The summary of both lists of vectors together."""
    return a[0] + b[0], [s + t for s, t in zip(a[1], b[1], strict=True)], decomposed(np.concatenate([a[2], b[2], apart(a, b)]))


def row_of(part: int, s: Summary) -> pa.RecordBatch:
    kinds = pa.schema([("part", pa.int64()), ("n", pa.int64()), ("sums", pa.list_(pa.string())), ("matrix", pa.binary())])
    return pa.RecordBatch.from_pylist([{"part": part, "n": s[0], "sums": [str(v) for v in s[1]], "matrix": np.ascontiguousarray(s[2], "<f8").tobytes()}], kinds)


def summary_of(row: dict) -> Summary:
    sums = [int(v) for v in row["sums"]]
    return row["n"], sums, np.frombuffer(row["matrix"], "<f8").reshape(-1, len(sums))


def tree(parts: DataFrame, merge: Callable[[Summary, Summary], Summary], n_parts: int) -> Summary | None:
    """The summaries of parts (numbered from 0 to n_parts - 1, some may be missing) merged by groups of FAN, level by level."""

    def group(table: pa.Table) -> pa.Table:
        held = None
        for row in sorted(table.to_pylist(), key=lambda r: r["part"]):
            held = summary_of(row) if held is None else merge(held, summary_of(row))
        return pa.Table.from_batches([row_of(table.column("part")[0].as_py() // FAN, held)])

    while n_parts > 1:
        parts, n_parts = parts.groupBy(F.floor(F.col("part") / FAN).alias("_group")).applyInArrow(group, SUMMARY), -(-n_parts // FAN)
    left = parts.collect()  # one row of fixed size
    return summary_of(left[0].asDict()) if left else None


def summarised(fit: DataFrame, dims: int, of: Callable[[np.ndarray], Summary], merge: Callable[[Summary, Summary], Summary]) -> DataFrame:
    """A summary of each partition of fit (x array<long>), merged batch by batch within it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held = None
        for batch in batches:
            x = matrix_of(batch.column(0), dims)
            for at in range(0, len(x), ROWS):
                new = of(x[at : at + ROWS])
                held = new if held is None else merge(held, new)
        if held is not None:
            yield row_of(TaskContext.get().partitionId(), held)

    return fit.select("x").mapInArrow(run, SUMMARY)


def whitened(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vectors (vec_id, embedding) → vec_id, component, n, deviation, whitened, explained, identity_error: a row for each vector and leading component."""
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    spark = vectors.sparkSession
    rows = vectors.select("vec_id", whole(F.col("embedding")).alias("x")).where("x IS NOT NULL")
    dims = rows.agg(F.max(F.size("x"))).first()[0] or 0
    rows = rows.withColumn("x", F.concat("x", F.array_repeat(F.lit(OFFSET).cast("long"), F.lit(dims) - F.size("x"))))
    if not dims:
        return spark.createDataFrame([], schema)
    fit = materialize(rows.select("x").distinct(), "whitening-fit")
    n_parts = fit.rdd.getNumPartitions()
    n, sums, left = tree(summarised(fit, dims, summary, merged), merged, n_parts)
    _, s, vt = np.linalg.svd(left, full_matrices=False)
    if not s[0]:
        return spark.createDataFrame([], schema)
    kept = min(components, int((s > FLAT * s[0]).sum()))
    # the matrix that projects and scales, of fixed size: dimensions x components
    project, explained = vt[:kept].T / (s[:kept] / math.sqrt(n)), (s**2 / (s**2).sum())[:kept].tolist()

    def white(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        c = centred(x, n, sums)
        return c, (c.astype(float) / n) @ project

    def moments(x: np.ndarray) -> Summary:
        w = white(x)[1]
        mean = w.mean(0)
        return len(w), [0] * kept, np.concatenate([mean[None, :], (w - mean).T @ (w - mean)])

    def together(a: Summary, b: Summary) -> Summary:
        apart, total = b[2][0] - a[2][0], a[0] + b[0]
        mean, squares = a[2][0] + apart * (b[0] / total), a[2][1:] + b[2][1:] + np.outer(apart, apart) * (a[0] * b[0] / total)
        return total, a[1], np.concatenate([mean[None, :], squares])

    seen = tree(summarised(fit, dims, moments, together), together, n_parts)
    error = float(np.abs(seen[2][1:] / n - np.eye(kept)).max())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, ids = matrix_of(batch.column(1), dims), batch.column(0)
            for at in range(0, len(x), ROWS):
                c, w = white(x[at : at + ROWS])
                fits = c.dtype != object and float(np.abs(c).max(initial=0)) ** 2 * dims < 2.0**62
                deviation = (c * c).sum(1) if fits else np.array([min(int(v), LARGEST) for v in (c.astype(object) ** 2).sum(1)], np.int64)
                m = len(w)
                out = [
                    ids.slice(at, m).take(pa.array(np.repeat(np.arange(m), kept))),
                    pa.array(np.tile(np.arange(1, kept + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * kept, n)),
                    pa.array(np.repeat(deviation, kept)),
                    pa.array(w.ravel()),
                    pa.array(np.tile(explained, m)),
                    pa.array(np.full(m * kept, error)),
                ]
                yield pa.RecordBatch.from_arrays(out, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), "x").mapInArrow(run, schema)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(read(spark, sf_dir, "embeddings"))
