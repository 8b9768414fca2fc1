"""Artefact projectors: directions of sensor space that event-locked epochs have in common.

Samples are vectors over channels. The second moments of all samples within an epoch are summed in
Spark tasks, a matrix of channels squared for each task; its leading eigenvectors, signed by
their largest entry, are projected out of every sample. The matrix is the only thing that the
driver sees.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_vectors(signal: DataFrame, channel: str, index: str, value: str) -> DataFrame:
    """(i, v): a row for each sample of a long signal, with the values of all channels by ascending channel."""
    rows = signal.groupBy(F.col(index).alias("i")).agg(F.array_sort(F.collect_list(F.struct(F.col(channel).alias("c"), F.col(value).alias("x")))).alias("v"))
    return rows.select("i", F.transform("v", lambda s: s["x"].cast("double")).alias("v"))


def in_epochs(samples: DataFrame, events: DataFrame, before: int, after: int) -> DataFrame:
    """samples (i, v) once for each event (i) with event - before <= i < event + after."""
    reach = events.where("i IS NOT NULL").select(F.explode(F.sequence(F.col("i") - before, F.col("i") + (after - 1))).alias("i"))
    return samples.join(reach, "i")


def second_moments(samples: DataFrame, dimension: int) -> tuple[np.ndarray, int]:
    """Sum of v v^T over samples (i, v), and their number. Vectors that are null, of another length or not finite don't count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((dimension, dimension)), 0
        for batch in batches:
            x = np.array(batch.column(0).to_pylist(), float).reshape(batch.num_rows, dimension)
            total, n = total + x.T @ x, n + len(x)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(dimension), pa.int32()), pa.array(list(total)), pa.array(np.full(dimension, n))], ["row", "x", "n"])

    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    ready = samples.where(F.col("v").isNotNull() & (F.size("v") == dimension)).where(finite).select(F.col("v").cast("array<double>"))
    parts = ready.mapInArrow(run, "row int, x array<double>, n long").select("row", "n", F.posexplode("x").alias("column", "x"))
    rows = parts.groupBy("row", "column").agg(F.sum("x").alias("x"), F.sum("n").alias("n")).collect()  # dimension squared
    out = np.zeros((dimension, dimension))
    for r in rows:
        out[r.row, r.column] = r.x
    return (out + out.T) / 2, rows[0].n if rows else 0


def projectors(moments: np.ndarray, n: int) -> np.ndarray:
    """The n leading eigenvectors of moments as rows, each with its largest entry positive; fewer where eigenvalues vanish."""
    values, vectors = np.linalg.eigh(moments)
    order = np.argsort(-values)[:n]
    kept = order[values[order] > 1e-12 * max(values.max(initial=0), 1e-300)]
    rows = vectors[:, kept].T
    largest = np.abs(rows).argmax(1) if len(rows) else np.zeros(0, int)
    return rows * np.sign(rows[np.arange(len(rows)), largest])[:, None]


def projected(samples: DataFrame, rows: np.ndarray) -> DataFrame:
    """samples with v replaced by its part orthogonal to rows (orthonormal, a fixed number); vectors of another length stay as they are."""

    def without(v: Column, row: list[float]) -> Column:
        fixed = F.array(*map(F.lit, row))
        along = F.aggregate(F.zip_with(v, fixed, lambda x, u: x * u), F.lit(0.0), lambda s, x: s + x)
        # the product is taken once for each sample
        return F.element_at(F.transform(F.array(along), lambda p: F.zip_with(v, fixed, lambda x, u: x - p * u)), 1)

    out = F.col("v").cast("array<double>")
    for row in rows.tolist():
        out = without(out, row)
    return samples.withColumn("v", F.when(F.size("v") == rows.shape[1], out).otherwise(F.col("v").cast("array<double>")))


def without_artefact(samples: DataFrame, events: DataFrame, dimension: int, before: int, after: int, n: int = 1) -> tuple[DataFrame, np.ndarray]:
    """samples (i, v) with the n directions that carry most energy in epochs around events (i) projected out, and these directions.

    Tolerant of failure: without events, or without a sample in any epoch, there are no directions and samples stay as they are.
    """
    moments, count = second_moments(in_epochs(samples, events, before, after), dimension)
    rows = projectors(moments, n) if count else np.zeros((0, dimension))
    return projected(samples, rows), rows
