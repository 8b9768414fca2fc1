"""Directions of the metric: which components carry a point's tangent space.

The metric at a point is F^T F with F the real feature matrix of the spectral kernel, so its
eigenvectors are F's right singular vectors. Vectors of equal eigenvalues may be turned among
themselves and all may change sign, so results are built from the projectors of whole groups
of equal eigenvalues, which are unique: the leverage of a component is its diagonal entry,
and of a group that is kept in part each direction counts by the same share. A basis is
taken from a group's projector by pivoting on its largest diagonal entry (the first of
equal ones), which makes it unique too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronomesh.operators.spectral import GAP_FLOOR, eigen, expectations, half_squares, hermitian
from chronomesh.operators.training import safe_batch

#: Eigenvalues are equal, or zero, within this share of the largest.
EQUAL = 1e-9
#: Diagonal entries of a projector are equal within this.
PIVOT = 1e-9


def groups(values: np.ndarray) -> list[tuple[int, int]]:
    """[from, to) of equal eigenvalues above zero in descending values."""
    tolerance = EQUAL * max(values[0] if len(values) else 0.0, 1e-300)
    rank = int((values > tolerance).sum())
    cuts = [0, *(np.flatnonzero(values[: rank - 1] - values[1:rank] > tolerance) + 1).tolist(), rank] if rank else [0]
    return list(zip(cuts[:-1], cuts[1:], strict=True))


def leverage(values: np.ndarray, vectors: np.ndarray, k: int) -> np.ndarray:
    """Diagonal of the projector on the first k directions (rows of vectors, by descending values); its sum is k or the rank if that is less."""
    out = np.zeros(vectors.shape[1])
    for a, b in groups(values):
        share = min(1.0, max(0, k - a) / (b - a))
        out += share * (vectors[a:b] ** 2).sum(0)
    return out


def basis(values: np.ndarray, vectors: np.ndarray, k: int) -> np.ndarray:
    """The first k directions (fewer if the rank is less), unique whatever the solver's signs and turns."""
    out = []
    for a, b in groups(values):
        left = vectors[a:b].T @ vectors[a:b]
        for _ in range(b - a):
            diagonal = np.diag(left)
            at = int(np.argmax(diagonal >= diagonal.max() - PIVOT))
            row = left[at] / np.sqrt(left[at, at])
            out.append(row)
            left = left - np.outer(row, row)
    return np.array(out[:k]).reshape(-1, vectors.shape[1])


def features_at(x: np.ndarray, a: np.ndarray, gap_floor: float = GAP_FLOOR, degenerate: float = 1e-6) -> tuple[np.ndarray, np.ndarray]:
    """The feature matrices at the projections of points x, and whether the ground state is apart from the next one by more than `degenerate`."""
    k = half_squares(a)
    y = expectations(eigen(x, a, k)[1][:, :, 0], a)
    energy, states = eigen(y, a, k)
    gaps = energy[:, 1:] - energy[:, :1]
    moved = np.einsum("bn,dnm,bmk->bkd", states[:, :, 0].conj(), a, states[:, :, 1:], optimize=True) * np.sqrt(2 / np.maximum(gaps, gap_floor))[:, :, None]
    return np.concatenate([moved.real, moved.imag], axis=1), gaps[:, 0] > degenerate


def modes(points: DataFrame, operators: np.ndarray, k: int) -> DataFrame:
    """points (id, features) → id, eigenvalues, rank, leverage of each component over the first k directions, tangents (these directions), regular.

    Points whose features are null, not finite or of another length are left out.
    """
    shared, d = points.sparkSession.sparkContext.broadcast(hermitian(operators)), operators.shape[0]
    schema = "id long, eigenvalues array<double>, rank int, leverage array<double>, tangents array<array<double>>, regular boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = shared.value
        at_once = safe_batch(d, a.shape[1])
        for whole in batches:
            for at in range(0, whole.num_rows, at_once):
                part = whole.slice(at, at_once)
                x = np.array(part.column(1).to_pylist(), float).reshape(part.num_rows, d)
                features, regular = features_at(x, a)
                _, s, vt = np.linalg.svd(features, full_matrices=False)
                values, rows = s**2, range(len(x))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array(list(values)),
                        pa.array([sum(b - a for a, b in groups(values[j])) for j in rows], pa.int32()),
                        pa.array([leverage(values[j], vt[j], k) for j in rows]),
                        pa.array([basis(values[j], vt[j], k).tolist() for j in rows], pa.list_(pa.list_(pa.float64()))),
                        pa.array(regular),
                    ],
                    ["id", "eigenvalues", "rank", "leverage", "tangents", "regular"],
                )

    finite = F.forall("features", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    ready = points.where(F.col("features").isNotNull() & (F.size("features") == d)).where(finite)
    return ready.select(F.col("id").cast("long").alias("id"), F.col("features").cast("array<double>").alias("features")).mapInArrow(run, schema)


def channel_leverage(found: DataFrame) -> DataFrame:
    """(component, leverage, share) of modes(): mean over the points, and its share of the sum."""
    each = found.select(F.posexplode("leverage").alias("component", "x")).groupBy("component").agg(F.avg("x").alias("leverage"))
    total = each.agg(F.sum("leverage").alias("_total"))
    return each.crossJoin(F.broadcast(total)).select("component", "leverage", F.when(F.col("_total") > 0, F.col("leverage") / F.col("_total")).otherwise(F.col("leverage")).alias("share"))
