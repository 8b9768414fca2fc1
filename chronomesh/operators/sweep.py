"""Set partitions for many numbers of cells at once.

Each step is one pass over the objects for all numbers of cells that haven't settled. An
object keeps, for each, its cell, its distance and a lower bound of the distance to any other
centre. A step lowers the bound by the largest way that another centre has moved; only where
it isn't above the distance to the own centre are all distances computed again (the
triangle inequality). Centres, their sums and ways have sizes fixed by the numbers of
cells; sums leave a task as one row for each cell.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronomesh.operators.partition import MAX_STEPS, TOLERANCE, energy
from chronomesh.operators.ranges import at_places
from chronomesh.sources.shared import Scratch, materialize, scratch

#: Objects whose distances are held at once.
ROWS = 512
#: Bounds give way by this share, more than rounding can cost.
SLACK = 1e-9
#: Centres from which products tell which of them are worth an exact distance, and how far such a distance may be off, relative to the largest squares.
MANY, NEAR = 16, 1e-10
STATE = "id long, v array<double>, cells array<int>, dist array<double>, low array<double>, k int, cell int, sum array<double>, n long, j double, again long"


@dataclass
class Swept:
    summary: DataFrame
    history: DataFrame
    memberships: DataFrame
    trajectories: DataFrame


def places_of(m: int, k: int) -> list[int]:
    """Evenly spaced places among m, cut to whole numbers; a place may stand for several cells where k > m."""
    return [int(j * (m - 1) / (k - 1)) if k > 1 else 0 for j in range(k)]


def started(objects: DataFrame, ks: list[int]) -> dict[int, np.ndarray]:
    """The initial centres for each k: objects at evenly spaced places of the order by energy."""
    m = objects.count()
    wanted = sorted({p for k in ks for p in places_of(m, k)})
    rows = at_places(objects.withColumn("_e", energy(F.col("v"))), [F.col("_e"), F.col("id")], wanted, "_place").select("_place", "v").collect()
    of = {r["_place"]: r["v"] for r in rows}  # as many as cells, a parameter
    return {k: np.array([of[p] for p in sorted(set(places_of(m, k)))], float) for k in ks}


def squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of x to all centres, each summed from differences."""
    out = np.empty((len(x), len(c)))
    for j, centre in enumerate(c):
        out[:, j] = ((x - centre) ** 2).sum(1)
    return out


def compared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """squares(x, c), with infinity for centres that can't be among a row's two nearest.

    Products of matrices tell these apart, with room for their rounding; what is left gets the exact distance.
    """
    if len(c) < MANY:
        return squares(x, c)
    xx, cc = (x**2).sum(1), (c**2).sum(1)
    rough = xx[:, None] - 2 * (x @ c.T) + cc
    limit = np.partition(rough, 1, axis=1)[:, 1] + 2 * NEAR * (xx + cc.max())
    if not (np.isfinite(limit).all() and np.isfinite(cc).all()):
        return squares(x, c)
    row, column = np.nonzero(rough <= limit[:, None])
    out = np.full(rough.shape, np.inf)
    out[row, column] = ((x[row] - c[column]) ** 2).sum(1)
    return out


def lists(rows: np.ndarray, kind: pa.DataType) -> pa.Array:
    """Rows of a matrix as arrays."""
    offsets = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1])
    return pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(rows).ravel())).cast(kind)


def matrix(column: pa.Array, rows: int) -> np.ndarray:
    """Arrays of one length as rows of a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(rows, -1)


def assigned(x: np.ndarray, c: np.ndarray, way: np.ndarray | None, cell: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Cells, squared distances and lower bounds of rows x, and how many had to be compared with all centres; way: how far each centre moved, None at first."""
    if way is None:
        cell, low, again = np.zeros(len(x), int), np.zeros(len(x)), np.ones(len(x), bool)
        dist = np.zeros(len(x))
    else:
        most = int(way.argmax())
        other = np.delete(way, most).max(initial=0.0)
        low = low - np.where(cell == most, other, way[most])
        dist = ((x - c[cell]) ** 2).sum(1)
        again = np.sqrt(dist) * (1 + SLACK) >= low * (1 - SLACK)
    if again.any():
        all_ = compared(x[again], c)
        best = all_.argmin(1)
        near = all_[np.arange(len(all_)), best]
        all_[np.arange(len(all_)), best] = np.inf
        cell, dist, low = cell.copy(), dist.copy(), low.copy()
        cell[again], dist[again] = best, near
        low[again] = np.sqrt(all_.min(1))
    return cell, dist, low, int(again.sum())


def step(rows: DataFrame, ks: list[int], active: list[int], centres: dict[int, np.ndarray], ways: dict[int, np.ndarray | None] | None) -> DataFrame:
    """STATE after one step: a row for each object (all ks in order), then each task's sums of its cells for the active ks."""
    shared = rows.sparkSession.sparkContext.broadcast((centres, ways))
    names = [f.split(" ")[0] for f in STATE.split(", ")]
    d = len(next(iter(centres.values()))[0])
    lists_ = pa.list_(pa.float64())
    kinds = dict(zip(names, [pa.int64(), lists_, pa.list_(pa.int32()), lists_, lists_, pa.int32(), pa.int32(), lists_, pa.int64(), pa.float64(), pa.int64()], strict=True))

    def out(size: int, **columns) -> pa.RecordBatch:
        put = lambda x, kind: x.cast(kind) if isinstance(x, pa.Array) else pa.array(x, kind)
        return pa.RecordBatch.from_arrays([put(columns[c], kinds[c]) if c in columns else pa.nulls(size, kinds[c]) for c in names], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, ways = shared.value
        sums = {k: [np.zeros((len(centres[k]), d)), np.zeros(len(centres[k]), np.int64), np.zeros(len(centres[k])), 0] for k in active}
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                part = whole.slice(at, ROWS)
                m = part.num_rows
                x = matrix(part.column(1), m)
                first = ways is None
                cells, dist, low = (np.zeros((m, len(ks))) if first else matrix(part.column(c), m) for c in (2, 3, 4))
                cells = cells.astype(int)
                for n, k in enumerate(ks):
                    if k not in sums:
                        continue
                    cells[:, n], dist[:, n], low[:, n], again = assigned(x, centres[k], None if first else ways[k], cells[:, n], low[:, n])
                    total = sums[k]
                    np.add.at(total[0], cells[:, n], x)
                    np.add.at(total[1], cells[:, n], 1)
                    np.add.at(total[2], cells[:, n], dist[:, n])
                    total[3] += again
                yield out(m, id=part.column(0), v=part.column(1), cells=lists(cells, kinds["cells"]), dist=lists(dist, lists_), low=lists(low, lists_))
        for k, (s, n, j, again) in sums.items():
            used = np.flatnonzero(n)
            if len(used):
                yield out(len(used), k=[k] * len(used), cell=used, sum=list(s[used]), n=n[used], j=j[used], again=[again] + [0] * (len(used) - 1))

    return rows.select("id", "v", "cells", "dist", "low").mapInArrow(run, STATE)


def gathered(state: DataFrame) -> dict[tuple[int, int], tuple[np.ndarray, int, float, int]]:
    """The sums over all tasks by k and cell, added in Spark: as many rows as cells."""
    sums = state.where("k IS NOT NULL")
    parts = sums.select("k", "cell", F.posexplode("sum").alias("i", "x")).groupBy("k", "cell", "i").agg(F.sum("x").alias("x"))
    vectors = parts.groupBy("k", "cell").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("sum"))
    rows = vectors.join(sums.groupBy("k", "cell").agg(F.sum("n").alias("n"), F.sum("j").alias("j"), F.sum("again").alias("again")), ["k", "cell"]).collect()
    return {(r.k, r.cell): (np.array(r["sum"]), r.n, r.j, r.again) for r in rows}


def refilled(state: DataFrame, n: int, count: int) -> np.ndarray:
    """The `count` objects (as many as empty cells) farthest from their centres for the n-th k, in order of distance."""
    far = state.where("k IS NULL").select("id", "v", F.element_at("dist", n + 1).alias("d")).orderBy(F.desc("d"), "id").limit(count)
    return np.array([r.v for r in far.collect()], float)


def swept(objects: DataFrame, ks: list[int], max_steps: int = MAX_STEPS, tolerance: float = TOLERANCE) -> Swept:
    """Partitions of objects (id, v) into each of ks cells: summary, history, memberships and trajectories, as by one partition after the other.

    Cells are numbered by the energy of their centres. Ids should be unique; objects without vector are left out.
    """
    spark, ks = objects.sparkSession, sorted(set(ks))
    objects = objects.where(F.col("id").isNotNull() & F.col("v").isNotNull()).select(F.col("id").cast("long").alias("id"), F.col("v").cast("array<double>").alias("v"))
    kinds = ("k_clusters long, steps long, functional double, r2 double", "k_clusters long, step long, functional double, r2 double, cells long, compared long", "k_clusters long, id long, k long, dist double", "k_clusters long, k long, centre array<double>")
    if objects.isEmpty():
        return Swept(*(spark.createDataFrame([], kind) for kind in kinds))
    with scratch(spark, "sweep") as put:
        history, members, centres, names = _iterated(put, objects, ks, max_steps, tolerance)
        number = spark.createDataFrame([(k, n, c, int(names[k][c])) for n, k in enumerate(ks) for c in range(len(names[k]))], "k_clusters long, _n int, _c int, k long")
        each = members.where("k IS NULL").select("id", F.posexplode(F.arrays_zip("cells", "dist")).alias("_n", "_s")).select("id", "_n", F.col("_s.cells").alias("_c"), F.col("_s.dist").alias("dist"))
        memberships = materialize(each.join(F.broadcast(number), ["_n", "_c"]).select("k_clusters", "id", "k", "dist"), "sweep-memberships")
    e = objects.agg(F.sum(energy(F.col("v")))).first()[0]
    r2 = lambda j: 1 - j / e if e else 0.0
    lines = [(k, s, j, r2(j), cells, again) for k in ks for s, (j, cells, again) in enumerate(history[k])]
    last = [(k, len(history[k]), history[k][-1][0], r2(history[k][-1][0])) for k in ks]
    found = [(k, int(names[k][c]), centre.tolist()) for k in ks for c, centre in enumerate(centres[k])]
    return Swept(spark.createDataFrame(last, kinds[0]), spark.createDataFrame(lines, kinds[1]), memberships, spark.createDataFrame(found, kinds[3]))


def _iterated(put: Scratch, objects: DataFrame, ks: list[int], max_steps: int, tolerance: float):
    centres = started(objects, ks)
    rows = objects.selectExpr("id", "v", "CAST(NULL AS array<int>) AS cells", "CAST(NULL AS array<double>) AS dist", "CAST(NULL AS array<double>) AS low")
    active, ways, state, history = list(ks), None, None, {k: [] for k in ks}
    for n_step in range(max_steps):
        new = put.table(step(rows, ks, active, centres, ways), "state")
        if state is not None:
            put.drop(state)
        state, sums, ways, left = new, gathered(new), {}, []
        for k in active:
            own = {c: s for (kk, c), s in sums.items() if kk == k}
            j = sum(s[2] for s in own.values())
            history[k].append((float(j), len(own), int(sum(s[3] for s in own.values()))))
            empty = [c for c in range(k) if c not in own]
            moved = np.full((k, len(next(iter(own.values()))[0])), np.nan)
            for c, (total, n, _, _) in own.items():
                moved[c] = total / n
            if empty:
                far = refilled(state, ks.index(k), len(empty))
                moved[empty[: len(far)]] = far
                moved = moved[~np.isnan(moved).any(1)]  # fewer objects than cells
            old = centres[k]
            ways[k] = None if len(moved) != len(old) else np.sqrt(((moved - old) ** 2).sum(1))
            before = history[k][-2][0] if n_step else 0.0
            if not (n_step > 2 and abs(before - j) / (before + 1e-12) < tolerance):
                left.append(k)
            centres[k] = moved
        active, rows = left, state.where("k IS NULL")
        if not active:
            break
    names = {k: np.argsort(np.lexsort((np.arange(len(c)), (c**2).sum(1)))) for k, c in centres.items()}
    return history, state, centres, names


TABLES = ("summary", "history", "memberships", "trajectories")


def save(found: Swept, path: str) -> None:
    """The four tables of a sweep below path, each partitioned by the number of cells, so that one number is read alone. Tables that are there are replaced."""
    for name in TABLES:
        getattr(found, name).write.mode("overwrite").partitionBy("k_clusters").parquet(f"{path}/{name}")


def load(spark: SparkSession, path: str) -> Swept:
    """A sweep written by save()."""
    tables = [spark.read.parquet(f"{path}/{name}") for name in TABLES]
    return Swept(*[t.withColumn("k_clusters", F.col("k_clusters").cast("long")) for t in tables])
