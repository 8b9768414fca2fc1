"""Mini-batch training of the spectral kernel that can be stopped and resumed.

Points are dealt once into cells by a seeded hash of their id and written cell by cell. An
epoch is a seeded order of the cells; a batch is the next CELLS of them, so a step reads one
batch and prunes the rest of the table. A cell's gradient is summed in order of its points,
cells are added in order of their numbers, all inside Spark tasks: a step gives the same
bits wherever its tasks run. The driver holds operators and moments, whose size is fixed by
dimension and states.

Steps follow each other, so small batches leave nothing to spread, and a job for each would
cost more than its points. Batches of up to SMALL points are taken in rows of about IN_ROW
points: an epoch's points are written row by row, and a job has one task take a row's steps as
they come, with one cell in memory. No task sees more than a row, which a parameter bounds.

With States, the operators, both moments, the step and the history are committed every few
steps, and a later call goes on from the last committed step to the same bits as a run that
was never stopped.
"""

from __future__ import annotations

import copy
import json
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronomesh.operators.spectral import Adam, commutator_gradient, epochs_for, hermitian, initial_operators, loss_and_gradient, validation
from chronomesh.sources.shared import delete, shared_path
from chronomesh.sources.states import States

#: Cells of a batch; more of them mix batches better and spread a step over more tasks.
CELLS = 8
#: Points whose matrices are held at once.
POINTS = 256
#: Points of a batch up to which steps are taken in a row by one task, and points of such a row, about.
SMALL, IN_ROW = 2048, 1 << 16
#: Numbers of a gradient that are added in one task.
PIECE = 1 << 14
#: Memory for the matrices of the points held at once.
BUDGET = 256 << 20


def safe_batch(dimension: int, states: int, budget: int = BUDGET) -> int:
    """Points, 1 to POINTS, whose Hamiltonians, states and transitions fit the budget of bytes."""
    of_point = 16 * (3 * states**2 + 2 * dimension * states) + 8 * (2 * dimension * states + dimension**2)
    return max(1, min(POINTS, budget // of_point))


def cell(id: Column, cells: int, seed: int) -> Column:
    """Number from 0 to cells - 1, by the first 32 bits of an md5."""
    return (F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), id.cast("string")).cast("binary")), 1, 8), 16, 10).cast("long") % cells).cast("int")


def batches(n_batches: int, seed: int, epoch: int) -> list[list[int]]:
    """The cells of each batch of an epoch: every cell in one batch."""
    order = np.random.default_rng([seed, epoch]).permutation(n_batches * CELLS)
    return [sorted(b) for b in order.reshape(n_batches, CELLS).tolist()]


def laid_out(points: DataFrame, n_batches: int, seed: int, path: str) -> DataFrame:
    """points (id, features) by cell, written to path; a filter on cell reads that cell's files alone."""
    rows = points.select("id", "features").withColumn("cell", cell(F.col("id"), n_batches * CELLS, seed))
    rows.repartition("cell").write.mode("overwrite").partitionBy("cell").parquet(path)
    return points.sparkSession.read.schema(rows.schema).parquet(path)


def in_rows(points: DataFrame, n_batches: int, seed: int, epoch: int, span: int, path: str) -> DataFrame:
    """points (id, features) of an epoch with their step t and cell, written to path by row, of `span` steps each; a filter on row reads that row's files alone."""
    order = points.sparkSession.createDataFrame([(epoch * n_batches + b, c) for b, own in enumerate(batches(n_batches, seed, epoch)) for c in own], "t int, cell int")
    rows = points.select("id", "features", cell(F.col("id"), n_batches * CELLS, seed).alias("cell")).join(order, "cell")
    rows = rows.select("t", "cell", "id", "features", F.floor(F.col("t") / span).cast("int").alias("row"))
    rows.repartition("row").write.mode("overwrite").partitionBy("row").parquet(path)
    return points.sparkSession.read.schema(rows.schema).parquet(path)


def cell_sums(ids: np.ndarray, x: np.ndarray, raw: np.ndarray, variance_weight: float, at_once: int) -> np.ndarray:
    """A cell's gradient (real parts, imaginary parts), loss and number of points, summed in order of its points."""
    x = x[np.lexsort((*x.T[::-1], ids))]  # points that share an id too
    total, gradient = 0.0, np.zeros_like(raw)
    for at in range(0, len(x), at_once):
        loss, g = loss_and_gradient(x[at : at + at_once], raw, variance_weight)
        total, gradient = total + loss, gradient + g
    return np.concatenate([gradient.real.ravel(), gradient.imag.ravel(), [total, len(x)]])


def mean_of(flat: np.ndarray, like: np.ndarray) -> tuple[float, np.ndarray, int]:
    """Mean loss and gradient, and the number of points, from sums over a batch."""
    n = int(flat[-1])
    return flat[-2] / n, (flat[: like.size] + 1j * flat[like.size : 2 * like.size]).reshape(like.shape) / n, n


def batch_gradient(cells: DataFrame, chosen: list[int], raw: np.ndarray, variance_weight: float) -> tuple[float, np.ndarray, int]:
    """Mean loss and gradient over the points of the chosen cells, and their number."""
    shared = cells.sparkSession.sparkContext.broadcast(raw)
    at_once = safe_batch(raw.shape[0], raw.shape[1])

    def of_cell(table: pa.Table) -> pa.Table:
        x = np.array(table.column("features").to_pylist(), float)
        flat = cell_sums(table.column("id").to_numpy(), x, shared.value, variance_weight, at_once)
        pieces = [flat[at : at + PIECE] for at in range(0, len(flat), PIECE)]
        return pa.table({"cell": pa.array([table.column("cell")[0].as_py()] * len(pieces), pa.int32()), "piece": pa.array(range(len(pieces)), pa.int32()), "x": pa.array(pieces, pa.list_(pa.float64()))})

    def added(table: pa.Table) -> pa.Table:
        parts = table.sort_by([("cell", "ascending")]).column("x").to_pylist()
        return pa.table({"piece": pa.array([table.column("piece")[0].as_py()], pa.int32()), "x": pa.array([list(map(sum, zip(*parts, strict=True)))], pa.list_(pa.float64()))})

    of = cells.where(F.col("cell").isin(chosen)).groupBy("cell").applyInArrow(of_cell, "cell int, piece int, x array<double>")
    rows = of.groupBy("piece").applyInArrow(added, "piece int, x array<double>").collect()  # one gradient, of fixed size
    shared.unpersist()
    if not rows:
        return 0.0, np.zeros_like(raw), 0
    return mean_of(np.concatenate([r.x for r in sorted(rows, key=lambda r: r.piece)]), raw)


def one_step(adam: Adam, found: tuple[float, np.ndarray, int], t: int, commutator_weight: float, pairs: int, seed: int) -> list | None:
    """Take step t from a batch's mean loss, gradient and number of points: [loss, points], or None where the batch is empty."""
    loss, g, size = found
    if not size:
        adam.t += 1
        return None
    if commutator_weight:
        penalty, own = commutator_gradient(hermitian(adam.raw), pairs, seed + t)
        loss, g = loss + commutator_weight * penalty, g + commutator_weight * own
    adam.step(g)
    return [float(loss), size]


def steps_in_row(rows: DataFrame, steps: range, adam: Adam, variance_weight: float, commutator_weight: float, pairs: int, seed: int) -> list:
    """Take the steps, whose points are rows (t, cell, id, features), in one job and set adam to what they lead to; for each what one_step() gives."""
    shared, at_once = rows.sparkSession.sparkContext.broadcast(adam), safe_batch(adam.raw.shape[0], adam.raw.shape[1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the task starts from the state that was sent, however often it is run
        own, taken, sums = copy.deepcopy(shared.value), {}, {}
        at, held = None, []

        def cell_done() -> None:
            if held:
                ids, x = (np.concatenate(part) for part in zip(*held, strict=True))
                sums[at[0]] = [*sums.get(at[0], []), cell_sums(ids, x, own.raw, variance_weight, at_once)]
                held.clear()

        def steps_before(stop: int | None) -> None:
            while len(taken) < len(steps) and (stop is None or steps[len(taken)] < stop):
                t = steps[len(taken)]
                parts = sums.pop(t, None)
                found = (0.0, np.zeros_like(own.raw), 0) if parts is None else mean_of(sum(parts), own.raw)
                taken[t] = one_step(own, found, t, commutator_weight, pairs, seed)

        for batch in batches:
            place = np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()], axis=1)
            cuts = [0, *(np.flatnonzero((place[1:] != place[:-1]).any(1)) + 1).tolist(), len(place)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                if tuple(place[a]) != at:
                    cell_done()
                    at = tuple(place[a].tolist())
                    steps_before(at[0])
                part = batch.slice(a, b - a)
                held.append((part.column(2).to_numpy(), part.column(3).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(b - a, -1)))
        cell_done()
        steps_before(None)
        numbers = [own.raw.real, own.raw.imag, own.m.real, own.m.imag, *own.v]
        flat = np.concatenate([np.ascontiguousarray(x).ravel() for x in numbers])
        for i in range(0, len(flat), PIECE):
            yield pa.RecordBatch.from_pylist([{"piece": i // PIECE, "x": flat[i : i + PIECE].tolist()}], schema)
        yield pa.RecordBatch.from_pylist([{"piece": -1 - t, "x": [float(n) for n in x or (0, 0)]} for t, x in taken.items()], schema)

    schema = pa.schema([("piece", pa.int32()), ("x", pa.list_(pa.float64()))])
    found = rows.select("t", "cell", "id", "features").coalesce(1).sortWithinPartitions("t", "cell").mapInArrow(run, "piece int, x array<double>").collect()  # the state, of fixed size, and a row for each step
    shared.unpersist()
    flat = np.concatenate([r.x for r in sorted(found, key=lambda r: r.piece) if r.piece >= 0]).reshape(6, *adam.raw.shape)
    adam.raw, adam.m, adam.v, adam.t = flat[0] + 1j * flat[1], flat[2] + 1j * flat[3], flat[4:], adam.t + len(steps)
    taken = {-1 - r.piece: [r.x[0], int(r.x[1])] for r in found if r.piece < 0}
    return [taken[t] if taken[t][1] else None for t in steps]


def saved(states: States, adam: Adam, history: list[dict]) -> None:
    """Commit what the next step needs as version t: a row for each operator, and the history."""
    flat = lambda m: np.ascontiguousarray(m).reshape(-1).tolist()
    rows = [(k, *(flat(x) for x in (a.real, a.imag, m.real, m.imag, v, w))) for k, (a, m, v, w) in enumerate(zip(adam.raw, adam.m, adam.v[0], adam.v[1], strict=True))]
    names = "re", "im", "m_re", "m_im", "v_re", "v_im"
    operators = states.spark.createDataFrame(rows, "operator int, " + ", ".join(f"{c} array<double>" for c in names))
    records = states.spark.createDataFrame([(h["step"], json.dumps(h)) for h in history], "step int, record string")
    states.commit(adam.t, {"operators": operators, "history": records})


def restored(states: States, adam: Adam) -> list[dict]:
    """Set adam to the latest committed version; its history."""
    rows = sorted(states.read("operators").collect(), key=lambda r: r.operator)
    shape = adam.raw.shape[1:]
    of = lambda c: np.array([r[c] for r in rows]).reshape(-1, *shape)
    if len(rows) != len(adam.raw) or len(rows[0].re) != shape[0] ** 2:
        raise ValueError("the committed state has other dimensions")
    adam.raw, adam.m, adam.v = of("re") + 1j * of("im"), of("m_re") + 1j * of("m_im"), np.stack([of("v_re"), of("v_im")])
    adam.t = states.latest()
    return [json.loads(r.record) for r in sorted(states.read("history").collect(), key=lambda r: r.step)]


def train_in_batches(
    points: DataFrame,
    held: DataFrame | None,
    states: int,
    batch: int,
    epochs: int | None = None,
    target_steps: int | None = None,
    rate: float = 1e-2,
    variance_weight: float = 0.0,
    commutator_weight: float = 0.0,
    pairs: int = 8,
    clip: float = 1.0,
    seed: int = 0,
    store: States | None = None,
    every: int = 50,
    stop_after: int | None = None,
) -> tuple[np.ndarray, list[dict]]:
    """Operators trained by AdamW on batches of about `batch` points (id, features), and a history: step and mean loss of every epoch, with the held-out points' loss every twentieth part of the epochs.

    Give epochs or target_steps. With a store, a committed run goes on where it stopped; every: steps between
    commits, or a multiple of it where a row of small batches is taken at once. stop_after: steps after which this call ends without a commit, as if it were killed. No points: the initial operators.
    """
    if (epochs is None) == (target_steps is None):
        raise ValueError("give epochs or target_steps")
    points = points.where(F.col("id").isNotNull() & F.col("features").isNotNull())
    first = points.select("features").first()
    if first is None:
        return initial_operators(0, states, seed), []
    n = points.count()
    n_batches = max(1, math.ceil(n / batch))
    epochs = epochs_for(target_steps, n, batch) if epochs is None else epochs
    adam, history, losses = Adam(initial_operators(len(first[0]), states, seed), rate, clip), [], []
    if store is not None and store.latest() is not None:
        history = restored(store, adam)
        losses = history.pop()["losses"] if history and "losses" in history[-1] else []
    path = shared_path(points.sparkSession, "cells")
    small, span, done = batch <= SMALL, max(1, IN_ROW // batch), 0
    cells = None if small else laid_out(points, n_batches, seed, path)
    last = epochs * n_batches if stop_after is None else min(epochs * n_batches, adam.t + stop_after)
    epoch, order = -1, []
    while adam.t < last:
        t = adam.t
        if t // n_batches != epoch:
            epoch = t // n_batches
            if small:
                cells = in_rows(points, n_batches, seed, epoch, span, path)
            else:
                order = batches(n_batches, seed, epoch)
        # a row of steps ends with its epoch, and with the last commit that is due in it
        end = min(last, (t // span + 1) * span, (epoch + 1) * n_batches) if small else t + 1
        if store is not None and end // every * every > t:
            end = end // every * every
        if small:
            own = cells.where((F.col("row") == t // span) & F.col("t").between(t, end - 1))
            taken = steps_in_row(own, range(t, end), adam, variance_weight, commutator_weight, pairs, seed)
        else:
            taken = [one_step(adam, batch_gradient(cells, order[t % n_batches], adam.raw, variance_weight), t, commutator_weight, pairs, seed)]
        losses += [x for x in taken if x is not None]
        if adam.t % n_batches == 0:
            row = {"step": adam.t, "epoch": epoch + 1, "loss": sum(x * m for x, m in losses) / sum(m for _, m in losses)}
            if held is not None and ((epoch + 1) % max(1, epochs // 20) == 0 or epoch + 1 == epochs):
                row |= validation(held, adam.raw, variance_weight)
            history.append(row)
            losses = []
        done += end - t
        if stop_after is not None and done >= stop_after:
            break
        if store is not None and (adam.t % every == 0 or adam.t == epochs * n_batches):
            saved(store, adam, [*history, {"step": adam.t, "losses": losses}])
    delete(points.sparkSession, path)
    return adam.raw, history
