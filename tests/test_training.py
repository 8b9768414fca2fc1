"""Mini-batches against numpy, and stopped runs against whole ones."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronomesh.operators import spectral, training
from chronomesh.sources.states import States


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(1)
    rows = [(i, x) for i, x in enumerate(rng.standard_normal((90, 3)).round(6).tolist())]
    return spark.createDataFrame([*rows, (7, [0.5, 0.5, 0.5])], "id long, features array<double>").cache()


def test_an_epoch_covers_every_point_once(spark, points, tmp_path):
    cells = training.laid_out(points, 4, 5, str(tmp_path / "cells"))
    for epoch in range(3):
        parts = [cells.where(F.col("cell").isin(b)).select("id", "features").collect() for b in training.batches(4, 5, epoch)]
        assert sorted((r.id, r.features) for p in parts for r in p) == sorted((r.id, r.features) for r in points.collect())
    assert training.batches(4, 5, 0) != training.batches(4, 5, 1) == training.batches(4, 5, 1)


def test_a_step_reads_its_cells_alone(points, tmp_path):
    cells = training.laid_out(points, 4, 5, str(tmp_path / "cells"))
    plan = cells.where(F.col("cell").isin([1, 2]))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell" in plan


@pytest.mark.parametrize("piece", [11, 1 << 14])
def test_three_epochs_equal_numpy(spark, points, monkeypatch, piece):
    monkeypatch.setattr(training, "PIECE", piece)
    got, history = training.train_in_batches(points, None, 3, 25, epochs=3, variance_weight=0.1, commutator_weight=0.01, seed=5)
    n_batches = 4
    numbered = points.withColumn("cell", training.cell(F.col("id"), n_batches * training.CELLS, 5)).collect()
    adam = spectral.Adam(spectral.initial_operators(3, 3, 5), 1e-2, 1.0)
    means = []
    for epoch in range(3):
        losses = []
        for chosen in training.batches(n_batches, 5, epoch):
            x = np.array([r.features for r in numbered if r.cell in chosen])
            loss, g = spectral.loss_and_gradient(x, adam.raw, 0.1)
            penalty, own = spectral.commutator_gradient(spectral.hermitian(adam.raw), 8, 5 + adam.t)
            losses.append((loss / len(x) + 0.01 * penalty, len(x)))
            adam.step(g / len(x) + 0.01 * own)
        means.append(np.average([v for v, _ in losses], weights=[m for _, m in losses]))
    assert np.allclose(got, adam.raw, rtol=0, atol=1e-10)
    assert np.allclose([h["loss"] for h in history], means)
    assert history[-1]["step"] == 12


def test_resumed_equals_whole_bit_for_bit(spark, points, tmp_path):
    run = lambda **how: training.train_in_batches(points, points.limit(9), 3, 25, target_steps=10, variance_weight=0.1, commutator_weight=0.01, seed=2, **how)
    whole, history = run()
    store = States(spark, str(tmp_path / "state"))
    run(store=store, every=3, stop_after=5)  # dies after step 5; step 3 is committed
    assert store.latest() == 3
    resumed, again = run(store=store, every=3)
    assert (resumed.view(float) == whole.view(float)).all()
    assert [h["loss"] for h in again] == [h["loss"] for h in history]
    assert np.allclose([h["held_loss"] for h in again], [h["held_loss"] for h in history])
    assert store.latest() == 12 == history[-1]["step"] and len(store.versions()) == 2
    once_more, _ = run(store=store)  # nothing left to do
    assert (once_more == whole).all()


def test_half_written_versions_are_not_read(spark, tmp_path):
    store, one = States(spark, str(tmp_path / "s"), keep=1), spark.createDataFrame([(1,)], "x int")
    assert store.latest() is None and store.read("t") is None
    store.commit(1, {"t": one})
    one.write.parquet(str(tmp_path / "s/data/000000000002-aa/t"))  # complete files, no marker
    (tmp_path / "s/data/000000000003-bb/t").mkdir(parents=True)
    assert store.latest() == 1 and store.read("t").first().x == 1

    class Broken:
        write = property(lambda self: (_ for _ in ()).throw(RuntimeError("executor lost")))

    with pytest.raises(RuntimeError):
        store.commit(4, {"t": one, "u": Broken()})
    assert store.latest() == 1
    store.commit(5, {"t": one.selectExpr("x + 1 AS x")})
    assert [n for n, _ in store.versions()] == [5] and store.read("t").first().x == 2 and store.read("t", 1) is None


def test_small_inputs(spark, points):
    assert training.train_in_batches(points.limit(0), None, 3, 10, epochs=1)[1] == []
    with pytest.raises(ValueError, match="epochs"):
        training.train_in_batches(points, None, 3, 10)
    few, history = training.train_in_batches(points.limit(2), None, 2, 1, epochs=1)  # some batches are empty
    assert history[-1]["step"] == 2 and np.isfinite(few).all()
    assert training.safe_batch(10, 4) == 256 and training.safe_batch(64, 4096) == 1


def test_steps_in_a_row_equal_single_jobs(spark, points, monkeypatch):
    """However rows are cut, the bits are the same; a job for each step, whose step the driver takes, agrees up to rounding."""
    run = lambda: training.train_in_batches(points, None, 3, 20, epochs=2, variance_weight=0.1, commutator_weight=0.01, seed=5)
    jobs, steps_in_row = [], training.steps_in_row
    monkeypatch.setattr(training, "steps_in_row", lambda rows, steps, *more: jobs.append(len(steps)) or steps_in_row(rows, steps, *more))
    whole, history = run()
    assert jobs == [5, 5]  # a job for each step before
    monkeypatch.setattr(training, "IN_ROW", 60)
    cut, again = run()
    assert jobs[2:] == [3, 2, 1, 3, 1] and (cut.view(float) == whole.view(float)).all() and again == history
    monkeypatch.setattr(training, "SMALL", 0)
    single, other = run()
    assert len(jobs) == 7 and np.allclose(single, whole, rtol=0, atol=1e-11)
    assert np.allclose([h["loss"] for h in other], [h["loss"] for h in history])
