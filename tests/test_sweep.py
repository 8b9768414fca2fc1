"""The sweep over numbers of cells against a plain loop for each."""

from __future__ import annotations

import numpy as np
import pytest

from chronomesh.operators import partition, sweep


def plain(x, k, max_steps=400):
    """Farthest-point repair, stop after the second step; cells by the energy of their centres."""
    order = np.lexsort((np.arange(len(x)), (x**2).sum(1)))
    c = x[[order[p] for p in sorted({int(j * (len(x) - 1) / (k - 1)) if k > 1 else 0 for j in range(k)})]]
    history = []
    for n in range(max_steps):
        d = ((x[:, None] - c[None]) ** 2).sum(2)
        cell, near = d.argmin(1), d.min(1)
        history.append(near.sum())
        empty = [q for q in range(k) if not (cell == q).any()]
        far = iter(np.lexsort((np.arange(len(x)), -near)))
        c = np.array([x[cell == q].mean(0) if q not in empty else x[next(far)] for q in range(k)])
        if n > 2 and abs(history[-2] - history[-1]) / (history[-2] + 1e-12) < 1e-5:
            break
    return cell, near, history, c, np.argsort(np.lexsort((np.arange(k), (c**2).sum(1))))


@pytest.fixture(scope="module")
def x():
    rng = np.random.default_rng(6)
    return np.concatenate([rng.standard_normal((150, 4)) + 6 * rng.standard_normal(4) for _ in range(4)] + [np.ones((9, 4))])


def test_four_tables_equal_a_plain_loop(spark, x, monkeypatch):
    monkeypatch.setattr(sweep, "ROWS", 50)
    ks = [1, 3, 8, 20]
    found = sweep.swept(spark.createDataFrame([*enumerate(x.tolist()), (9999, None)], "id long, v array<double>").repartition(4), ks)
    history, members, centres = (getattr(found, n).collect() for n in ("history", "memberships", "trajectories"))
    summary = {r.k_clusters: r for r in found.summary.collect()}
    for k in ks:
        cell, near, want, c, names = plain(x, k)
        got = sorted((r for r in history if r.k_clusters == k), key=lambda r: r.step)
        assert np.allclose([r.functional for r in got], want, rtol=1e-9) and summary[k].steps == len(want)
        assert np.isclose(summary[k].r2, 1 - want[-1] / (x**2).sum())
        own = {r.id: r for r in members if r.k_clusters == k}
        assert [own[i].k for i in range(len(x))] == names[cell].tolist() and np.allclose([own[i].dist for i in range(len(x))], near)
        place = {r.k: r.centre for r in centres if r.k_clusters == k}
        assert np.allclose([place[q] for q in range(k)], c[np.argsort(names)])
    late = [r for r in history if r.step > 4 and r.k_clusters > 1]
    assert sum(r.compared for r in late) < 0.5 * len(x) * len(late)  # most distances aren't computed again


def test_equals_the_partition_of_one_k(spark, x):
    objects = spark.createDataFrame(list(enumerate(x.tolist())), "id long, v array<double>")
    members, _, history = partition.partition(objects, 5)
    found = sweep.swept(objects, [5])
    assert {(r.id, r.k) for r in found.memberships.collect()} == {(r.id, r.k) for r in members.collect()}
    assert np.allclose([r.functional for r in found.history.orderBy("step").collect()], [h["functional"] for h in history])


def test_small(spark):
    none = sweep.swept(spark.createDataFrame([(1, None)], "id long, v array<double>"), [2])
    assert [getattr(none, n).count() for n in ("summary", "history", "memberships", "trajectories")] == [0] * 4
    few = sweep.swept(spark.createDataFrame([(1, [0.0]), (2, [5.0])], "id long, v array<double>"), [2, 4])  # fewer objects than cells
    assert {(r.k_clusters, r.id, r.dist) for r in few.memberships.collect()} == {(k, i, 0.0) for k in (2, 4) for i in (1, 2)}


def test_nearest_centres_by_products_equal_all_distances(monkeypatch):
    """The two smallest distances and the first nearest centre, bit for bit, also with ties, copies and far origins; few others are computed."""
    rng = np.random.default_rng(4)
    for shift in (0.0, 1e3, 1e6):
        x, c = rng.standard_normal((300, 8)) + shift, rng.standard_normal((90, 8)) + shift
        c[50], x[7] = c[3], c[3]
        x[:20] = np.round(x[:20])
        all_, some = sweep.squares(x, c), sweep.compared(x, c)
        assert (some.argmin(1) == all_.argmin(1)).all()
        assert (np.sort(some, 1)[:, :2] == np.sort(all_, 1)[:, :2]).all()
        if not shift:
            assert np.isfinite(some).sum() < 3 * len(x)
    x[5, 2] = np.nan
    assert np.isnan(sweep.compared(x, c)[5]).all()
