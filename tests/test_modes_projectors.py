"""Directions of the metric and artefact projectors against numpy."""

from __future__ import annotations

import numpy as np

from chronomesh.operators import modes, projectors, spectral


def turned(values, d, rng):
    """Orthonormal rows with those of equal values turned among themselves and signs changed."""
    q = np.linalg.qr(np.random.default_rng(7).standard_normal((d, d)))[0][: len(values)]
    out = q.copy()
    for a, b in modes.groups(values):
        out[a:b] = np.linalg.qr(rng.standard_normal((b - a, b - a)))[0] @ q[a:b]
    return q, out


def test_degenerate_spectra_don_t_depend_on_the_solver():
    values = np.array([5.0, 5.0, 3.0, 2.0, 2.0, 2.0, 0.0])
    assert modes.groups(values) == [(0, 2), (2, 3), (3, 6)] and modes.groups(np.zeros(3)) == [] == modes.groups(np.zeros(0))
    for seed in range(5):
        q, other = turned(values, 9, np.random.default_rng(seed))
        for k in range(9):
            w = modes.leverage(values, other, k)
            assert np.allclose(w, modes.leverage(values, q, k), atol=1e-12)
            assert np.isclose(w.sum(), min(k, 6))
            b = modes.basis(values, other, k)
            assert np.allclose(b, modes.basis(values, q, k), atol=1e-9) and np.allclose(b @ b.T, np.eye(min(k, 6)), atol=1e-9)
        projector = modes.basis(values, other, 6).T @ modes.basis(values, other, 6)
        assert np.allclose(projector, q[:6].T @ q[:6], atol=1e-9)


def test_modes_equal_the_metric_s_eigenvectors(spark):
    a = spectral.hermitian(spectral.initial_operators(5, 4, 3))
    x = np.random.default_rng(2).standard_normal((30, 5))
    points = spark.createDataFrame([*enumerate(x.tolist()), (99, None), (98, [1.0]), (97, [float("nan")] * 5)], "id long, features array<double>")
    got = {r.id: r for r in modes.modes(points, a, 2).collect()}
    assert sorted(got) == list(range(30))
    known = {r.id: r for r in spectral.spectra(points, a).collect()}
    for i, f in enumerate(modes.features_at(x, a)[0]):
        values, vectors = np.linalg.eigh(f.T @ f)
        assert np.allclose(got[i].eigenvalues, values[::-1], atol=1e-9) and np.allclose(got[i].eigenvalues, known[i].eigenvalues[:5], atol=1e-9)
        assert np.allclose(got[i].leverage, (vectors[:, -2:] ** 2).sum(1)) and np.isclose(sum(got[i].leverage), 2)
        assert np.allclose(np.abs(np.array(got[i].tangents) @ vectors[:, -2:]), np.eye(2)[::-1], atol=1e-7)
        assert got[i].rank == 5 and got[i].regular
    mean = {r.component: r for r in modes.channel_leverage(modes.modes(points, a, 2)).collect()}
    assert np.isclose(sum(r.leverage for r in mean.values()), 2) and np.isclose(sum(r.share for r in mean.values()), 1)


def test_degenerate_ground_states_are_told():
    a = np.zeros((2, 3, 3), complex)
    a[0] = np.diag([1.0, 1.0, 5.0])
    assert not modes.features_at(np.array([[1.0, 0.0]]), a)[1][0]


def test_planted_artefact_is_removed(spark):
    rng = np.random.default_rng(5)
    shape = rng.standard_normal(6)
    shape /= np.linalg.norm(shape)
    brain = rng.standard_normal((400, 6)) * 0.1
    brain -= np.outer(brain @ shape, shape)  # nothing of it lies along the artefact
    x, events = brain.copy(), [50, 120, 121, 300, 395, 5000]
    for e in events[:-1]:
        x[max(0, e - 3) : e + 4] += np.outer(rng.standard_normal(len(x[max(0, e - 3) : e + 4])) * 9 + 20, shape)
    samples = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "i long, v array<double>").repartition(5)
    at = spark.createDataFrame([(e,) for e in [*events, None]], "i long")
    clean, rows = projectors.without_artefact(samples, at, 6, 3, 4)
    assert rows.shape == (1, 6) and abs(abs(rows[0] @ shape) - 1) < 1e-3 and rows[0][np.abs(rows[0]).argmax()] > 0
    got = np.array([r.v for r in clean.orderBy("i").collect()])
    assert np.allclose(got, x - np.outer(x @ rows[0], rows[0]), atol=1e-12)
    assert np.abs(got - brain).max() < 0.05 < np.abs(x - brain).max()
    inside = [i for e in events for i in range(e - 3, e + 4) if 0 <= i < 400]
    moments, n = projectors.second_moments(projectors.in_epochs(samples, at, 3, 4), 6)
    assert n == len(inside) and np.allclose(moments, x[inside].T @ x[inside])
    assert np.allclose(projectors.projected(samples, np.eye(6)[:2]).orderBy("i").first().v, [0, 0, *x[0][2:]])


def test_failures_change_nothing(spark):
    samples = spark.createDataFrame([(1, [1.0, 2.0]), (2, None), (3, [1.0]), (4, [float("nan"), 0.0])], "i long, v array<double>")
    for events in ([], [(900,)], [(2,)], [(4,)]):
        clean, rows = projectors.without_artefact(samples, spark.createDataFrame(events, "i long"), 2, 0, 1)
        assert rows.shape == (0, 2) and clean.count() == 4 and clean.where("i = 1").first().v == [1.0, 2.0]
    long = spark.createDataFrame([(1, 0, 5.0), (0, 0, 4.0), (0, 1, 2.0), (1, 1, 3.0)], "c int, t int, x double")
    assert {r.i: r.v for r in projectors.as_vectors(long, "c", "t", "x").collect()} == {0: [4.0, 5.0], 1: [2.0, 3.0]}
