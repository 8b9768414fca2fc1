"""Whitening against an eigendecomposition of the covariance in exact fractions."""

from __future__ import annotations

import math

import numpy as np
import pytest

from chronomesh.llm import whitening


def exact(vectors):
    """Distinct x, n, S and the covariance, centred in whole numbers."""
    xs = [[math.floor(64 * float(c)) + 1_000_000 for c in v] for v in vectors]
    fit = [list(v) for v in sorted({tuple(x) for x in xs})]
    n, s = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    d = [[n * c - t for c, t in zip(x, s, strict=True)] for x in fit]
    v = np.array([[sum(r[i] * r[j] for r in d) / n**3 for j in range(len(s))] for i in range(len(s))])
    return xs, n, s, v


def test_merges_lose_nothing():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 90, (500, 7)) + 10**6
    parts = [whitening.summary(x[a:b]) for a, b in ((0, 3), (3, 4), (4, 200), (200, 500))]
    held = parts[0]
    for p in parts[1:]:
        held = whitening.merged(held, p)
    n, sums, left = held
    assert n == 500 and sums == x.sum(0).tolist() and left.shape == (7, 7)
    c = x - x.mean(0)
    assert np.allclose(left.T @ left, c.T @ c, rtol=1e-12)


def test_large_entries_are_exact():
    x = np.array([[2**52, -(2**52)], [3, 4]])
    assert whitening.centred(x, 2**20, [5, 6]).tolist() == [[2**72 - 5, -(2**72) - 6], [3 * 2**20 - 5, 4 * 2**20 - 6]]


@pytest.mark.parametrize(("size", "dims", "parts"), [(300, 20, 40), (40, 5, 3), (17, 30, 20)])
def test_query(spark, tmp_path, monkeypatch, size, dims, parts):
    monkeypatch.setattr(whitening, "FAN", 3)
    monkeypatch.setattr(whitening, "ROWS", 7)
    rng = np.random.default_rng(size)
    v = (rng.standard_normal((size, dims)) * np.linspace(3, 0.5, dims) + rng.standard_normal(dims)).round(3)
    rows = [(i, x) for i, x in enumerate(v.tolist())]
    rows += [(1000 + i, rows[0][1]) for i in range(size)]  # a hot vector
    bad = [(2000, None), (2001, [None] * dims), (2002, [float("nan")] * dims), (2003, [float("inf")] * dims)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        frame = spark.createDataFrame([*rows, *bad, (None, rows[1][1])], "vec_id long, embedding array<double>").repartition(parts)
        frame.write.parquet(str(tmp_path / "embeddings.parquet"))
        got = whitening.op13_whitening(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    xs, n, s, cov = exact([r[1] for r in rows])
    e, vec = np.linalg.eigh(cov)
    e, vec = e[::-1], vec[:, ::-1]
    kept = min(16, dims, n - 1)
    assert len(got) == (len(rows) + 1) * kept
    at = {(r.vec_id, r.component): r for r in got}
    signs = {}
    for (vec_id, _), x in zip(rows, xs, strict=True):
        d = [n * c - t for c, t in zip(x, s, strict=True)]
        want = (np.array(d, float) / n) @ vec[:, :kept] / np.sqrt(e[:kept])
        for k in range(kept):
            r = at[vec_id, k + 1]
            assert r.n == n and r.deviation == sum(c * c for c in d)
            assert abs(r.explained / (e[k] / np.trace(cov)) - 1) < 1e-9
            sign = signs.setdefault(k, math.copysign(1, r.whitened * want[k]))
            assert abs(r.whitened - sign * want[k]) < 1e-6
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9
    assert at[None, 1].whitened == at[1, 1].whitened


def test_small_tables(spark):
    of = lambda rows: whitening.whitened(spark.createDataFrame(rows, "extra string, embedding array<float>, vec_id int"))
    assert of([]).count() == 0
    assert of([("a", None, 1), ("a", [None], 2)]).count() == 0
    assert of([("a", [], 1)]).count() == 0
    assert of([("a", [1.0, 2.0], 1), ("b", [1.0, 2.0], 2)]).count() == 0  # no variance
    got = of([("a", [1.0], 1), ("b", [], 2), ("c", [2.0, 0.0], 3), ("d", [1e30, 0.0], 4)]).collect()  # padded, clipped
    assert [sorted(r.vec_id for r in got), {r.n for r in got}] == [[1, 2, 3, 4], {4}]
    assert all(r.deviation == 2**63 - 1 for r in got)


def test_identity_error_is_measured(spark, monkeypatch):
    """Projections that are a tenth too long show in it."""
    real = np.linalg.svd

    def long(m, **how):
        u, s, vt = real(m, **how)
        return u, s, vt * 1.1 if s.shape == (2,) and len(m) == 2 else vt

    monkeypatch.setattr(whitening, "FAN", 64)
    monkeypatch.setattr(whitening.np.linalg, "svd", long)
    rows = [(i, [float(i % 3), float(i % 5)]) for i in range(30)]
    got = whitening.whitened(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).first()
    assert abs(got.identity_error - 0.21) < 1e-9
