from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronomesh.functions import columns as C
from chronomesh.operators import aggregates as A
from chronomesh.operators import estimators as E
from chronomesh.operators import filters, joins, ordinal, partition, spectral
from chronomesh.operators import sequences as S
from chronomesh.operators.ranks import ranked
from chronomesh.sources import signals


def frame(spark, values, channel=1):
    return spark.createDataFrame([(channel, i, float(x)) for i, x in enumerate(values)], "channel long, i long, x double")


def test_chunked_windows_equal_whole_ones(spark):
    x = np.random.default_rng(1).normal(size=97)
    df = frame(spark, x)
    sums = lambda w: {"s": F.sum("x").over(w.rowsBetween(-5, 3))}
    small = {r.i: r.s for r in S.framed(df, "channel", "i", 5, 3, sums, chunk=10).collect()}
    whole = {r.i: r.s for r in S.framed(df, "channel", "i", 5, 3, sums).collect()}
    assert small.keys() == whole.keys() and all(abs(small[i] - whole[i]) < 1e-9 for i in whole)
    running = {r.i: r.c for r in S.running_sum(df, "channel", "i", F.col("x"), "c", chunk=10).collect()}
    assert np.allclose([running[i] for i in range(97)], np.cumsum(x))


def test_runs_and_edges(spark):
    df = spark.createDataFrame([(1, i, s) for i, s in enumerate(["a", "a", None, None, "b", "a"])], "channel long, i long, s string")
    got = sorted((r.start, r.stop, r.n, r.s) for r in S.runs(df, "channel", "i", ["s"]).collect())
    assert got == [(0, 1, 2, "a"), (2, 3, 2, None), (4, 4, 1, "b"), (5, 5, 1, "a")]
    on = F.coalesce(F.col("s") == "a", F.lit(False))
    assert sorted(r.i for r in S.edges(df, "channel", "i", on, True).collect()) == [0, 5]
    assert sorted(r.i for r in S.edges(df, "channel", "i", on, False).collect()) == [5]


def test_refractory_counts_from_the_last_accepted(spark):
    df = spark.createDataFrame([(1, t) for t in (0, 150, 210, 400, 410, 700)], "channel long, t long")
    assert sorted(r.t for r in S.refractory(df, "channel", "t", 200).collect()) == [0, 210, 410, 700]


def test_next_sample(spark):
    grid = spark.createDataFrame([(1, i, 10 * i) for i in range(5)], "channel long, i long, t long")
    events = spark.createDataFrame([(1, 0), (1, 11), (1, 12), (1, 40), (1, 41)], "channel long, e long")
    assert sorted(r.i for r in joins.next_sample(events, grid, "channel", "e", "t", "i").collect()) == [0, 2, 4]


def test_epochs_drop_events_at_the_ends(spark):
    df = frame(spark, range(10))
    events = spark.createDataFrame([(1, 1), (1, 5), (1, 8)], "channel long, at long")
    got = joins.epochs(df, events, "channel", "i", "at", 2, 2).collect()
    assert {r.at for r in got} == {5} and sorted(r.offset for r in got) == [-2, -1, 0, 1, 2]


def entropy_by_hand(x, m):
    codes = [tuple(np.argsort(x[i : i + m], kind="stable")) for i in range(len(x) - m + 1)]
    p = np.array([codes.count(c) for c in set(codes)]) / len(codes)
    n = ordinal.math.factorial(m)
    h = -(p * np.log2(p + 1e-13)).sum()
    full = np.concatenate([p, np.zeros(n - len(p))])
    mixed = (full + 1 / n) / 2
    jsd = -(mixed * np.log2(mixed + 1e-13)).sum() - h / 2 - np.log2(n) / 2
    return h / np.log2(n), jsd * h / np.log2(n) * ordinal.q0(n)


def test_entropy_and_complexity_on_both_sides(spark):
    x = np.random.default_rng(3).integers(0, 6, 300).astype(float)  # full of ties
    rows = ordinal.features(frame(spark, x), "channel", "i", "x", [30, 125], 25).collect()
    assert {(r.window, r.m) for r in rows} == {(30, 3), (125, 4)}
    assert sorted({r.centre for r in rows}) == list(range(125, 300 - 125, 25))
    for r in rows:
        for side, part in (("left", x[r.centre - r.window : r.centre]), ("right", x[r.centre : r.centre + r.window])):
            pe, sc = entropy_by_hand(part, r.m)
            assert r[f"pe_{side}"] == pytest.approx(pe, abs=2e-5) and r[f"sc_{side}"] == pytest.approx(sc, abs=2e-5)


def test_monotone_signal_has_no_entropy(spark):
    counts = ordinal.patterns(frame(spark, range(50)), "channel", "i", "x", 3).groupBy("channel", "code").agg(F.count("*").alias("n"))
    row = ordinal.entropy_complexity(counts, ["channel"], 3).first()
    assert abs(row.pe) < 1e-9 and abs(row.sc) < 1e-9


def test_constants():
    assert [round(ordinal.q0(n), 10) for n in (6, 24)] == [1.5270496711, 1.1444185856]
    assert ordinal.largest_complexity(3) == pytest.approx(0.21996, abs=1e-4)
    assert E.hard_threshold(1.0) == pytest.approx(4 / 3**0.5)
    assert E.noise_median(46 / 306) == pytest.approx(0.97449, abs=1e-4)


def test_partition_decreases_and_fills_cells(spark):
    rng = np.random.default_rng(2)
    rows = [(i, (rng.normal(size=4) + 5 * (i % 3)).tolist()) for i in range(60)] + [(60 + i, [0.0] * 4) for i in range(5)]
    members, centres, history = partition.partition(spark.createDataFrame(rows, "id long, v array<double>"), 4, max_steps=6)
    functional = [h["functional"] for h in history]
    assert functional[-1] <= functional[0] and centres.count() == 4
    assert members.select("id").distinct().count() == 65
    energies = [sum(x * x for x in r.centre) for r in centres.orderBy("k").collect()]
    assert energies == sorted(energies)


def test_gradient_matches_finite_differences():
    rng = np.random.default_rng(5)
    raw, x = spectral.initial_operators(3, 4, 1), rng.normal(size=(7, 3))
    for weight in (0.0, 0.5):
        _, g = spectral.loss_and_gradient(x, raw, weight, soften=0)
        for _ in range(6):
            step = rng.normal(size=raw.shape) + 1j * rng.normal(size=raw.shape)
            e = 1e-5
            up, down = (spectral.loss_and_gradient(x, raw + s * e * step, weight)[0] for s in (1, -1))
            assert (up - down) / (2 * e) == pytest.approx(float((g.conj() * step).real.sum()), rel=1e-4, abs=1e-5)


def test_training_lowers_the_loss_and_spectra_keep_their_trace(spark):
    points = signals.manifold(spark, "sphere", 60)
    operators, losses = spectral.fit(points, 4, 8, rate=0.02)
    assert losses[-1] < losses[0]
    for r in spectral.spectra(points, operators).collect():
        assert sum(r.eigenvalues) == pytest.approx(r.metric_trace) and len(r.eigenvalues) == 6


def test_spectra_leave_out_broken_points(spark):
    points = spark.createDataFrame([(1, [0.1, 0.2]), (2, None), (3, [float("nan"), 0.0]), (4, [0.1])], "id long, features array<double>")
    assert [r.id for r in spectral.spectra(points, spectral.initial_operators(2, 3, 0)).collect()] == [1]


def test_filters_in_chunks_equal_whole(spark):
    x = np.random.default_rng(4).normal(size=200) + 3
    df = frame(spark, x)
    for f in (lambda c: filters.smoothed(df, "channel", "i", "x", 11, chunk=c), lambda c: filters.band_pass(df, "channel", "i", "x", 100, 1, 45, 21, chunk=c)):
        whole, parts = ({r.i: r.x for r in f(c).collect()} for c in (1 << 20, 64))
        assert len(parts) == 200 and all(abs(whole[i] - parts[i]) < 1e-9 for i in range(11, 189))
    t = np.arange(200.0)
    line = {r.i: r.x for r in filters.smoothed(frame(spark, t * t), "channel", "i", "x", 11).collect()}
    assert np.allclose([line[i] for i in range(200)], t * t)  # parabolas stay as they are, up to the ends


def test_estimators_on_edge_spectra(spark):
    rows = [(1, [0.0] * 8), (2, [1.0] + [0.0] * 7), (3, [1.0, 1.0] + [1e-3] * 6), (4, [1e-9] * 8)]
    df = spark.createDataFrame(rows, "id long, ev array<double>")
    got = {r.id: (r.t, r.g, r.p) for r in df.select("id", E.threshold_dimension(F.col("ev")).alias("t"), E.ratio_gap_dimension(F.col("ev")).alias("g"), E.participation_ratio(F.col("ev")).alias("p")).collect()}
    assert got[1][:2] == (0, 0) and got[2][:2] == (1, 1) and got[3][:2] == (2, 2) and got[4][1] == 0
    assert got[2][2] == pytest.approx(1.0)


def test_histogram_closes_the_last_bin(spark):
    df = spark.createDataFrame([("a", 0.0), ("a", 1.0), ("a", 0.5), ("b", 2.0)], "k string, v double")
    got = {(r.k, r.bin): r.n for r in A.histogram(df, ["k"], "v", F.lit(0.0), F.lit(1.0), 2).collect()}
    assert got == {("a", 0): 1, ("a", 1): 2}


def test_quantised_within_bound_and_logs(spark, tmp_path):
    bounds = spark.createDataFrame([("mag", 0.1), ("eeg", 0.01)], "kind string, eps double")
    df = spark.createDataFrame([("mag", 1.2345), ("eeg", -0.777)], "kind string, x double")
    got = {r.kind: r.x for r in signals.quantised(df, bounds, "kind", "x").collect()}
    assert abs(got["mag"] - 1.2345) <= 0.1 and abs(got["eeg"] + 0.777) <= 0.01
    (tmp_path / "log.csv").write_text("a,b\n1,x\nbad,y\n")
    rows = signals.read_log(spark, str(tmp_path / "log.csv"), "a int, b string").collect()
    assert [(r.a, r.b) for r in rows] == [(1, "x"), (None, "y")] and rows[1]["_corrupt_record"]


def test_signals_are_written_by_channel(spark, tmp_path):
    df = frame(spark, range(10)).unionByName(frame(spark, range(5), 2))
    signals.write_signal(df, str(tmp_path / "s"), "channel", "i")
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.where("channel = 2").count() == 5 and "PartitionFilters: [isnotnull(channel" in back.where("channel = 2")._jdf.queryExecution().toString()
    assert signals.found(spark, str(tmp_path / "s"), "*.parquet").count() == 2


def test_many_small_channels_are_written_by_several_tasks(spark, tmp_path):
    df = spark.range(400).select((F.col("id") % 40).alias("channel"), "id", F.lit(1.0).alias("x"))
    signals.write_signal(df, str(tmp_path / "s"), "channel", "id")
    files = list((tmp_path / "s").glob("channel=*/*.parquet"))
    assert len(files) == 40 and spark.read.parquet(str(tmp_path / "s")).count() == 400
    assert len({f.name.split("-")[1] for f in files}) > 1


def test_columns(spark):
    df = spark.createDataFrame([(" Awake ", 2.5, float("inf"))], "s string, x double, y double")
    r = df.select(C.canonical(F.col("s"), {"awake": "correct"}).alias("s"), C.half_even(F.col("x"), 0).alias("x"), C.finite_or_zero(F.col("y")).alias("y"), C.slug(F.lit("A b/C")).alias("g")).first()
    assert (r.s, r.x, r.y, r.g) == ("correct", 2.0, 0.0, "a_b_c")


def test_constants_by_other_ways():
    """The constants that the queries' SQL takes over, found in independent ways."""
    for beta in (0.05, 64 / 306, 0.7, 1.0):
        # the median splits the density of eigenvalues in two, by quadrature in another variable
        middle, low, high = E.noise_median(beta) ** 2, (1 - math.sqrt(beta)) ** 2, (1 + math.sqrt(beta)) ** 2
        nodes, weights = np.polynomial.legendre.leggauss(400)

        def mass(a, b):
            angle = (nodes + 1) * math.pi / 4  # x = a + (b - a) sin^2, smooth at both ends
            x = a + (b - a) * np.sin(angle) ** 2
            step = (b - a) * 2 * np.sin(angle) * np.cos(angle) * math.pi / 4
            return float((weights * step * np.sqrt(np.maximum((high - x) * (x - low), 0)) / (2 * math.pi * beta * np.maximum(x, 1e-300))).sum())

        assert mass(low, middle) == pytest.approx(0.5, abs=2e-4) and mass(middle, high) == pytest.approx(0.5, abs=2e-4)
    assert E.hard_threshold(1.0) == pytest.approx(4 / math.sqrt(3))  # known in closed form
    for m in (3, 4):
        n = math.factorial(m)
        best = 0.0
        for k in range(1, 4000):
            p = np.full(n, (1 - k / 4000) / (n - 1))
            p[0] = k / 4000
            h = lambda x: float(-(x * np.log2(x)).sum())
            best = max(best, ordinal.q0(n) * (h((p + 1 / n) / 2) - h(p) / 2 - math.log2(n) / 2) * h(p) / math.log2(n))
        assert ordinal.largest_complexity(m) == pytest.approx(best, rel=1e-4)


def test_half_widths_reach_any_width(spark):
    x = [5.0] * 3 + [6.0 + k / 100 for k in range(300)] + [20.0] + [12.0] * 40 + [1.0, 9.0, 1.0]
    peaks = [303, 345]
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate(x)], "channel string, i long, x double")
    rows = spark.createDataFrame([("a", i, x[i], 2.0) for i in peaks], "channel string, i long, x double, pedestal double")
    got = {r.i: r for r in S.half_widths(df, rows, "channel", "i", "x", F.col("pedestal"), 4).collect()}
    for p in peaks:
        half, left, right = 2.0 + 0.5 * (x[p] - 2.0), p, p
        while left > 0 and x[left] > half:
            left -= 1
        while right < len(x) - 1 and x[right] > half:
            right += 1
        want = (p - left, right - p, right - left, (p - left) / (right - p) if right > p else 1.0)
        assert (got[p].rise, got[p].decay, got[p].width, got[p].asymmetry) == pytest.approx(want)


def test_exploded_rows_are_never_broadcast(spark):
    """Spark estimates them by the rows they come from, so a few peaks or events of great reach would be sent to the driver."""
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    df = spark.range(100).selectExpr("'a' AS channel", "id AS i", "CAST(id % 7 AS DOUBLE) AS x")
    events = df.where("i % 20 = 10").select("channel", F.col("i").alias("at"))
    assert "SortMergeJoin" in plan(joins.epochs(df, events, "channel", "i", "at", 3, 3))
    assert "BroadcastHashJoin" not in plan(joins.lagged(df, df.select("channel", "i", F.lit(1.0).alias("s")), "channel", "i", 0, 8))
    met, plans = S.materialize, []
    with pytest.MonkeyPatch.context() as m:
        m.setattr(S, "materialize", lambda rows, label: plans.append((label, plan(rows))) or met(rows, label))
        peaks = df.where("x = 6").withColumn("pedestal", F.lit(0.0))
        assert S.half_widths(df, peaks, "channel", "i", "x", F.col("pedestal"), 4).count() == peaks.count()
    looked = [p for label, p in plans if label == "peaks-met"]
    assert looked and all("SortMergeJoin" in p and "BroadcastHashJoin" not in p for p in looked)


def test_ranks_over_parts(spark):
    rows = [(i, (i * 37) % 101) for i in range(2000)]
    df = spark.createDataFrame(rows, "id long, x long").repartition(8)
    got = {r.id: r.place for r in ranked(df, [F.desc("x"), F.col("id")], "place").collect()}
    want = {i: n + 1 for n, (i, _) in enumerate(sorted(rows, key=lambda r: (-r[1], r[0])))}
    assert got == want


def test_commutator_gradient_and_history(spark):
    raw = spectral.initial_operators(3, 4, 2)
    a = spectral.hermitian(raw)
    value, g = spectral.commutator_gradient(a, 6, 5)
    rng = np.random.default_rng(0)
    for _ in range(5):
        d = spectral.hermitian(rng.normal(size=a.shape) + 1j * rng.normal(size=a.shape))
        up, down = (spectral.commutator_penalty(a + e * d, 6, 5) for e in (1e-6, -1e-6))
        assert (up - down) / 2e-6 == pytest.approx(float((g.conj() * d).sum().real), rel=1e-5)
    assert value == spectral.commutator_penalty(a, 6, 5) < 0
    points = spark.createDataFrame([(i, [float(v) for v in rng.normal(size=2)]) for i in range(40)], "id long, features array<double>")
    _, history = spectral.train(points.where("id >= 8"), points.where("id < 8"), 4, 6, rate=0.02)
    assert [r["step"] for r in history] == list(range(7)) and all(r["held_loss"] > 0 for r in history)
    assert history[-1]["loss"] < history[0]["loss"]


def test_eigen_solver_is_tried_again(monkeypatch):
    a = spectral.hermitian(spectral.initial_operators(2, 3, 0))
    x, k = np.array([[0.3, -0.2]]), spectral.half_squares(a)
    want = spectral.eigen(x, a, k)[0]
    solve, calls = np.linalg.eigh, []

    def failing(h):
        calls.append(1)
        if len(calls) < 3:
            raise np.linalg.LinAlgError
        return solve(h)

    monkeypatch.setattr(np.linalg, "eigh", failing)
    assert np.allclose(spectral.eigen(x, a, k)[0], want, atol=1e-7) and len(calls) == 3
