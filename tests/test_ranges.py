"""Order by ranges: one channel over many tasks gives what a sweep over it gives."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronomesh.operators import ranges, sequences


def swept(events, distance):
    """events of one channel by index → those kept."""
    held, kept = None, []
    for i, x in sorted(events, key=lambda e: e[0]):
        if held is None or i - held[0] >= distance:
            if held is not None:
                kept.append(held)
            held = (i, x)
        elif x > held[1]:
            held = (i, x)
    return kept + [held] if held else kept


@pytest.mark.parametrize("seed", range(4))
def test_maps_equal_a_sweep(seed):
    """Any cut of a channel, followed from map to map."""
    rng = random.Random(seed)
    for _ in range(300):
        n, distance = rng.randint(1, 40), rng.choice([1, 3, 10, 100])
        i = np.array(sorted(rng.sample(range(150), n)))
        x = np.array([rng.choice([1.0, 2.0, 3.0, 4.0, 5.0]) for _ in range(n)]) if seed else np.ones(n)
        end = ranges.ends(ranges.steps(i, x, distance))
        for j in range(n):
            held = (i[j], x[j])
            for a, b in zip(i[j + 1 :], x[j + 1 :], strict=True):
                held = (a, b) if a - held[0] >= distance or b > held[1] else held
            assert held == (i[end[j]], x[end[j]])


@pytest.mark.parametrize(("distance", "seed"), [(7, 1), (60, 2), (5000, 3)])
def test_one_channel_in_many_ranges(spark, distance, seed):
    rng = random.Random(seed)
    events = {k: [(i, float(rng.randint(0, 9))) for i in rng.sample(range(6000), 1500 if k == "a" else 5)] for k in ("a", "b", None)}
    df = spark.createDataFrame([(k, i, x) for k, rows in events.items() for i, x in rows] + [("a", None, 1.0), ("b", 3, None)], "k string, i long, x double")
    cut = ranges.ranged(df.where("k = 'a'"), ["k"], [F.col("i")], 60)
    assert cut.select(ranges.PART).distinct().count() >= 50
    got = [(r.k, r.i, r.x) for r in ranges.spaced(df, "k", "i", "x", distance, 60).collect()]
    want = [(k, *e) for k, rows in events.items() for e in swept(rows, distance)]
    assert sorted(got, key=str) == sorted(want, key=str)
    flat = sorted((r.k, r.i) for r in sequences.refractory(df.where("k IS NOT NULL"), "k", "i", distance).collect())
    assert flat == sorted((k, i) for k in "ab" for i, _ in swept([(i, 0) for i, _ in events[k]] + ([(3, 0)] if k == "b" else []), distance))


def test_dense_channel_without_gaps(spark):
    """Every sample is an event, so nothing resets the state between ranges."""
    df = spark.range(3000).select(F.lit(1).alias("k"), F.col("id").alias("t"))
    got = sorted(r.t for r in ranges.spaced(df.withColumn("x", F.lit(0)), "k", "t", "x", 7, 64).collect())
    assert got == list(range(0, 3000, 7))


@pytest.mark.parametrize("parts", [1, 50])
def test_ranks_and_quantiles(spark, parts):
    rng = np.random.default_rng(3)
    rows = [("a", float(v)) for v in rng.integers(0, 40, 900)] + [("b", float(v)) for v in rng.standard_normal(7)] + [("c", 2.5), (None, 1.0), (None, 4.0), ("d", None)]
    df = spark.createDataFrame([(i, k, x) for i, (k, x) in enumerate(rows)], "id long, k string, x double")
    got = {(r.k, r.q): r.x for r in ranges.quantiles(df, ["k"], "x", [0.0, 0.5, 0.9, 0.999, 1.0], parts).collect()}
    for k in ("a", "b", "c", None):
        x = [v for kk, v in rows if kk == k]
        for q in (0.0, 0.5, 0.9, 0.999, 1.0):
            assert np.isclose(got.pop((k, q)), np.quantile(x, q), rtol=1e-14)
    assert not got  # d has no values
    found = ranges.key_ranks(df, ["k"], [F.col("x"), F.col("id")], "r", "n", parts).collect()
    assert len(found) == len(rows)
    for k in ("a", "b", "c", "d", None):
        own = sorted((r for r in found if r.k == k), key=lambda r: r.r)
        assert [r.r for r in own] == list(range(1, len(own) + 1)) and {r.n for r in own} == {len(own)}
        assert [(r.x is not None, r.x or 0, r.id) for r in own] == sorted((r.x is not None, r.x or 0, r.id) for r in own)


@pytest.mark.parametrize("parts", [1, 50])
def test_following(spark, parts):
    rng = random.Random(4)
    grid = [(k, t, n) for k in "ab" for n, t in enumerate(sorted(rng.sample(range(1000), 30)))] + [("z", 5, 0), ("a", None, 77)]
    events = [(rng.choice("abcz"), rng.randrange(-5, 1100)) for _ in range(300)] + [("a", None)]
    of = ranges.following(spark.createDataFrame(events, "k string, e long"), spark.createDataFrame(grid, "k string, t long, n long"), "k", "e", "t", "n", parts)
    want = [(k, e, min((t, n) for kk, t, n in grid if kk == k and t is not None and t >= e)[1] if any(kk == k and t is not None and t >= e for kk, t, _ in grid) else None) for k, e in events if e is not None]
    assert sorted(map(tuple, of.collect()), key=str) == sorted(want, key=str)


def test_empty(spark):
    none = spark.createDataFrame([], "k string, i long, x double")
    assert ranges.spaced(none, "k", "i", "x", 3).count() == 0
    assert ranges.quantiles(none, ["k"], "x", [0.5]).count() == 0
    assert ranges.key_ranks(none, ["k"], [F.col("i")], "r", "n").count() == 0
    assert ranges.following(none, none.withColumnRenamed("x", "n"), "k", "i", "i", "n").count() == 0
