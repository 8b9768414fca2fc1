"""Mode catalogue, divergence, draws, written tables and the scan grid against plain Python."""

from __future__ import annotations

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from chronomesh.operators import catalogue, joins, ordinal, partition, sweep, tasks
from chronomesh.sources import signals

MEMBERS = "mode long, channel string, tag string, dist double"


def listed(spark, n, seed):
    """Members of which mode 0 holds a third; some channels have a blank in their name, some aren't listed, some tags name no scale."""
    rng = random.Random(seed)
    rows = [(0 if i % 3 == 0 else rng.randrange(1, 6), f"MEG {rng.randrange(12)}", rng.choice(["w_0.250s_m4", "w_1.5s_m5", "w_2.0s_m6", "odd"]), float(rng.randrange(50))) for i in range(n)]
    sensors = [("MEG0", "front", "mag"), ("MEG 0", "zone", "grad"), *((f"MEG{c}", ["front", "left", "right"][c % 3], "grad") for c in range(1, 9))]
    return rows, catalogue.enriched(spark.createDataFrame(rows, MEMBERS), spark.createDataFrame(sensors, "channel string, roi string, kind string"))


def plain(rows):
    of = {f"MEG {c}": ["front", "left", "right"][c % 3] for c in range(1, 9)} | {"MEG 0": "front"}
    scale = {"w_0.250s_m4": 0.25, "w_1.5s_m5": 1.5, "w_2.0s_m6": 2.0, "odd": 0.0}
    return [(mode, scale[tag], of.get(c, "Unknown"), c, dist) for mode, c, tag, dist in rows]


def evenness(counts, bins):
    n = sum(counts)
    return -sum(c / n * math.log2(c / n) for c in counts) / math.log2(bins) if n and bins > 1 else 0.0


def test_catalogue_equals_a_plain_loop(spark):
    rows, members = listed(spark, 400, 1)
    whole = plain(rows)
    got = {r["mode"]: r for r in catalogue.catalogue(members, 8).collect()}
    assert sorted(got) == list(range(8)) and (got[7].total, got[7].archetype, got[7].scale_entropy) == (0, None, 0.0)
    for mode in range(6):
        own = [r for r in whole if r[0] == mode]
        scales, rois = Counter(r[1] for r in own), Counter(r[2] for r in own if r[2] != "Unknown")
        low, archetype = min((r[4], r[3]) for r in own)
        r = got[mode]
        assert (r.total, r.archetype, r.low) == (len(own), archetype, low)
        assert r.dominant_scale == min(scales, key=lambda x: (-scales[x], x)) and r.dominant_roi == min(rois, key=lambda x: (-rois[x], x))
        assert r.scale_entropy == pytest.approx(evenness(scales.values(), 4)) and r.roi_entropy == pytest.approx(evenness(rois.values(), 3))


def test_composition_equals_a_plain_loop(spark):
    rows, members = listed(spark, 300, 2)
    whole = plain(rows)
    got = catalogue.composition(members).collect()
    for level, place in (("roi", 2), ("channel", 3), ("scale", 1)):
        mine = {(r["mode"], r[level]): r for r in got if r.level == level}
        assert mine.keys() == {(r[0], r[place]) for r in whole}
        for (mode, value), r in mine.items():
            own = [x for x in whole if x[0] == mode and x[place] == value]
            assert (r.n, r.channels, r.low) == (len(own), len({x[3] for x in own}), min(x[4] for x in own))
            assert r.mean_dist == pytest.approx(sum(x[4] for x in own) / len(own))
    assert sum(r.n for r in got) == 3 * len(rows)


def test_catalogue_of_nulls_ties_and_nothing(spark):
    sensors = spark.createDataFrame([("a", "x", "mag")], "channel string, roi string, kind string")
    of = lambda rows: catalogue.enriched(spark.createDataFrame(rows, MEMBERS), sensors)
    assert catalogue.catalogue(of([])).count() == 0 and catalogue.composition(of([])).count() == 0
    assert [(r.total, r.scale_entropy) for r in catalogue.catalogue(of([]), 2).collect()] == [(0, 0.0)] * 2
    rows = [(1, "b", "w_1.0s_m3", 2.0), (1, "a", "w_1.0s_m3", 2.0), (1, "a", "w_1.0s_m3", None), (2, None, None, None)]
    got = {r["mode"]: r for r in catalogue.catalogue(of(rows)).collect()}
    assert (got[1].archetype, got[1].low, got[1].total, got[1].dominant_roi) == ("a", 2.0, 3, "x")
    assert (got[2].archetype, got[2].low, got[2].total, got[2].dominant_roi, got[2].dominant_scale) == (None, None, 1, None, 0.0)


def test_divergence(spark):
    rows = [([1.0, 0.0], [0.0, 1.0]), ([0.5, 0.5], [0.5, 0.5]), ([0.75, 0.25], [0.5, 0.5])]
    df = spark.createDataFrame(rows, "p array<double>, q array<double>")
    got = [r.d for r in df.select(ordinal.jensen_shannon(F.col("p"), F.col("q")).alias("d")).collect()]
    h = lambda x: -sum(v * math.log2(v) for v in x)
    assert got == pytest.approx([1.0, 0.0, h([0.625, 0.375]) - h([0.75, 0.25]) / 2 - 0.5])


def test_empty_cells_take_the_farthest_objects(spark):
    objects = spark.createDataFrame([(i, [float(x)]) for i, x in enumerate((0, 1, 2, 30, 50))], "id long, v array<double>")
    centres = spark.createDataFrame([(0, [0.0]), (1, [900.0]), (2, [-900.0]), (3, [1.0])], "k long, centre array<double>")
    assigned = partition.assign(objects, centres)
    got = {r.k: r.centre for r in partition.repaired(assigned, partition.means(assigned), 4).collect()}
    assert got == {0: [0.0], 1: [50.0], 2: [30.0], 3: [pytest.approx(83 / 4)]}


def test_draws_don_t_depend_on_the_partitioning(spark):
    one, many = (signals.manifold_on(spark.range(200).repartition(n), "torus", noise=0.1).orderBy("id").collect() for n in (1, 7))
    assert one == many
    for kind in ("sphere", "circle"):
        points = [r.features for r in signals.manifold(spark, kind, 2000).collect()]
        assert all(sum(x * x for x in p) == pytest.approx(1) for p in points)
        assert all(abs(sum(x) / 2000) < 0.06 for x in zip(*points, strict=True))
    assert signals.manifold(spark, "sphere", 10, seed=1).collect() != signals.manifold(spark, "sphere", 10, seed=2).collect()


def test_names_of_a_marked_log(spark, tmp_path):
    (tmp_path / "log.csv").write_text("﻿onset,label\n1.5,a\n2.5,\n", encoding="utf-8")
    rows = signals.read_log(spark, str(tmp_path / "log.csv"))
    assert rows.dtypes == [("onset", "double"), ("label", "string")] and [tuple(r) for r in rows.collect()] == [(1.5, "a"), (2.5, None)]


def test_a_sweep_is_read_back(spark, tmp_path):
    rng = random.Random(4)
    objects = spark.createDataFrame([(i, [rng.random(), rng.random()]) for i in range(60)], "id long, v array<double>")
    found = sweep.swept(objects, [2, 5])
    sweep.save(found, str(tmp_path / "s"))
    back = sweep.load(spark, str(tmp_path / "s"))
    for name in sweep.TABLES:
        a, b = getattr(found, name), getattr(back, name)
        assert sorted(map(str, a.select(sorted(a.columns)).collect())) == sorted(map(str, b.select(sorted(a.columns)).collect()))
    plan = back.memberships.where("k_clusters = 5")._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "k_clusters#" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_scan_of_three_controls_and_ten_others_has_41_tasks(spark):
    rows = [(f"s{i}", "control" if i < 3 else "other", False, 0) for i in range(13)]
    got = tasks.planned(spark.createDataFrame(rows, "source string, kind string, reference boolean, samples int"), tasks.SCAN).collect()
    assert len(got) == 41 == len({(r.source, r.states) for r in got})


def test_names_in_texts_against_a_loop(spark):
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("ab ") for _ in range(n))
    texts = [(i, word(rng.randint(0, 9))) for i in range(120)] + [(200, None), (201, "")]
    names = [(word(rng.randint(2, 4)) + "c" * (i % 2), f"s{i}", i) for i in range(12)] + [(None, "none", 50)]
    found = joins.containing(spark.createDataFrame(texts, "id int, text string"), spark.createDataFrame(names, "name string, subject string, place int"), "text", "name", "subject", "place")
    got = {r.id: r.subject for r in found.collect()}
    want = {i: next((s for n, s, _ in names if n is not None and t is not None and n.strip(" ") in t), None) for i, t in texts}
    assert got == want and None in got.values() and len(set(got.values())) > 3
    none = joins.containing(spark.createDataFrame(texts, "id int, text string"), spark.createDataFrame([], "name string, subject string, place int"), "text", "name", "subject", "place")
    assert {r.subject for r in none.collect()} == {None}


def test_windows_of_a_rate_equal_the_grid(spark):
    seconds = [0.2 + k * 4.8 / 49 for k in range(50)]
    for rate in (200.0, 1000.0, 2048.0):
        rows = ordinal.with_windows(spark.createDataFrame([(1, rate)], "id int, rate double"), "rate", seconds).orderBy("seconds").collect()
        assert [(r.w, r.seconds, r.m) for r in rows] == ordinal.window_grid(rate, seconds)


def test_registries_hold_a_key_once(spark):
    with pytest.raises(ValueError, match="twice"):
        signals.registered(spark.range(3), [(1, "a"), (1, "b")], "id", "code long, name string")
    rows = signals.registered(spark.range(3), [(1, "a")], "id", "code long, name string").collect()
    assert sorted((r.id, r.name) for r in rows if r.name) == [(1, "a")] and len(rows) == 3


def test_task_families_of_recordings_and_synthetic_sources(spark):
    """Sources of the usual shape: every source has its plain task, and each family adds tasks to its own kind only, none twice."""
    sources = [(f"r{i}", "recorded", i < 2, 0) for i in range(17)] + [(f"s{i}", "synthetic", i < 2, 2000) for i in range(6)]
    rows = tasks.planned(spark.createDataFrame(sources, "source string, kind string, reference boolean, samples int")).collect()
    keys = [(r.source, r.states, r.delays, r.delay_ms, r.scaling, r.variance_weight, r.fixed_states) for r in rows]
    assert len(keys) == len(set(keys)) and {k[0] for k in keys} == {s[0] for s in sources}
    per = {s: sum(k[0] == s for k in keys) for s, *_ in sources}
    assert all(per[f"r{i}"] == 2 for i in range(2, 17)) and all(per[f"s{i}"] == 1 for i in range(2, 6))
    assert all(k[2] == 1 and k[3] == 0.0 for k in keys if k[0].startswith("s"))
    # two scalings, two more delays, one weight, nine plain numbers of states, ten more delayed ones, held states
    assert all(per[f"r{i}"] == 2 + 2 + 1 + 9 + 10 + 1 for i in range(2)) and all(per[f"s{i}"] == 6 for i in range(2))
