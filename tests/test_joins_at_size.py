"""Joins whose rows must not multiply before they are shuffled, against loops."""

from __future__ import annotations

import random
import re

import pytest

from chronomesh.operators import joins


@pytest.mark.parametrize("few", [64, 3])
def test_names_in_texts_keep_repeated_rows(spark, monkeypatch, few):
    """few 3: the names are more than are looked for in the row. Rows that are equal stay as many as they are."""
    monkeypatch.setattr(joins, "FEW_NAMES", few)
    texts = [(1, "abcab"), (1, "abcab"), (2, "xx"), (3, None), (3, None), (4, "cb")]
    names = [("ab", "s0", 3), (" b", "s1", 2), ("c ", "s2", 1), ("zz", "s3", 0), ("ab", "s4", 4), ("x", "s5", 5)]
    found = joins.containing(spark.createDataFrame(texts, "id int, text string"), spark.createDataFrame(names, "name string, subject string, place int"), "text", "name", "subject", "place")
    assert sorted(map(str, found.collect())) == sorted(f"Row(id={i}, text={t!r}, subject={s!r})" for (i, t), s in zip(texts, ("s2", "s2", "s5", None, None, "s2"), strict=True))
    if few == 64:
        assert not re.search(r"hashpartitioning\((id|text)", found._jdf.queryExecution().executedPlan().toString())


@pytest.mark.parametrize("chunk", [4, 1 << 16])
def test_lagged_against_a_loop(spark, chunk):
    """With gaps, repeated and negative indices and nulls; the right side is shuffled once, not once for each lag."""
    rng = random.Random(2)
    left = [(c, i, rng.choice([None, 1.5, float(i)])) for c in ("a", "b", None) for i in rng.choices(range(-9, 40), k=30)]
    right = [(c, i, None if i is None else i * 10) for c in ("a", "b", "c", None) for i in rng.choices([*range(-9, 40), None], k=30)]
    found = joins.lagged(spark.createDataFrame(left, "channel string, i long, x double"), spark.createDataFrame(right, "channel string, i long, s int"), "channel", "i", -2, 5, chunk)
    want = [(c, j, s, j - i, x) for c, i, s in right for d, j, x in left if c is not None and c == d and i is not None and -2 <= j - i <= 5]
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, want)) and len(want) > 100
    assert found.columns == ["channel", "i", "s", "lag", "x"] and dict(found.dtypes)["lag"] == "int"
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate explode(_met") < plan.index("Window")
