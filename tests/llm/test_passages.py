"""Windows of one key, however many: everything that is alike around the common minimum is linked."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronomesh.llm import passages


def texts_on_a_template(families: int, seed: int) -> list[list[str]]:
    """Chains of three texts that share a template: each is alike to the next one; a family is alike to no other."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(7))
    left, right, texts = [word() for _ in range(14)], [word() for _ in range(14)], []
    for _ in range(families):
        own, rest = [word() for _ in range(20)], [word() for _ in range(20)]
        for changed in (None, 3, 16):
            own = [word() if i == changed else w for i, w in enumerate(own)]
            texts.append([word() for _ in range(70)] + rest[:10] + left + own + right + rest[10:] + [word() for _ in range(70)])
    return texts


def linked(n: int, pairs: set[tuple[int, int]]) -> set[frozenset[int]]:
    up = list(range(n))
    for a, b in pairs:
        up = [up[a] if x == up[b] else x for x in up]
    return {frozenset(i for i, x in enumerate(up) if x == r) for r in set(up)}


@pytest.mark.parametrize("large", [4096, 7])
def test_no_link_of_a_key_is_lost(spark, monkeypatch, large):
    """All windows have one key and no other. large 7: the key is cut into blocks."""
    monkeypatch.setattr(passages, "LARGE", large)
    texts = texts_on_a_template(12, 5)
    h = [(passages.shingles([" ".join(t).encode()])[0] >> np.uint64(32)).astype("<u4") for t in texts]
    c = 82  # a shingle of the template
    assert len({int(x[c]) for x in h}) == 1
    around = [x[c - passages.AROUND : c + passages.AROUND + 1] for x in h]
    want = linked(len(h), {(i, j) for i in range(len(h)) for j in range(i) if passages.alike(around[i], around[j])})
    assert {len(x) for x in want} == {3}
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    windows = [(7, i, int(passages.placed(np.array([c]), np.array([c - 40]), np.array([c - 2]))[0]), 0, c << 12, 0) for i in range(1, len(h))]
    members = spark.createDataFrame(windows, "key long, doc_id long, at long, rep long, rep_at long, chunk int")
    rows = passages.undecided(members, spark.createDataFrame([], passages.PASSAGES))
    assert rows.count() == len(h)
    found = {(r.doc_id, r.twin_id) for r in passages.met_in_full(docs, rows).collect()}
    assert all(a > b for a, b in found)
    assert linked(len(h), found) == want


def test_linked_windows_are_compared_with_open_ones(spark):
    """1 is alike to 0, and 2 to 1 only: that 1 has found 0 doesn't keep it from 2."""
    texts = texts_on_a_template(1, 8)
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    at = int(passages.placed(np.array([82]), np.array([42]), np.array([80]))[0])
    members = spark.createDataFrame([(7, i, at, 0, at, 0) for i in (1, 2)], "key long, doc_id long, at long, rep long, rep_at long, chunk int")
    found = spark.createDataFrame([(1, 60, 140, 0, 60, 140, 0.9)], passages.PASSAGES)
    rows = passages.undecided(members, found)
    assert {(r.doc_id, *r.twins) for r in rows.collect()} == {(0,), (1, 0), (2,)}
    assert (2, 1) in {(r.doc_id, r.twin_id) for r in passages.met_in_full(docs, rows.where(F.col("doc_id") > 0)).collect()}


def test_linking_equals_all_pairs():
    """Random texts of few words, many of them with repeated shingles: as connected as by all pairs."""
    rng = np.random.default_rng(3)
    for n in (5, 40, 90):
        base = rng.integers(0, 1 << 32, (6, 117)).astype("<u4")
        rows = []
        for _ in range(n):
            x = base[rng.integers(6)].copy()
            cut = rng.integers(20, 100)
            x[cut:] = base[rng.integers(6), cut:] if rng.random() < 0.5 else rng.integers(0, 1 << 32, 117 - cut)
            x[rng.integers(0, 117, rng.integers(0, 12))] = x[0]
            rows.append(x)
        pairs = {(i, j) for i in range(n) for j in range(i) if passages.alike(rows[i], rows[j])}
        found = set()

        def compare(i, j):
            if (i, j) in pairs:
                found.add((i, j))  # noqa: B023
            return (i, j) in pairs  # noqa: B023

        passages.joined(list(range(n)), [[]] * n, [0] * n, [x.tobytes() for x in rows], compare)
        assert linked(n, found) == linked(n, pairs)


def test_a_stretch_is_told_by_its_distinct_shingles():
    """holds equals a count of every stretch, and a shingle that stands again and again brings no comparison."""
    rng = np.random.default_rng(4)
    for n in (46, 70, 117):
        row = rng.integers(0, 30, n).astype("<u4")
        hit = np.array([np.isin(row, rng.choice(30, size, replace=False)) for size in range(15, 30)])
        want = [any(h[s] and h[e] and len(set(row[s : e + 1][h[s : e + 1]])) >= 4 * len(set(row[s : e + 1][~h[s : e + 1]])) for s in range(n) for e in range(s + passages.LEAST - 1, n)) for h in hit]
        assert passages.holds(hit, row).tolist() == want and len(set(want)) == (2 if n > 46 else len(set(want)))
    for n in (6, 40):
        rows = [np.concatenate([np.full(35, 7), 100 * i + np.arange(32) % 6 + 10, np.full(35, 7), 100 * i + np.arange(15) + 20]).astype("<u4").tobytes() for i in range(n)]
        seen = []
        passages.joined(list(range(n)), [[]] * n, [0] * n, rows, lambda i, j: seen.append((i, j)) or False)  # noqa: B023
        assert not seen


def test_words_have_one_hash_each():
    texts = ["Ab  cd\tef\x0bgh ij", "ab cd ef gh ij kl", "", None, " x ", "é à b c d e"]
    h, n = passages.word_hashes([x if x is None else x.encode() for x in texts])
    words = [w.lower() for x in texts for w in (x or "").encode().split()]
    assert n.tolist() == [len((x or "").encode().split()) for x in texts]
    assert len(set(zip(h.tolist(), words, strict=True))) == len(set(words)) == len(set(h.tolist()))


def on_one_word(seed: int) -> list[str]:
    """Texts that repeat one word: the first two 60 times, as passages of one shingle, thirty others 8 to 30 times."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(7))
    own = lambda n: [word() for _ in range(n)]
    return [" ".join(own(60) + ["the"] * n + own(60)) for n in [*(rng.randint(8, 30) for _ in range(30)), 60, 60]]


@pytest.mark.parametrize("large", [4096, 7])
def test_texts_of_open_windows_travel_once(spark, monkeypatch, large):
    """Windows of a document around one repeated word, under all hash functions, are few rows, also where their key is cut into blocks; nothing alike is lost."""
    monkeypatch.setattr(passages, "LARGE", large)
    texts, sent = on_one_word(9), []
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    send = passages.surroundings
    monkeypatch.setattr(passages, "surroundings", lambda *x: sent.append(send(*x)) or sent[-1])
    members, _ = passages.met(passages.window_table(docs))
    rows = passages.undecided(members, spark.createDataFrame([], passages.PASSAGES))
    assert rows.count() > 200
    found = {(r.doc_id, r.twin_id) for r in passages.met_in_full(docs, rows).collect()}
    size = sent[0].agg(F.sum(F.length("h"))).first()[0]
    assert size < 2 * 4 * sum(len(t.split()) for t in texts)
    # a run of 60 is alike to any run: as a set it is one shingle
    assert linked(len(texts), found) == linked(len(texts), {(30, j) for j in range(30)} | {(31, 30)})


def test_elsewhere_and_fewest():
    rng = np.random.default_rng(6)
    for _ in range(50):
        of, doc = rng.integers(0, 12, 40), np.sort(rng.integers(0, 5, 40))
        assert passages.elsewhere(np.unique(of, return_inverse=True)[1], doc).tolist() == [len(set(doc[of == x])) > 1 for x in of]
    x = np.repeat(np.arange(9), [30, 1, 1, 1, 5, 1, 1, 1, 1])
    assert passages.fewest(x) == 4 and passages.fewest(np.zeros(60)) == 1 and passages.fewest(np.arange(50)) == passages.NEED


def test_a_pair_that_differences_rule_out_early(monkeypatch):
    """Texts of words changed, put in and left out: what the bound rules out, the whole comparison doesn't find."""
    rng, outcomes = np.random.default_rng(8), []
    for _ in range(400):
        a = rng.integers(0, 1 << 32, rng.integers(46, 120)).astype("<u4")
        b = a
        for _ in range(rng.integers(1, 7)):
            at = rng.integers(0, len(b))
            b = np.concatenate([b[:at], rng.integers(0, 1 << 32, rng.integers(0, 7)).astype("<u4"), b[at + rng.integers(1, 7) :]])
        spans = [(s, e) for s in range(len(a)) for e in range(s + passages.LEAST, len(a) + 1)]
        row = {x: i for i, x in enumerate(b.tolist())}
        hits = [row.get(x, -1) for x in a.tolist()]
        best = 0.0
        for s, e in spans:
            if hits[s] >= 0 and hits[e - 1] >= 0:
                common, other = sum(h >= 0 for h in hits[s:e]), hits[e - 1] - hits[s] + 1
                best = max(best, common / (e - s + other - common))
        outcomes.append(best >= passages.SIMILARITY)
        assert bool(passages.alike(a, b)) == outcomes[-1]
    assert 50 < sum(outcomes) < 350
