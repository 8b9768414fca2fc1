"""Repeated substrings against a plain count of all of them."""

from __future__ import annotations

import collections
import hashlib
import random

import numpy as np
import pytest

from chronomesh.llm import suffixes


def counted(texts, t):
    """For each text: maximal runs of bytes under a string of t bytes that starts twice anywhere."""
    n = collections.Counter(x[p : p + t] for x in texts for p in range(len(x) - t + 1))
    out = []
    for x in texts:
        covered = np.zeros(len(x) + 2, np.int64)
        for p in range(len(x) - t + 1):
            if n[x[p : p + t]] > 1:
                covered[p + 1] += 1
                covered[p + t + 1] -= 1
        on = np.cumsum(covered) > 0
        edges = np.flatnonzero(on[1:] != on[:-1])
        out.append(list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True)))
    return out


def corpus(rng, n, t, letters="abcdefghij "):
    text = lambda size: "".join(rng.choice(letters) for _ in range(size))
    shared, texts = [text(rng.randint(t - 3, 3 * t)) for _ in range(4)], []
    for _ in range(n):
        kind = rng.random()
        if texts and kind < 0.15:
            texts.append(rng.choice(texts))
        elif texts and kind < 0.3:
            old = list(rng.choice(texts))
            for _ in range(rng.randint(1, 3)):
                if old:
                    old[rng.randrange(len(old))] = rng.choice("XYZé")
            texts.append("".join(old))
        elif kind < 0.4:
            texts.append(text(rng.randint(1, 7)) * rng.randint(1, 4 * t // 3))
        else:
            texts.append("".join(rng.choice([text(rng.randint(0, 2 * t)), rng.choice(shared), rng.choice(shared)[rng.randint(0, 9) :]]) for _ in range(rng.randint(0, 4))))
    return texts


def test_owners_belong_to_the_window(monkeypatch):
    """Equal windows have their owner at the same offset, whatever stands around them; pieces of a text join without a seam."""
    rng = random.Random(5)
    x, t = bytes(rng.randrange(97, 100) for _ in range(3000)) + b"a" * 300 + bytes(rng.randrange(256) for _ in range(900)), 40
    ((own, first, last),) = suffixes.anchors_of([x], t)
    by_window = np.repeat(own, last - first + 1)
    assert len(by_window) == len(x) - t + 1
    for p in range(0, len(by_window), 7):
        assert suffixes.owners(np.frombuffer(x[p : p + t], np.uint8), t)[0] == by_window[p] - p
    monkeypatch.setattr(suffixes, "PIECE", 111)
    for a, b in zip(suffixes.anchors_of([x], t)[0], (own, first, last), strict=True):
        assert (a == b).all()


@pytest.mark.parametrize(("t", "seed"), [(20, 1), (33, 2), (200, 3)])
def test_spans_equal_a_count(spark, t, seed):
    texts = corpus(random.Random(seed), 60, t)
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "doc_id long, text string").repartition(5)
    got = {r.doc_id: r for r in suffixes.without_repeats(docs, threshold=t).collect()}
    for i, (x, want) in enumerate(zip(texts, counted([x.encode() for x in texts], t), strict=True)):
        assert [(s.start, s.end) for s in got[i].removed] == want, (i, x)
        raw, at = x.encode(), [0, *(e for s in want for e in s), len(x.encode())]
        assert bytes(got[i].kept) == b"".join(raw[a:b] for a, b in zip(at[::2], at[1::2], strict=True))
    assert sum(bool(r.removed) for r in got.values()) > 20


def test_query(spark, tmp_path):
    rng = random.Random(8)
    letters = [chr(c) for c in (*range(97, 123), 0xE9, 0x4E2D, 0x1F600)]
    passage = "".join(rng.choice(letters) for _ in range(400))
    own = lambda n: "".join(rng.choice(letters) for _ in range(n))
    docs = [(i, own(rng.randint(0, 300)) + passage[rng.randint(0, 60) : 400 - rng.randint(0, 60)] + own(rng.randint(0, 300))) for i in range(40)]
    docs += [(100, None), (101, ""), (102, "q" * 199), (103, "z" * 5000), (104, own(3000)), (None, own(500)), (105, (p := own(210)) + "-" + p), (106, own(199))]
    docs += [(7, docs[7][1]), (7, docs[8][1]), (None, None)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = [tuple(r) for r in suffixes.op12_suffix_array(spark, str(tmp_path)).collect()]
    raw = [(x or "").encode() for _, x in docs]
    want = []
    for (doc_id, _), x, runs in zip(docs, raw, counted(raw, 200), strict=True):
        at = [0, *(e for s in runs for e in s), len(x)]
        kept = b"".join(x[a:b] for a, b in zip(at[::2], at[1::2], strict=True))
        want.append((doc_id, len(x), len(x) - len(kept), len(runs), hashlib.sha256(kept).hexdigest()))
    assert sorted(got, key=str) == sorted(want, key=str)
    assert [r for r in got if r[0] == 105][0][1:4] == (len(raw[46]), len(raw[46]) - 1, 2)


def test_hot_string_with_many_borders(spark):
    """One passage in every document, each time cut at other places: no two contexts are alike, yet all is found."""
    rng = random.Random(3)
    passage = bytes(rng.randrange(97, 123) for _ in range(120)).decode()
    own = lambda n: "".join(chr(rng.randrange(97, 123)) for _ in range(n))
    texts = [own(rng.randint(5, 60)) + passage[a : a + rng.randint(30, 60)] + own(rng.randint(5, 60)) for a in (rng.randint(0, 60) for _ in range(300))]
    docs = spark.createDataFrame([(x, i) for i, x in enumerate(texts)], "body string, KEY long")
    got = {r.KEY: [(s.start, s.end) for s in r.removed] for r in suffixes.without_repeats(docs, "body", 30).collect()}
    assert [got[i] for i in range(300)] == counted([x.encode() for x in texts], 30)


def test_names_and_empty_tables(spark):
    docs = spark.createDataFrame([("x" * 50, 1, 2, 3, 4)], "text string, Removed int, kept int, key int, of int")
    found = suffixes.without_repeats(docs, threshold=20)
    assert found.columns == [*docs.columns, "_removed", "_kept"]
    assert [(s.start, s.end) for s in found.first()["_removed"]] == [(0, 50)]
    assert suffixes.without_repeats(docs.limit(0)).count() == 0
    with pytest.raises(ValueError, match="threshold"):
        suffixes.without_repeats(docs, threshold=1)
