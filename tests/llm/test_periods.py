"""Periodic runs against a plain scan, text by text."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

from hypothesis import given, settings
from hypothesis import strategies as st

from chronomesh.llm import periods

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def scanned(ws, least=24, repeats=3):
    found = {}
    for q in range(1, len(ws) // repeats + 1):
        i = 0
        while i + q < len(ws):
            j = i
            while j + q < len(ws) and ws[j] == ws[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, repeats * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def periodic(rng, size=6):
    ws = []
    for _ in range(rng.randint(0, size)):
        cycle = [rng.choice("abcd") for _ in range(rng.randint(1, 12))]
        ws += (cycle * 20)[: rng.randint(1, 90)] if rng.random() < 0.6 else [rng.choice("abcdef") for _ in range(rng.randint(0, 20))]
    return ws


def test_runs_equal_a_scan(monkeypatch):
    rng = random.Random(4)
    for _ in range(300):
        monkeypatch.setattr(periods, "PAIRS", rng.choice([1, 9, 1 << 20]))
        texts = [[w.encode() for w in periodic(rng)] for _ in range(rng.randint(1, 4))]
        assert periods.runs_of(texts) == [scanned(ws) for ws in texts]
        assert periods.runs_of(texts, 6, 2) == [scanned(ws, 6, 2) for ws in texts]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([b"x", b"y"]), max_size=90))
def test_runs_of_two_words(ws):
    assert periods.runs_of([ws]) == [scanned(ws)]


def test_hash_collisions_are_searched_again(monkeypatch):
    """A first base under which all words have one code: verification finds out and another base is taken."""
    real, bases = periods.candidates, []

    def lying(codes, starts, sizes, least, repeats, base, prime):
        bases.append(base)
        return real(codes * 0 if len(bases) == 1 else codes, starts, sizes, least, repeats, base, prime)

    monkeypatch.setattr(periods, "candidates", lying)
    ws = [str(i).encode() for i in range(40)] + [b"a", b"b"] * 15
    assert periods.runs_of([ws]) == [[(40, 30, 2)]]
    assert len(bases) == 2 and bases[0] != bases[1]


def test_thue_morse_words_have_no_run():
    """Sequences that collide modulo 2^64 whatever the base."""
    ws = [b"ab"[bin(i).count("1") % 2 :][:1] for i in range(1 << 13)]
    assert periods.runs_of([ws, [b"c"] * 30]) == [[], [(0, 30, 1)]]
    assert scanned(ws[:2000]) == []


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from([3, 7, 2**63 + 5]), min_size=1, max_size=90))
def test_prime_hashes_extend_like_words(codes):
    sizes = periods.np.array([len(codes)])
    found = periods.candidates(periods.np.array(codes, periods.np.uint64), sizes * 0, sizes, 24, 3, 123456789, periods.PRIME)
    assert sorted(map(tuple, found[:, 1:].tolist()), key=lambda r: (r[0], r[2])) == scanned(codes)


def test_best_run():
    assert periods.best([]) is None
    assert periods.best([(0, 24, 8), (5, 30, 10), (40, 36, 12)]) == (0, 24, 8)
    assert periods.best([(0, 25, 8), (40, 100, 30)]) == (40, 100, 30)


def expected(doc_id, text):
    ws = WORD.findall(text or "")
    n, h = len(ws), zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        ws = ws[:a] + [ws[a + (i - a) % p] for i in range(a, n)]
    runs = scanned(ws)
    top = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
    drop = {i for s, m, q in runs for i in range(s + q, s + m)}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    kept = sha(" ".join(w for i, w in enumerate(ws) if i not in drop))
    return (doc_id, len(runs), *(top or (None,) * 3), 1000 * top[1] // top[2] if top else None, sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), kept)


def test_query(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(periods, "WORDS", 50)
    rng = random.Random(9)
    docs = [(i, rng.choice([" ", "\n", "\x0b \t", "  "]).join(periodic(rng) or ["x"])) for i in range(150)]
    docs += [(200, None), (201, ""), (202, " \n\t"), (None, "u v " * 30), (None, None), (203, "a b\x1cc " * 40), (204, "w " * 9000), (205, " ".join(map(str, range(5000))))]
    docs += [(3, docs[3][1]), (3, "other " * 24)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = [tuple(r) for r in periods.op11_periodic_runs(spark, str(tmp_path)).collect()]
    want = [expected(*d) for d in docs]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert sum(r[1] > 0 for r in got) > 40


def test_columns_with_names_that_clash(spark):
    docs = spark.createDataFrame([("kept", [1], "z " * 30)], "RUNS string, best_run array<int>, body string")
    found = periods.periodic_runs(docs, "body")
    assert found.columns == ["RUNS", "best_run", "body", "_runs", "_best_run", "collapsed"]
    row = found.first()
    assert row["RUNS"] == "kept" and row["_best_run"].asDict() == {"start": 0, "length": 30, "period": 1} and row["collapsed"] == "z"
    assert periods.periodic_runs(docs.limit(0), "body").count() == 0
