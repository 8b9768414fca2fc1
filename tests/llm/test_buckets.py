"""Classes of items that share buckets of any size, against all pairs."""

from __future__ import annotations

import numpy as np
import pytest

from chronomesh.llm import buckets, lines


def family(pairs: int, seed: int) -> list[bytes]:
    """Lines of one template with six places of four values: each is alike to its twin, which differs in one place, and to no other. Every shingle is held by many lines."""
    rng = np.random.default_rng(seed)
    word = lambda n: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), n))
    fixed, values = [word(15) for _ in range(6)], [[word(6) for _ in range(4)] for _ in range(6)]
    codes: list[np.ndarray] = []
    while len(codes) < 2 * pairs:
        a = rng.integers(0, 4, 6)
        b = a.copy()
        b[rng.integers(6)] = (b[rng.integers(6)] + rng.integers(1, 4)) % 4
        if (a != b).sum() == 1 and all((c != x).sum() >= 2 for c in codes for x in (a, b)):
            codes += [a, b]
    return ["".join(f + v[c] for f, v, c in zip(fixed, values, code, strict=True)).encode() for code in codes]


def brute(texts: list[bytes]) -> set[frozenset[int]]:
    sets, up = [lines.shingles(t) for t in texts], list(range(len(texts)))
    for j in range(len(texts)):
        for i in range(j):
            if buckets.similarity_of(sets[i], sets[j]) >= 0.8:
                up = [up[i] if x == up[j] else x for x in up]
    return {frozenset(i for i, x in enumerate(up) if x == r) for r in set(up) if up.count(r) > 1}


@pytest.mark.parametrize("large", [4096, 50])
def test_no_link_of_a_shared_bucket_is_lost(spark, monkeypatch, large):
    """All lines have one key: the star finds one pair, and no later key tells them apart. large 50: the bucket and those of its shingles are cut into blocks."""
    monkeypatch.setattr(buckets, "LARGE", large)
    texts = family(80, 3)
    rows = spark.createDataFrame([(i, bytearray(t)) for i, t in enumerate(texts)], "item long, text binary")
    table = spark.createDataFrame([(i, [32]) for i in range(len(texts))], "item long, keys array<long>")
    found: dict[int, set[int]] = {}
    for r in buckets.classes(table, lambda wanted: rows.join(wanted, "item"), lines.shingles, 0.8).collect():
        found.setdefault(r.root, set()).add(r.node)
    want = brute(texts)
    assert len(want) == 80
    assert {frozenset(x) for x in found.values() if len(x) > 1} == want


def test_linked_equals_all_pairs():
    rng = np.random.default_rng(5)
    for n in (2, 6, 40, 150):
        words = ["".join(rng.choice(list("abcd"), 4)) for _ in range(12)]
        texts = [" ".join(rng.choice(words, rng.integers(1, 14))).encode() for _ in range(n)]
        texts += [t[: len(t) - 2] + b"zz" for t in texts]
        up = list(range(2 * n))
        for a, b in buckets.linked(list(range(2 * n)), [0] * 2 * n, texts, lines.shingles, 0.8):
            up = [up[a] if x == up[b] else x for x in up]
        assert {frozenset(i for i, x in enumerate(up) if x == r) for r in set(up) if up.count(r) > 1} == brute(texts)


@pytest.mark.parametrize("chunk", [20_000, 5])
def test_members_and_pairs_of_buckets(spark, monkeypatch, chunk):
    """Each item of a key that several have, once, with the key's smallest, also where a bucket goes on in the next Arrow batch; without large keys no chunk is shuffled."""
    monkeypatch.setattr(buckets, "CHUNK", chunk)
    monkeypatch.setattr(buckets, "LOOK", 1)
    shuffled, plain = [], buckets.shared_rows
    monkeypatch.setattr(buckets, "shared_rows", lambda rows: shuffled.append(rows.columns) or plain(rows))
    rng = np.random.default_rng(8)
    own = [(int(i), sorted({int(k) << 5 for k in rng.integers(0, 900, 3)})) for i in rng.permutation(400)]
    table = spark.createDataFrame([*own, *own[:50]], "item long, keys array<long>")  # some twice
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        members, pairs = buckets.met(table)
        members, pairs = members.collect(), {(r.a, r.b, r.root_a, r.root_b) for r in pairs.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    by_key: dict[int, set[int]] = {}
    for item, keys in own:
        for k in keys:
            by_key.setdefault(k, set()).add(item)
    shared = {k: x for k, x in by_key.items() if len(x) > 1}
    got = [(r.key, r.item) for r in members if r.key in shared]
    assert sorted(got) == sorted((k, i) for k, x in shared.items() for i in x)
    if chunk == 5:
        assert shuffled == [["key", "item", "chunk"]]
    else:
        assert shuffled == [["key", "item"]] and len(got) == len(members)
        assert pairs == {(min(x), i, min(x), i) for x in shared.values() for i in x if i != min(x)}
        assert {(r.key, r.item) for r in members if r.done} == {(k, min(x)) for k, x in shared.items()}


def test_keys_leave_out_what_is_no_ones():
    """Hashes of item n, as those of shingles across two lines, change no key; min-hashes are the least of each cell."""
    h = buckets.mixed(np.arange(4000, dtype=np.uint64))
    item = np.arange(4000) % 3  # 2: no one's
    some = item < 2
    keys = buckets.keys_of(h, item, 2, 4)
    assert keys.shape == (2, 15) and (keys == buckets.keys_of(h[some], item[some], 2, 4)).all()
    one = h[item == 1]
    cell = ((one >> np.uint64(40)) * np.uint64(buckets.CELLS)) >> np.uint64(24)
    low = np.uint64((1 << 36) - 1)
    least = np.array([one[np.flatnonzero(cell == c)[np.argmin(one[cell == c] & low)]] for c in range(buckets.CELLS)])
    assert (buckets.keys_of(least, np.zeros(buckets.CELLS, int), 1, 4)[0] == keys[1]).all()
