"""The keys of the near-dedup stage: distances of fingerprints of a text's parts to pivots."""

from __future__ import annotations

import numpy as np
import pytest

from chronomesh.llm import simhash


def keys_by_text(h: list[np.ndarray]) -> list[set[int]]:
    keys, counts = simhash.part_keys(np.concatenate(h), np.array([len(x) for x in h]))
    assert len(keys) == counts.sum() and len(counts) == len(h)
    return [set(x.tolist()) for x in np.split(keys, np.cumsum(counts)[:-1])]


def drawn(rng: np.random.Generator, n: int) -> np.ndarray:
    return rng.integers(0, 2**64, n, dtype=np.uint64)


@pytest.mark.parametrize("n", [4, 9, 20, 41, 80, 81, 160, 190, 330, 1500])
def test_alike_texts_meet(n):
    """Of pairs at a similarity of just 0.8, one longer or each with shingles of its own, nearly all have a common key; others have none."""
    rng, texts = np.random.default_rng(n), []
    for i in range(300):
        common = drawn(rng, n)
        own = n // 4
        split = own // 2 if i % 2 else own
        texts += [np.concatenate([common, drawn(rng, own - split)]), np.concatenate([common, drawn(rng, split)])]
    keys = keys_by_text(texts)
    met = [bool(a & b) for a, b in zip(keys[::2], keys[1::2], strict=True)]
    assert np.mean(met) >= 0.995
    assert not any(a & b for a, b in zip(keys[::2], keys[3::2], strict=False))


def test_keys_are_distances_to_pivots(monkeypatch):
    """Two texts have as many common keys as there are parts whose distances to all pivots are equal, by plain Python; other pivots give other keys."""
    rng = np.random.default_rng(3)
    a = drawn(rng, 300)
    b = np.concatenate([a[:270], drawn(rng, 30)])

    def tables(h: np.ndarray) -> set[tuple]:
        found = set()
        for level in range(*(simhash.levels(np.array([len(h) * x]))[0] + y for x, y in ((0.89, 0), (1.12, 1)))):
            parts: dict[int, list[int]] = {}
            for x, place in zip(h.tolist(), simhash.mixed(h).tolist(), strict=True):
                parts.setdefault(place >> (64 - level), []).append(x)
            for part, own in parts.items():
                if part < 32 and len(own) >= 3:
                    fp = sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in own) > len(own))
                    blocks = [(fp ^ int(p)) >> 16 * block & 0xFFFF for block in range(4) for p in simhash.pivots()]
                    found.add((level, part, *(x.bit_count() for x in blocks)))
        return found

    keys, want = keys_by_text([a, b]), [tables(a), tables(b)]
    assert [len(x) for x in keys] == [len(x) for x in want]
    assert len(keys[0] & keys[1]) == len(want[0] & want[1]) > 5
    other = simhash.pivots() ^ np.uint64(0x1234567)
    monkeypatch.setattr(simhash, "pivots", lambda: other)
    assert not keys[0] & keys_by_text([a, b])[0]


@pytest.mark.parametrize("size", [24, 60, 150, 400])
def test_stage_recall_by_size(spark, size):
    """Pairs of texts, 0.8 to 0.85 alike, among unrelated ones: of each pair the first stays alone."""
    rng = np.random.default_rng(size)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnop"), 6))
    texts = []
    for _ in range(60):
        words = [word() for _ in range(size)]
        n = size - 4  # shingles; what is added at the end leaves the others
        texts += [" ".join(words), " ".join(words + [word() for _ in range(n // 4)])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id for r in simhash.stage(spark, docs, "").collect()} == set(range(0, 120, 2))
