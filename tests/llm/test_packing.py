"""The tokenizer's cache: bounded, and what is asked for again and again stays."""

from __future__ import annotations

import random

from chronomesh.llm import packing


def test_common_chunks_are_encoded_once(monkeypatch):
    monkeypatch.setattr(packing, "CACHED", 200)
    rng, encode = random.Random(2), packing.Encoder(packing.word_tokenizer())
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(7))
    common = [word() for _ in range(30)]
    texts = [" ".join([*common, *(word() for _ in range(40)), rng.choice(common)]).encode() for _ in range(100)]
    known, asked, most = encode.known, [], 0
    one = known.encode
    monkeypatch.setattr(known, "encode", lambda chunk: asked.append(chunk.decode()) or one(chunk))
    for text in texts:
        got = encode.encode([text])[0]
        assert list(memoryview(got).cast("I")) == [*known.tokenizer.encode(text.decode(), add_special_tokens=False).ids, packing.END]
        most = max(most, len(known) + len(getattr(known, "before", ())))
    assert most < 2 * packing.CACHED + 100
    assert all(asked.count(w) == 1 for w in common) and len(asked) > 3000
