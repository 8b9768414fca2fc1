"""Packing: order-preserving dynamic programming over window cuts, with monotone-queue transitions.

The documents of a partition, in their order, form one stream of tokens. Cuts are allowed
at document ends, sentence ends and, in long sentences and at the stream's end, inside;
a cut costs nothing, a little or more. A window of up to SEQUENCE tokens costs the padding
it needs: none if its length is a power of two, else what it lacks. The cheapest chain of
windows follows from

    best[j] = cut[j] + min over i, p[j] - p[i] <= SEQUENCE, of best[i] + padding(p[j] - p[i])

whose minimum over i is a sliding one of best[i] + p[i], kept in a monotone queue; lengths
that are powers of two are looked up besides.

Every task packs its own partition, so nothing is shuffled and tokens never leave the
task; a stream longer than FLUSH tokens is cut as it comes, which bounds memory. Only the
last window of a task can be short. The same partitions give the same sequences again.

Defined results: a null or empty text is one end token; a document of any length is cut
into as many pieces as needed; repeated rows are packed each on its own; an empty table
gives no rows; other columns are ignored. Text that spells a special token is encoded as
the tokenizer does by default.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections import deque
from collections.abc import Iterator
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronomesh.llm.common import read

SEQUENCE = 4096
END = 2
FLUSH = 1 << 19
#: Costs of a cut at a sentence end and inside a sentence, in tokens of padding; those at a document end are free.
AT_SENTENCE, INSIDE = 1.0, 12.0
#: A sentence longer than this may be cut inside, every STEP tokens.
LONG, STEP = 512, 64
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: Signs that are split off at the end of a chunk; no apostrophe, which the tokenizer keeps with some letters.
SIGNS = b".,;:!?*%&#$|"
LAST = np.array([END], "<u4").tobytes()
#: Chunks that a worker keeps, and as many again of those it kept before.
CACHED = 200_000


class Chunks(dict):
    """Token ids (little-endian 32-bit) of UTF-8 chunks without white space, encoded when first asked for."""

    def __init__(self, tokenizer):
        super().__init__()
        self.tokenizer, self.model, self.before = tokenizer, tokenizer.model, {}
        # the byte-level alphabet: printable bytes stand for themselves, the others for the characters from 256 on
        plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        rest = iter(range(256, 512))
        self.letter = [chr(b) if b in plain else chr(next(rest)) for b in range(256)]

    def __missing__(self, chunk: bytes) -> bytes:
        if (ids := self.before.pop(chunk, None)) is not None:
            self[chunk] = ids
            return ids
        word = chunk.rstrip(SIGNS)
        # a letter whose lower case ends in a mark is joined with a sign
        if 0 < len(word) < len(chunk) and (word[-1:].isalnum() or word.decode(errors="replace")[-1].lower()[-1].isalpha()):
            ids = self[word] + self[chunk[len(word) :]]
        else:
            ids = array("I", self.encode(chunk)).tobytes()
        self[chunk] = ids
        return ids

    def shrink(self) -> None:
        """Chunks that weren't asked for since the last time go, when there are more than CACHED."""
        if len(self) > CACHED:
            self.before = dict(self)
            self.clear()

    def encode(self, chunk: bytes) -> list[int]:
        """A word of Latin letters is one piece for the model; anything else takes the tokenizer's whole way."""
        if chunk.isalpha():
            return [t.id for t in self.model.tokenize(chunk.lower().decode())]
        text = chunk.decode(errors="replace")
        if text.isalpha() and max(text) < "\u0250" and is_normalized("NFC", text):
            lowered = "".join(c.lower() for c in text)  # one by one: a sigma at a word's end is like any other
            if lowered.isalpha():
                return [t.id for t in self.model.tokenize("".join(self.letter[b] for b in lowered.encode()))]
        return self.tokenizer.encode(text, add_special_tokens=False).ids


class Encoder:
    """Token ids of UTF-8 texts.

    The tokenizer drops white space and never joins across it, nor across a letter or digit
    and a sign that follows it. So chunks between white space, and words without the signs
    after them, are encoded once and kept. A-Z are lowered first, as the tokenizer does.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.known = Chunks(Tokenizer.from_file(path))
        vocabulary = self.known.tokenizer.get_vocab()
        self.sentence = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.sentence[[i for token, i in vocabulary.items() if re.search(r"[.!?]</w>$", token)]] = True
        self.sentence[END] = False

    def encode(self, texts: list[bytes | None]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit numbers, with END after them."""
        self.known.shrink()
        ids = self.known.__getitem__
        return [b"".join(map(ids, (t if b"<|" in t else t.lower()).split())) + LAST if t else LAST for t in texts]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def cut_points(ends: np.ndarray, sentences: np.ndarray, last: bool) -> tuple[np.ndarray, np.ndarray]:
    """Positions where the stream may be cut, ascending from 0, and what each cut costs. last: the stream ends with these tokens."""
    total = int(ends[-1])
    regular = np.unique(np.concatenate([[0], ends, sentences]))
    gaps = np.diff(regular)
    inner = [np.arange(a + STEP, a + g, STEP) for a, g in zip(regular[:-1][gaps > LONG], gaps[gaps > LONG], strict=True)]
    if last:
        inner.append(np.arange(max(1, total - SEQUENCE), total))
    points = np.unique(np.concatenate([regular, *inner]))
    cost = np.full(len(points), INSIDE)
    cost[np.searchsorted(points, sentences)] = AT_SENTENCE
    cost[np.searchsorted(points, ends)] = 0
    cost[0] = 0
    return points, cost


def cheapest(points: np.ndarray, cost: np.ndarray) -> list[int]:
    """Positions of the cheapest chain of cuts from the first point to the last."""
    p, c = points.tolist(), cost.tolist()
    place = {x: i for i, x in enumerate(p)}
    best, back = [0.0] * len(p), [0] * len(p)
    queue: deque[tuple[float, int]] = deque([(float(p[0]), 0)])
    powers = [1 << k for k in range(SEQUENCE.bit_length() - 1)]
    small = [x for x in powers if x >= 256]
    tail = p[-1] - SEQUENCE
    for j in range(1, len(p)):
        at = p[j]
        while p[queue[0][1]] < at - SEQUENCE:
            queue.popleft()
        low, i = queue[0]
        low += SEQUENCE - at
        for x in powers if at > tail else small:
            k = place.get(at - x)
            if k is not None and best[k] < low:
                low, i = best[k], k
        best[j], back[j] = low + c[j], i
        key = best[j] + at
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, j))
    chain, j = [], len(p) - 1
    while j:
        chain.append(p[j])
        j = back[j]
    return chain[::-1]


class Stream:
    """Documents of one task that are not packed yet: id, end token included ids, and how many of them are packed."""

    def __init__(self, encode: Encoder, first_id: int):
        self.encode, self.next_id = encode, first_id
        self.docs: list[list] = []
        self.tokens = 0

    def add(self, ids: list, texts: list) -> None:
        for doc_id, data in zip(ids, self.encode.encode(texts), strict=True):
            self.docs.append([doc_id, data, 0])
            self.tokens += len(data) // 4

    def pack(self, last: bool) -> list[tuple]:
        """Rows of the windows cut now; unless last, the final two windows wait for more documents."""
        if not self.docs:
            return []
        ends = np.cumsum([len(d) // 4 - done for _, d, done in self.docs])
        ids = np.frombuffer(b"".join(d[4 * done :] if done else d for _, d, done in self.docs), "<u4")
        known = np.minimum(ids, len(self.encode.sentence) - 1)
        chain = cheapest(*cut_points(ends, np.flatnonzero(self.encode.sentence[known]) + 1, last))
        if not last:
            chain = chain[:-2]
        rows, at, k, data = [], 0, 0, ids.tobytes()
        for stop in chain:
            begin = at
            while at < stop:
                doc_id, own, done = self.docs[k]
                piece = min(stop, int(ends[k])) - at
                rows.append((doc_id, done, piece, zlib.crc32(data[4 * at : 4 * (at + piece)]), len(own) // 4, self.next_id, at - begin))
                at += piece
                self.docs[k][2] += piece
                if at == ends[k]:
                    k += 1
            self.next_id += 1
        self.docs = self.docs[k:]
        self.tokens -= at
        return rows


def pack(docs: DataFrame, tokenizer: str) -> DataFrame:
    """docs (doc_id, text) packed by the tokenizer file at that path; a row per piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        stream = Stream(encoder(tokenizer), (task.partitionId() if task else 0) << 40)
        names = [x.split()[0] for x in SCHEMA.split(", ")]

        def out(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], names)

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                stream.add(part.column(0).to_pylist(), part.column(1).to_pylist())
                if stream.tokens > FLUSH and (rows := stream.pack(False)):
                    yield out(rows)
        if rows := stream.pack(True):
            yield out(rows)

    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, SCHEMA)


def word_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"), word_tokenizer())


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, word_tokenizer())
