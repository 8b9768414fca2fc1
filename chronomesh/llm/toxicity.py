"""Toxicity of texts after noisy-channel deobfuscation.

1. A character trigram language model is counted over the whole of all documents, with 64
   symbols, so its table has a fixed size.
2. Tokens that may be obfuscated (leetspeak inside or before letters, a letter three times
   or more in a row, letters spaced out) become a lattice: for each character the letters
   it may stand for, at a channel cost. Viterbi decoding under the language model restores
   the likeliest spelling. A plain word's lattice has one path, so it stays.
3. The restored text is scored by a logistic regression on its words and word beginnings.
   It is fitted on at most FIT_ROWS labelled documents outside the held-out fold; of their
   features, those most telling are kept.

Defined results: null, empty and blank texts have no features and get the score of the
intercept. Very long texts are read whole, tokens of any length are
decoded whole. Repeated rows get equal scores. Without labels
of both kinds every score is 0. An empty table gives no rows. Other columns are ignored;
labels, language, source and doc_id are never inputs of a score.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from os.path import commonprefix

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronomesh.llm.common import materialize, read

FOLDS = 5
#: Labelled documents that the classifier may be fitted on, the first by hash of doc_id, and features that it may have.
FIT_ROWS = 20_000
FEATURES = 4_096
#: A feature must be in this many toxic documents, and be this much likelier in them (log odds).
LEAST = 3
TELLING = 1.5
STEPS, RATE, L2 = 600, 0.5, 1e-6

SYMBOLS = 64
OTHER = 63
BOUNDARY = 0
LETTERS = "abcdefghijklmnopqrstuvwxyzàáâãäåæçèéêëìíîïñòóôõöøœùúûüýÿß"
CODE = {c: i + 1 for i, c in enumerate(LETTERS)}
#: What a character of leetspeak may stand for. Fixed values.
LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "+": "t", "|": "il", "€": "e"}
#: Channel costs in nats: a character replaced, one of a run dropped, a space put in.
REPLACED, DROPPED, SPACED = 1.0, 0.3, 0.7

EDGES = ".,;:!?\"'()[]{}<>|*%&#-_=~`"
RUN = re.compile(r"(.)\1\1")
SPACED_OUT = re.compile(r"(?<!\S)\w(?:[ .\-_*]\w){2,}(?![^\s.,;:!?])")
BEGINNINGS = (4, 5, 6)
SEEN = 1_000_000
#: After this many places of a lattice, what all paths left have in common is written down.
SETTLED = 64


def codes(text: str) -> np.ndarray:
    """Symbols of a lower-cased text: letters, runs of anything not alphabetic as a boundary or OTHER."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return _table()[np.minimum(points, 1023)]


_cache: dict[str, np.ndarray] = {}


def _table() -> np.ndarray:
    if "table" not in _cache:
        table = np.full(1024, OTHER, np.int64)
        for c, i in CODE.items():
            table[ord(c)] = i
        table[[9, 10, 11, 12, 13, 32]] = BOUNDARY
        table[[ord(c) for c in EDGES]] = BOUNDARY
        _cache["table"] = table
    return _cache["table"]


def trigrams(docs: DataFrame) -> DataFrame:
    """(code, n): symbol trigrams of all texts, summed in each task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SYMBOLS**3, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                text = "  ".join(t for t in batch.column(0).slice(at, 256).to_pylist() if t).lower()
                c = codes(f"  {text} ")
                total += np.bincount((c[:-2] * SYMBOLS + c[1:-1]) * SYMBOLS + c[2:], minlength=SYMBOLS**3)
        code = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(total[code])], ["code", "n"])

    return docs.select("text").mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def language_model(docs: DataFrame) -> np.ndarray:
    """Cost (negative log probability) of each symbol after two others: at most SYMBOLS^3 counts reach the driver."""
    n = np.zeros(SYMBOLS**3)
    for code, count in trigrams(docs).toPandas().itertuples(index=False):
        n[code] = count
    n = n.reshape(SYMBOLS, SYMBOLS, SYMBOLS)
    unigram = (n.sum((0, 1)) + 0.5) / (n.sum() + 0.5 * SYMBOLS)
    bigram = (n.sum(0) + 5 * unigram) / (n.sum((0, 2))[:, None] + 5)
    trigram = (n + 5 * bigram[None]) / (n.sum(2, keepdims=True) + 5)
    return -np.log(trigram).astype(np.float32)


def lattice(token: str) -> Iterator[list[tuple[str, float]]]:
    """For each run of equal characters of token, what it may stand for and at what cost. A run of three or more is one place, however long."""
    for m in re.finditer(r"(.)\1*", token, re.S):
        c, n = m[1], len(m[0])
        if c in LEET:
            singles = [(x, REPLACED) for x in LEET[c]]
        elif c in " .-_*":
            singles = [("", SPACED)]
        else:
            singles = [(c, 0.0)]
        if n > 2:  # a run stands for one or two
            yield [(x * k, cost + DROPPED * (k == 1)) for x, cost in singles for k in (1, 2)]
        else:
            own = [(c, 0.0)] if c in " .-_*" or not c.isalpha() else []
            yield from [singles + own] * n


def decode(token: str, cost: np.ndarray) -> str:
    """The likeliest spelling of a token of any length: Viterbi over the last two symbols.

    Each state carries the spelling of its best path, without the beginning that all of them share: it can't change any
    more and is written down every SETTLED places, so spellings stay short.
    """
    settled: list[str] = []
    states: dict[tuple[int, int], tuple[float, str]] = {(BOUNDARY, BOUNDARY): (0.0, "")}
    for place, choices in enumerate(lattice(token), 1):
        new: dict[tuple[int, int], tuple[float, str]] = {}
        for (a, b), (so_far, text) in states.items():
            for spelling, price in choices:
                x, y, total = a, b, so_far + price
                for c in spelling:
                    z = BOUNDARY if c in " .-_*" else CODE.get(c, OTHER)
                    total += float(cost[x, y, z])
                    x, y = y, z
                if (x, y) not in new or total < new[x, y][0]:
                    new[x, y] = (total, text + spelling)
        states = new
        if place % SETTLED == 0 and (shared := commonprefix([text for _, text in states.values()])):
            settled.append(shared)
            states = {k: (total, text[len(shared) :]) for k, (total, text) in states.items()}
    ends = [(total + float(cost[x, y, BOUNDARY]), text) for (x, y), (total, text) in states.items()]
    return "".join([*settled, min(ends)[1]])


def restored(token: str, cost: np.ndarray) -> str:
    """The word in a lower-cased token, deobfuscated; empty if it has no letter."""
    core = token.strip(EDGES).rstrip("$€")
    if core.isalpha():
        return decode(core, cost) if RUN.search(core) else core
    if not any(c.isalpha() for c in core):
        return ""
    if not any(c in LEET for c in core) and not SPACED_OUT.fullmatch(core):
        return core
    return decode(core, cost)


class Reader:
    """Features of texts; tokens met before are not decoded again."""

    def __init__(self, cost: np.ndarray, keep: dict[str, int] | None):
        self.cost, self.keep = cost, keep
        self.seen: set[str] = set()
        self.telling: dict[str, tuple] = {}

    def of_token(self, token: str) -> tuple:
        found = []
        for word in restored(token, self.cost).split():
            names = [f"={word}", *(f"^{word[:n]}" for n in BEGINNINGS if len(word) >= n)]
            found += names if self.keep is None else [self.keep[x] for x in names if x in self.keep]
        return tuple(found)

    def __call__(self, text: str | None) -> set:
        """All features of text, or of those to keep their numbers."""
        if not text:
            return set()
        low = text.lower()
        tokens = set(low.split())
        tokens.update(m[0] for m in SPACED_OUT.finditer(low))
        if new := tokens - self.seen:
            if len(self.seen) > SEEN:
                self.seen, self.telling = set(), {}
                new = tokens
            self.seen |= new
            for token in new:
                if f := self.of_token(token):
                    self.telling[token] = f
        return {x for token in self.telling.keys() & tokens for x in self.telling[token]}


def labelled_texts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, toxic) of at most FIT_ROWS labelled documents outside the held-out fold."""
    ids = (
        labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % FOLDS != 0))
        .groupBy("doc_id")
        .agg(F.max("toxic").cast("int").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(FIT_ROWS)
    )
    return docs.select("doc_id", "text").join(F.broadcast(materialize(ids, "toxicity-ids")), "doc_id")


def feature_counts(rows: DataFrame, cost: np.ndarray) -> DataFrame:
    """(feature, toxic, clean): in how many documents of each kind a feature is."""
    shared = rows.sparkSession.sparkContext.broadcast(cost)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(shared.value, None)
        counts: tuple[Counter, Counter] = (Counter(), Counter())
        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts[toxic].update(reader(text))
        for toxic in (0, 1):
            names = list(counts[toxic])
            for at in range(0, len(names), 50_000):
                part = names[at : at + 50_000]
                n = [counts[toxic][x] for x in part]
                zero = [0] * len(part)
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array(n if toxic else zero, pa.int64()), pa.array(zero if toxic else n, pa.int64())], ["feature", "toxic", "clean"])

    return rows.select("text", "toxic").mapInArrow(run, "feature string, toxic long, clean long").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def presence(rows: DataFrame, cost: np.ndarray, keep: dict[str, int]) -> DataFrame:
    """(toxic, at): the numbers of the kept features of each labelled document."""
    shared = rows.sparkSession.sparkContext.broadcast((cost, keep))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(*shared.value)
        for batch in batches:
            at = [sorted(reader(t)) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1).cast(pa.int32()), pa.array(at, pa.list_(pa.int32()))], ["toxic", "at"])

    return rows.select("text", "toxic").mapInArrow(run, "toxic int, at array<int>")


def fit(docs: DataFrame, labels: DataFrame, cost: np.ndarray) -> tuple[dict[str, int], np.ndarray]:
    """Features kept, by number, and their weights with the intercept last."""
    rows = materialize(labelled_texts(docs, labels), "toxicity-labelled")
    of = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(of) < 2:
        return {}, np.full(1, -1e9)
    odds = F.log((F.col("toxic") + 0.5) / (of[1] + 1)) - F.log((F.col("clean") + 0.5) / (of[0] + 1))
    told = feature_counts(rows, cost).where(F.col("toxic") >= LEAST).withColumn("odds", odds).where(F.col("odds") >= TELLING)
    best = told.orderBy((F.col("odds") * F.col("toxic")).desc(), "feature").limit(FEATURES).select("feature").collect()
    keep = {r["feature"]: i for i, r in enumerate(best)}
    sample = presence(rows, cost, keep).orderBy("toxic", "at").collect()
    y = np.array([r["toxic"] for r in sample], float)
    sizes = [len(r["at"]) for r in sample]
    doc = np.repeat(np.arange(len(sample)), sizes)
    at = np.array([x for r in sample for x in r["at"]], np.int64)
    w = np.zeros(len(keep) + 1)
    w[-1] = np.log(of[1] / of[0])
    seen = np.full(len(w), 1e-12)
    for _ in range(STEPS):
        margin = w[-1] + np.bincount(doc, w[at], len(y))
        error = 1 / (1 + np.exp(-np.clip(margin, -50, 50))) - y
        step = np.append(np.bincount(at, error[doc], len(keep)), error.sum()) / len(y)
        step[:-1] += L2 * w[:-1]
        seen += step**2
        w -= RATE * step / np.sqrt(seen)  # rare features get steps as long as common ones
    return keep, w


def score(docs: DataFrame, cost: np.ndarray, keep: dict[str, int], w: np.ndarray) -> DataFrame:
    """(doc_id, score) of every row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast((cost, keep, w))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cost, keep, w = shared.value
        reader = Reader(cost, keep)
        for batch in batches:
            margin = [w[-1] + sum(w[x] for x in sorted(reader(t))) for t in batch.column(1).to_pylist()]
            value = 1 / (1 + np.exp(-np.clip(margin, -700, 700)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(value, pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    cost = language_model(docs)
    keep, w = fit(docs, read(spark, sf_dir, "labels").select("doc_id", "toxic"), cost)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS == 0, F.lit(False))
    return score(docs, cost, keep, w).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
