"""Secret scans: fixed patterns, and a randomness test battery over long tokens.

Patterns (assign, access, hex) are found leftmost and without overlap, in whole texts.
The battery looks at every other token of LEAST characters or more whose alphabet is one
of the known encodings. Three tests against "its symbols are drawn uniformly and
independently" are made for the inferred encoding: chi-squared uniformity over the alphabet,
runs above and below its middle, and serial correlation. The smallest of the three p-values,
corrected for three tests, tells how random a token looks; structured tokens (identifiers,
words, paths) get small ones.

What is reported is controlled against structured tokens. Every document gives for every
class of length an identifier made of its own words and a number, and the battery's
results for these are the null distribution: a token's q is the share of them, of its class
of length, that look at least as random. Where a class is short, identifiers often look
random too, so its tokens never get a small q. Benjamini-Hochberg over the q of all tokens of
all documents, with longer tokens given a proportionally larger share of the budget, tells
which are reported as `random` spans; about RATE of them at most are structured.

Null distribution and step-up threshold come from counts by binned p-value and q, so no
task or driver ever sees all tokens. Texts are read once; decisions are made on a table of
spans.

Defined results: null and empty texts have no spans. Positions are code points, ends
exclusive. Random spans that would overlap a fixed one are left out. Repeated rows are
scanned each on its own; a class of length without identifiers (no document has words
enough) reports nothing; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronomesh.llm.common import materialize, read

#: Shortest token that the battery looks at, the false discovery rate, the bins of p-values and q (in steps of 1 / PER_E nats).
LEAST = 20
RATE = 0.05
BINS = 1024
PER_E = 16

_anycase = lambda word: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)
ASSIGN = re.compile(
    "(" + "|".join(map(_anycase, ("password", "passwd", "secret", "token", "api_?key"))) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
KEYWORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % LEAST)
#: Lengths from which the classes of length start.
CLASSES = (LEAST, 26, 32, 40, 48, 64)
WORDS = re.compile(r"[A-Za-z]{2,12}")
KINDS = ("assign", "access", "hex", "random")
DIGITS, UPPER, LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (alphabet, kinds of characters that must be there), narrowest first.
ENCODINGS = (
    (DIGITS + "abcdef", (DIGITS, "abcdef")),
    (DIGITS + "ABCDEF", (DIGITS, "ABCDEF")),
    (UPPER + "234567", (UPPER, "234567")),
    (DIGITS + LOWER, (DIGITS, LOWER)),
    (DIGITS + UPPER, (DIGITS, UPPER)),
    (UPPER + LOWER + DIGITS, (UPPER, LOWER, DIGITS)),
    (UPPER + LOWER + DIGITS + "+/", (UPPER, LOWER, DIGITS)),
    (UPPER + LOWER + DIGITS + "-_", (UPPER, LOWER, DIGITS)),
)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns."""
    found = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    return found


def symbols(token: str) -> tuple[list[int], int] | None:
    """Places of the token's characters in its inferred alphabet, and the alphabet's size; None if no encoding fits."""
    core = token.rstrip("=")
    if len(core) < LEAST:
        return None
    own = set(core)
    for alphabet, parts in ENCODINGS:
        if own <= set(alphabet) and all(own & set(p) for p in parts):
            return [alphabet.index(c) for c in core], len(alphabet)
    return None


def tail(z: float) -> float:
    """Probability that a standard normal deviates by |z| or more."""
    return math.erfc(abs(z) / math.sqrt(2))


def p_value(token: str) -> float | None:
    """The battery's p-value against "random in its encoding"; None without an encoding."""
    if (found := symbols(token)) is None:
        return None
    s, size = found
    n = len(s)
    # uniformity, over as many equal cells as give about five expected symbols each
    cells = max(2, min(size, n // 5))
    counts = [0] * cells
    width = [0] * cells
    for x in range(size):
        width[x * cells // size] += 1
    for x in s:
        counts[x * cells // size] += 1
    chi = sum((c - n * w / size) ** 2 / (n * w / size) for c, w in zip(counts, width, strict=True))
    k = cells - 1
    uniform = 0.5 * math.erfc((((chi / k) ** (1 / 3)) - (1 - 2 / (9 * k))) / math.sqrt(2 / (9 * k)) / math.sqrt(2))
    # runs of symbols in the alphabet's upper and lower half
    high = [2 * x >= size for x in s]
    a = sum(high)
    b = n - a
    if a and b:
        runs = 1 + sum(x != y for x, y in zip(high, high[1:], strict=False))
        mean, spread = 1 + 2 * a * b / n, 2 * a * b * (2 * a * b - n) / (n * n * (n - 1))
        of_runs = tail((runs - mean) / math.sqrt(spread)) if spread > 0 else 1.0
    else:
        of_runs = 0.0
    # correlation of neighbours
    mean = sum(s) / n
    square = sum((x - mean) ** 2 for x in s)
    serial = tail(math.sqrt(n) * sum((x - mean) * (y - mean) for x, y in zip(s, s[1:], strict=False)) / square) if square else 0.0
    return min(1.0, 3 * min(uniform, of_runs, serial))


def class_of(length: int) -> int:
    return sum(length >= x for x in CLASSES) - 1


def bin_of(p: float) -> int:
    return min(BINS - 1, int(-math.log(max(p, 1e-300)) * PER_E))


def identifiers(text: str) -> Iterator[str]:
    """A structured token for each class of length: words of text from some place on, joined in one of the usual ways, with a number."""
    seed = zlib.crc32(text.encode("utf-8", "replace"))
    for k, least in enumerate(CLASSES):
        turn = seed + 7919 * k
        style, number = turn % 5, str(turn // 5 % 10_000)
        length = least + turn // 7 % max(4, least // 4)
        found = chain(WORDS.finditer(text, turn % max(1, len(text))), WORDS.finditer(text))
        parts: list[str] = []
        while sum(map(len, parts)) < length and (m := next(found, None)):
            parts.append((m[0].lower(), m[0].capitalize(), m[0].upper(), m[0].capitalize(), m[0].capitalize())[style])
        if sum(map(len, parts)) < length:
            return
        parts.insert(1 + turn // 3 % len(parts), number)
        yield ("", "_", "", "", "/")[style].join(parts)[:length]


def scan(text: str | None) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, float]]]:
    """Fixed spans, and (start, end, p) of the other tokens that have an encoding."""
    if not text:
        return [], []
    base, tokens = base_spans(text), []
    for m in TOKEN.finditer(text):
        long = [(m.start() + h.start(), m.start() + h.end(), "hex") for h in HEX.finditer(m[0]) if len(h[0]) >= 32]
        base += long
        if not long and (p := p_value(m[0])) is not None:
            tokens.append((m.start(), m.end(), p))
    base.sort(key=lambda x: (x[0], KINDS.index(x[2])))
    free = [t for t in tokens if all(t[1] <= a or b <= t[0] for a, b, _ in base)]
    return base, free


SCANNED = "doc_id long, base array<struct<start:long,stop:long,kind:string>>, tokens array<struct<start:long,stop:long,class:int,bin:int>>, null array<struct<class:int,bin:int>>"


def scanned(docs: DataFrame) -> DataFrame:
    """(doc_id, base, tokens, null) of every row: fixed spans, tokens with their results, and those of the document's identifiers."""
    span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("kind", pa.string())]))
    token = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("class", pa.int32()), ("bin", pa.int32())]))
    nulls = pa.list_(pa.struct([("class", pa.int32()), ("bin", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            found = [scan(t) for t in texts]
            base = pa.array([[{"start": a, "stop": b, "kind": k} for a, b, k in x] for x, _ in found], span)
            tokens = pa.array([[{"start": a, "stop": b, "class": class_of(b - a), "bin": bin_of(p)} for a, b, p in x] for _, x in found], token)
            null = [[(class_of(len(x)), p_value(x)) for x in identifiers(t)] if t else [] for t in texts]
            null = pa.array([[{"class": k, "bin": bin_of(p)} for k, p in x if p is not None] for x in null], nulls)
            yield pa.RecordBatch.from_arrays([batch.column(0), base, tokens, null], ["doc_id", "base", "tokens", "null"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCANNED)


def null_distribution(rows: DataFrame) -> DataFrame:
    """One row with one array of arrays: by class of length and bin, the share of identifiers that look at least as random."""
    counts = rows.select(F.explode("null").alias("x")).groupBy("x.class", "x.bin").agg(F.count("*").alias("n"))
    every = rows.sparkSession.range(len(CLASSES) * BINS).select((F.col("id") / BINS).cast("int").alias("class"), (F.col("id") % BINS).cast("int").alias("bin"))
    full = every.join(counts, ["class", "bin"], "left").na.fill(0, ["n"])
    of_class = Window.partitionBy("class")
    q = (F.sum("n").over(of_class.orderBy("bin")) + 1) / (F.sum("n").over(of_class) + 1)
    by_class = full.withColumn("q", q).groupBy("class").agg(F.array_sort(F.collect_list(F.struct("bin", "q"))).alias("rows"))
    return by_class.agg(F.array_sort(F.collect_list(F.struct("class", F.transform("rows", lambda r: r["q"]).alias("q")))).alias("all")).select(F.transform("all", lambda x: x["q"]).alias("q"))


def weighted(token, null, mean):
    """A token's q over its share of the budget, which grows with its length."""
    return F.least(F.lit(1.0), null[token["class"]][token["bin"]] * mean / (token["stop"] - token["start"]))


def reported_below(rows: DataFrame, null: DataFrame) -> DataFrame:
    """One row (mean, cut): mean token length; tokens in a bin of weighted q of at least cut are reported. A null cut: none are."""
    tokens = rows.select(F.explode("tokens").alias("t"))
    mean = tokens.agg(F.coalesce(F.avg(F.col("t.stop") - F.col("t.start")), F.lit(1.0)).alias("mean"))
    bins = tokens.withColumn("q", null.scalar()).withColumn("mean", mean.scalar()).select(q_bin(weighted(F.col("t"), F.col("q"), F.col("mean"))).alias("bin"))
    bins = bins.groupBy("bin").agg(F.count("*").alias("n"))
    # of the tokens with a q up to a bin's upper edge, that edge times all tokens are expected to be structured ones
    upto = F.sum("n").over(Window.orderBy(F.desc("bin")))
    edge = F.exp(-F.col("bin") / F.lit(float(PER_E)))
    passed = bins.withColumns({"upto": upto, "total": F.sum("n").over(Window.partitionBy())}).where(edge * F.col("total") <= F.lit(RATE) * F.col("upto"))
    return mean.withColumn("cut", passed.agg(F.min("bin").alias("bin")).scalar())


def q_bin(q):
    return F.least(F.lit(BINS - 1), F.floor(-F.log(q) * PER_E)).cast("int")


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, base, spans): arrays of (start, stop, kind), spans with the random ones."""
    rows = materialize(scanned(docs), "secret-spans")
    null = materialize(null_distribution(rows), "secret-null")
    cut = materialize(reported_below(rows, null), "secret-cut")
    random = F.filter("tokens", lambda t: F.coalesce(q_bin(weighted(t, F.col("_null"), F.col("_cut.mean"))) >= F.col("_cut.cut"), F.lit(False)))
    added = F.transform(random, lambda t: F.struct(t["start"].alias("start"), t["stop"].alias("stop"), F.lit("random").alias("kind")))
    place = lambda s: F.array_position(F.array(*map(F.lit, KINDS)), s["kind"])
    both = F.transform(F.concat("base", added), lambda s: F.struct(s["start"].alias("start"), place(s).alias("place"), s["stop"].alias("stop"), s["kind"].alias("kind")))
    held = rows.withColumn("_null", null.scalar()).withColumn("_cut", cut.select(F.struct("mean", "cut")).scalar())
    return held.select("doc_id", "base", F.array_sort(both).alias("spans"))


def op6_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = find(read(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")
    return rows.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(joined("base"), 256).alias("base_sha256"),
        joined("spans").alias("spans"),
    )
