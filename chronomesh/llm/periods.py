"""Periodic runs of words: where a text repeats itself back to back, found on a harmonic grid with prefix hashes.

A run is a stretch of words with smallest period q that is at least LEAST words and REPEATS
periods long and that no neighbouring word extends. Of such a run, at least
g = max(LEAST - q, (REPEATS - 1) * q) places x have both x and x + q inside, so one of them is a
multiple of g. For every period and every multiple of g, the longest common extension of x
and x + q to either side gives the run through them. There are about n / 2q such pairs for
a period, so n log n / 2 for a text of n words. All pairs whose two words are equal are
extended simultaneously, by binary search over prefix hashes in numpy. Runs found are
verified word by word; if hashes have lied, the texts are searched again with others.
A stretch has its smallest period among the periods found for it (by Fine and Wilf's
theorem, as it is three periods long), so of equal stretches the least period stays.

A text is searched in its own row: nothing is shuffled. Memory is bounded by the longest
text and by PAIRS pairs at a time.

Defined results: null and blank texts have no words and no runs, and collapse to an empty
text. Extra columns pass through; the names that `periodic_runs` adds get underscores
before them where a column has them already.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronomesh.llm.common import read, words

LEAST = 24
REPEATS = 3
#: Words of the texts that are searched together, and pairs that are extended together.
WORDS, PAIRS = 1 << 17, 1 << 20
PRIME = 2**31 - 1
RUN = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])


def hashed(codes: np.ndarray, places: np.ndarray, most: int, base: int, prime: int) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of codes times base to the place, and the powers up to most: modulo 2^64 (prime 0), or modulo a prime under 2^31."""
    if not prime:
        powers = np.cumprod(np.concatenate([[1], np.full(most, base)]).astype(np.uint64))
        return np.concatenate([np.zeros(1, np.uint64), np.cumsum(codes * powers[places])]), powers
    powers = np.ones(1, np.int64)
    while len(powers) <= most:
        powers = np.concatenate([powers, powers * (int(powers[-1]) * base % prime) % prime])
    terms = (codes % np.uint64(prime)).astype(np.int64) * powers[places] % prime
    return np.concatenate([np.zeros(1, np.int64), np.cumsum(terms) % prime]), powers


def extensions(prefix: np.ndarray, powers: np.ndarray, prime: int, x: np.ndarray, q: np.ndarray, limit: np.ndarray, back: bool) -> np.ndarray:
    """For each pair, how many words from x and from x + q on (or before them, if back) are equal, limit at most."""
    found, step = np.zeros(len(x), np.int64), 1 << int(limit.max(initial=0)).bit_length()
    scale, y = powers[q], x + q
    while step := step >> 1:
        n = found + step
        n_in = np.where(n <= limit, n, 0)
        if back:
            a, b = prefix[x] - prefix[x - n_in], prefix[y] - prefix[y - n_in]
        else:
            a, b = prefix[x + n_in] - prefix[x], prefix[y + n_in] - prefix[y]
        equal = a % prime * scale % prime == b % prime if prime else a * scale == b
        found = np.where((n <= limit) & equal, n, found)
    return found


def candidates(codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray, least: int, repeats: int, base: int, prime: int) -> np.ndarray:
    """Rows (text, start, length, period) of the runs in texts whose words' codes lie one after the other; start counts within its text."""
    prefix, powers = hashed(codes, np.arange(len(codes)) - np.repeat(starts, sizes), int(sizes.max(initial=0)), base, prime)
    most = np.where(sizes >= least, sizes // repeats, 0)
    text = np.repeat(np.arange(len(sizes)), most)
    q = np.arange(len(text)) - np.repeat(np.cumsum(most) - most, most) + 1
    grid = np.maximum(least - q, (repeats - 1) * q)
    points = -(-(sizes[text] - q) // grid)
    ends, found, at = np.cumsum(points), [np.zeros((0, 4), np.int64)], 0
    while at < len(q):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, "right")))
        own = np.repeat(np.arange(at, to), points[at:to])
        x = (np.arange(len(own)) - np.repeat(np.cumsum(points[at:to]) - points[at:to], points[at:to])) * grid[own] + starts[text[own]]
        equal = codes[x] == codes[x + q[own]]
        x, own = x[equal], own[equal]
        first, period = starts[text[own]], q[own]
        forward = extensions(prefix, powers, prime, x, period, first + sizes[text[own]] - x - period, False)
        backward = extensions(prefix, powers, prime, x, period, x - first, True)
        length = backward + period + forward
        long = length >= np.maximum(least, repeats * period)
        found.append(np.unique(np.stack([text[own], x - backward - first, length, period], 1)[long], axis=0))
        at = to
    rows = np.unique(np.concatenate(found), axis=0)  # by text, start, length, then period
    return rows[np.r_[True, (rows[1:, :3] != rows[:-1, :3]).any(1)]] if len(rows) else rows


def runs_of(texts: list[list[bytes]], least: int = LEAST, repeats: int = REPEATS) -> list[list[tuple[int, int, int]]]:
    """The runs (start, length, period) of each list of words, by start, then period."""
    sizes = np.array([len(w) for w in texts], np.int64)
    starts, seed = np.cumsum(sizes) - sizes, 0
    while True:
        rng = np.random.default_rng(seed)
        spread, base = (int(v) | 1 for v in rng.integers(1 << 62, 1 << 63, 2))
        codes = np.fromiter((hash(w) for ws in texts for w in ws), np.int64, int(sizes.sum())).astype(np.uint64)
        codes = (codes ^ (codes >> np.uint64(29))) * np.uint64(spread)
        out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        prime = PRIME if seed else 0  # modulo 2^64 is faster, but Thue-Morse sequences collide there under any base
        for text, start, length, period in candidates(codes, starts, sizes, least, repeats, base % prime if prime else base, prime).tolist():
            out[text].append((start, length, period))
        if all(ws[s : s + n - q] == ws[s + q : s + n] for ws, runs in zip(texts, out, strict=True) for s, n, q in runs):
            return [sorted(runs, key=lambda r: (r[0], r[2])) for runs in out]
        seed += 1


def collapsed(ws: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words without those that a run holds after its first period, joined by spaces."""
    if runs:
        keep = np.ones(len(ws), bool)
        for start, length, period in runs:
            keep[start + period : start + length] = False
        ws = list(compress(ws, keep.tolist()))
    return b" ".join(ws)


def best(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of most periods; of equal ones the first, then that of the smallest period."""
    top = None
    for r in runs:  # by start, then period
        if top is None or r[1] * top[2] > top[1] * r[2]:
            top = r
    return top


def periodic_runs(docs: DataFrame, text: str = "text", least: int = LEAST, repeats: int = REPEATS) -> DataFrame:
    """docs with `runs` (array of start, length, period), `best_run` (that of most periods, or null) and `collapsed` (the text without repetitions)."""
    names = []
    for name in ("runs", "best_run", "collapsed"):
        while name.lower() in {c.lower() for c in [*docs.columns, *names]}:
            name = f"_{name}"
        names.append(name)
    at, kinds = docs.columns.index(text), (pa.list_(run := pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])), run, pa.string())

    def record(r: tuple[int, int, int]) -> dict[str, int]:
        return dict(zip(("start", "length", "period"), r, strict=True))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, from_, n = [], 0, 0
            for i, t in enumerate(batch.column(at).cast(pa.binary()).to_pylist()):
                held.append((t or b"").split())  # bytes are split at \x20 and \x09-\x0D alone
                n += len(held[-1])
                if n >= WORDS or i == batch.num_rows - 1:
                    found = runs_of(held, least, repeats)
                    new = (
                        pa.array([[record(r) for r in rs] for rs in found], kinds[0]),
                        pa.array([record(b) if (b := best(rs)) else None for rs in found], kinds[1]),
                        pa.array([collapsed(ws, rs) for ws, rs in zip(held, found, strict=True)], pa.binary()).cast(pa.string()),
                    )
                    part = batch.slice(from_, len(held))
                    yield pa.RecordBatch.from_arrays([*part.columns, *new], [*part.schema.names, *names])
                    held, from_, n = [], i + 1, 0

    added = [T.StructField(c, k) for c, k in zip(names, (T.ArrayType(RUN), RUN, T.StringType()), strict=True)]
    return docs.mapInArrow(search, T.StructType([*docs.schema.fields, *added]))


def planted(docs: DataFrame) -> DataFrame:
    """(doc_id, text): in a tenth of the texts, chosen by the id's crc32, the words from some place on repeat a cycle; a null id changes nothing."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g, w = F.floor(h / 10), words(F.col("text"))
    staged = docs.select("doc_id", "text", F.when(h % 10 == 0, w).alias("w"), g.alias("g"))
    n = F.size("w")
    a = (F.col("g") % n).cast("int")
    p = (1 + F.floor((n - F.col("a")) / (3 + F.col("g") % 8))).cast("int")
    staged = staged.withColumn("a", F.when(n > 0, a)).withColumn("p", p)
    tail = F.transform(F.sequence("a", n - 1), lambda i: F.element_at("w", F.col("a") + (i - F.col("a")) % F.col("p") + 1))
    changed = F.concat_ws(" ", F.slice("w", F.lit(1), F.col("a")), tail)
    return staged.select("doc_id", F.when(F.col("a").isNotNull(), changed).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(planted(read(spark, sf_dir, "documents")))
    line = lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))
    length, period = F.col("best_run.length"), F.col("best_run.period")
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best_run.start").alias("start"),
        length.alias("length"),
        period.alias("period"),
        F.floor(1000 * length / period).alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
