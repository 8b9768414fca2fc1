"""Substring dedup: near-duplicate passages across documents through compact windows.

A text is the sequence of its shingles of SHINGLE words. Under a hash function, a compact
window (l, c, r) says: every passage that starts in l..c and ends in c..r has its min-hash
at c. The windows are the nodes of the Cartesian tree over the hashes; only those at least
LEAST shingles wide matter, and these are the minima of sliding spans of that width, so
they are found without building the whole tree. Two documents whose windows have their
minimum in the same shingle share that min-hash for all passages of both windows.

Windows of all documents meet by hash function and shingle. A key's windows are never
paired among themselves: each is paired with that of the smallest document. Per pair of
documents, an interval join counts for every passage start how many hash functions agree;
where at least AGREE do, the stretch is a candidate. Candidates are verified on the
shingles themselves (Jaccard similarity of at least SIMILARITY, LEAST shingles or more).

A key from a part that many documents hold (a template) leads to a smallest document that
a passage need not be alike to. So the keys whose windows verified passages
don't link are compared in full, whatever the number of their windows: one task has the
shingles around each window's minimum and finds what is alike by an index over their rarest
shingles, a prefix of which alike passages must share. What the task knows to be linked isn't compared again, so copies and near copies
give links enough to join them, not all pairs. Minima that a document has within LEAST places are one
row, and keys whose least row is the same one meet together, so that a text travels once for them;
that only adds comparisons. Of a group of more than LARGE rows those stay that have enough shingles in common
with other documents; if they are still more, they are cut into
blocks, and every block meets every other one; that step grows with the square of what stays.
For the smallest documents, a key that very many windows have
is cut into chunks with a smallest document each, which are compared among themselves.

Defined results: null, empty and short texts have no windows. Of rows with the same doc_id
the one whose text has the smallest hash counts; rows without one take no part. Passages that
a document repeats only in itself are not reported. Very long texts are read whole. An empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronomesh.llm.buckets import chunked, distinct
from chronomesh.llm.common import materialize, read
from chronomesh.sources.shared import forget_shuffles, scratch

SHINGLE = 5
#: Shingles of the shortest passage: 50 words.
LEAST = 50 - SHINGLE + 1
HASHES = 6
AGREE = 2
SIMILARITY = 0.8
#: Passages are read in stretches that start and end at multiples of this.
GRAIN = 64
#: Bytes of wanted stretches that may be broadcast; more are joined by a shuffle.
BROADCAST_BYTES = 24 << 20
#: Shingles before and after a common minimum that are compared where a key's windows meet in full: as long as a partner of LEAST shingles can be.
AROUND = math.ceil(LEAST / SIMILARITY)
#: Rows of a group of keys that one task compares; a group of more is cut into blocks, and each pair of blocks is compared by one task.
LARGE = 1 << 12
#: Shingles that a passage has in common with one it is alike to, at least.
NEED = math.ceil(SIMILARITY * LEAST)
#: Share of the documents that is looked at to tell which keys may be very frequent; it only decides how their rows are dealt out.
LOOK = 1 / 16
#: Rows up to which all pairs are looked at without an index.
PLAIN = 32
FACTOR = 0xD6E8FEB86659FD95
SPACES = np.isin(np.arange(256), np.frombuffer(b" \t\n\r\x0b\x0c", np.uint8))
CODES = np.where(SPACES, 0, np.array([xxhash.xxh64_intdigest(bytes([x]), 1) for x in range(256)], np.uint64)).astype(np.uint64)
SEEDS = np.array([xxhash.xxh64_intdigest(f"window {k}", 0) for k in range(HASHES)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


@lru_cache(maxsize=4)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of FACTOR, and of its inverse."""
    out = np.ones((2, n), np.uint64)
    out[:, 1:] = np.array([[FACTOR], [pow(FACTOR, -1, 1 << 64)]], np.uint64)
    up, down = np.cumprod(out, axis=1)
    return up, down


def word_hashes(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts in lower case, one after another, and how many each text has."""
    # sums over all bytes of a word of a random number for the byte, times a power that tells its place
    data = np.frombuffer(b"\n".join([b"", *((text or b"").lower() for text in texts)]), np.uint8)
    space = SPACES[data]
    start = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    ends = np.cumsum([len(text or b"") + 1 for text in texts])
    counts = np.diff(np.searchsorted(start, ends), prepend=0)
    if not len(start):
        return np.empty(0, np.uint64), counts
    up, down = powers(max(1 << 12, 1 << len(data).bit_length()))
    h = CODES[data]
    h *= up[: len(data)]
    return np.add.reduceat(h, start) * down[start], counts


def shingles(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the shingles of all texts, one after another, and where each text's begin (one more: where all end)."""
    h, n = word_hashes(texts)
    count = np.maximum(n - SHINGLE + 1, 0)
    begin = np.concatenate([[0], np.cumsum(count)])
    if not begin[-1]:
        return np.empty(0, np.uint64), begin
    h, rolled = mix(h), np.zeros(len(h) - SHINGLE + 1, np.uint64)
    for i in range(SHINGLE):
        rolled *= np.uint64(0x9E3779B97F4A7C15)
        rolled += h[i : len(h) - SHINGLE + 1 + i]
    first = np.cumsum(n) - n
    at = np.repeat(first - begin[:-1], count) + np.arange(begin[-1])
    return mix(rolled[at]), begin


def minima(h: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, start and place of the minimum of all passages of LEAST values of h, in order; the leftmost of equal values is the minimum."""
    if len(h) < LEAST:
        return (np.empty(0, np.int64),) * 3
    low = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    span = 1
    while 2 * span <= LEAST:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if rest := LEAST - span:
        low = np.minimum(low[:-rest], low[rest:])
    text_of = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
    start = np.flatnonzero(text_of[: len(low)] == text_of[LEAST - 1 :])
    return text_of[start], start, (low[start] & np.uint64(0xFFFFFFFF)).astype(np.int64)


def windows(h: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Compact windows at least LEAST wide: text, l, c, r (in the text) for the values h."""
    of, _, node = minima(h, begin)
    if not len(node):
        return (np.empty(0, np.int64),) * 4
    new = np.concatenate([[True], node[1:] != node[:-1]])
    of, node = of[new], node[new]
    value = (h[node] >> np.uint64(32)).tolist()
    left, right = begin[of].tolist(), (begin[of + 1] - 1).tolist()
    places, texts = node.tolist(), of.tolist()
    stack: list[int] = []
    for i, (v, t, p) in enumerate(zip(value, texts, places, strict=True)):
        if stack and texts[stack[-1]] != t:
            stack.clear()
        while stack and value[stack[-1]] > v:
            right[stack.pop()] = p - 1
        if stack:
            left[i] = places[stack[-1]] + 1
        stack.append(i)
    base = begin[of]
    return of, np.array(left) - base, node - base, np.array(right) - base


#: Writes a table that a step makes for itself and reads it back: `materialize`, or into a `scratch` folder.
Table = Callable[[DataFrame, str], DataFrame]
#: at: where a window's minimum c is, and which passages of LEAST shingles it holds for: those that start in [first, last]. See `placed`.
WINDOWS = "key long, doc_id long, at long"
NAMES = ["key", "doc_id", "at"]


def placed(c: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """c, first and last in one number: c, then how far the others are before it (less than LEAST)."""
    return (c << 12) | ((c - first) << 6) | (c - last)


def places(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    c = at >> 12
    return c, c - (at >> 6 & 63), c - (at & 63)


def tabled(h: np.ndarray, begin: np.ndarray, ids: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Compact windows (WINDOWS) of texts under each hash function."""
    for seed in SEEDS:
        value = mix(h ^ seed)
        # a window's passages of LEAST shingles are those that follow one another with its minimum
        of, start, c = minima(value, begin)
        if len(of):
            first = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]]))
            last = np.append(first[1:], len(c)) - 1
            of, c, first, last = of[first], c[first], start[first], start[last]
            place = placed(c - begin[of], first - begin[of], last - begin[of])
            yield pa.RecordBatch.from_arrays([pa.array(value[c].view(np.int64)), pa.array(ids[of]), pa.array(place)], NAMES)


def window_table(docs: DataFrame) -> DataFrame:
    """Compact windows of all documents (WINDOWS); key: hash function and shingle of the minimum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):  # few, so that arrays stay in the processor's cache
                part = batch.slice(at, 64)
                ids = part.column(0).to_numpy(zero_copy_only=False)
                yield from tabled(*shingles(part.column(1).to_pylist()), ids)

    own = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return own.mapInArrow(run, WINDOWS)


MEMBERS = "key long, doc_id long, at long, rep long, rep_at long, chunk int"


def with_smallest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """MEMBERS (see `met`) of rows (key, chunk, doc_id, at) in order of key and chunk."""

    def out(key: np.ndarray, chunk: np.ndarray, doc: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
        start = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (chunk[1:] != chunk[:-1])]))
        size = np.diff(start, append=len(key))
        several = (np.minimum.reduceat(doc, start) != np.maximum.reduceat(doc, start)) | (chunk[start] > 0)
        kept = np.repeat(several, size)
        key, chunk, doc, at = key[kept], chunk[kept], doc[kept], at[kept]
        of = np.repeat(np.arange(several.sum()), size[several])
        order = np.lexsort((at, doc, of))
        low = order[np.searchsorted(of, np.arange(several.sum()))][of]  # of is in order and stays so
        other = (doc != doc[low]) | (chunk > 0)
        columns = [key, doc, at, doc[low], at[low], chunk.astype(np.int32)]
        return pa.RecordBatch.from_arrays([pa.array(x[other]) for x in columns], [x.split()[0] for x in MEMBERS.split(", ")])

    held = [np.empty(0, np.int64)] * 4
    for batch in batches:
        rows = [np.concatenate([x, y.to_numpy(zero_copy_only=False)]) for x, y in zip(held, batch.columns, strict=True)]
        new = np.flatnonzero((rows[0][1:] != rows[0][:-1]) | (rows[1][1:] != rows[1][:-1]))
        cut = int(new[-1]) + 1 if len(new) else 0  # the last chunk may go on
        if cut:
            yield out(*(x[:cut] for x in rows))
        held = [x[cut:] for x in rows]
    if len(held[0]):
        yield out(*held)


def met(own: DataFrame, look: DataFrame | None = None, table: Table = materialize) -> tuple[DataFrame, DataFrame]:
    """(members, pairs) of the keys that several documents have. own (WINDOWS); look: a part of it, for the sizes of keys.

    members (WINDOWS and rep, rep_at, chunk): windows, but for those of a key's smallest document,
    with the smallest document rep of their chunk and its window; pairs (doc_id,
    rep, at, c0): each window with that one, whose minimum is
    at c0, and the smallest of a key's chunks with the smallest of all.
    """
    rows = chunked(own, "doc_id", *((look, LOOK) if look is not None else ()))
    rows = rows.select("key", F.col("chunk").cast("int").alias("chunk"), "doc_id", "at").repartition("key", "chunk").sortWithinPartitions("key", "chunk")
    shared = table(rows.mapInArrow(with_smallest, MEMBERS), "passage-windows")
    c0 = lambda at: F.shiftright(at, 12).alias("c0")
    # a row for each chunk; those of one key are few
    chunks = shared.where("chunk > 0").select("key", F.col("rep").alias("doc_id"), F.col("rep_at").alias("at")).distinct()
    lowest = chunks.groupBy("key").agg(F.min(F.struct("doc_id", "at")).alias("low")).select("key", F.col("low.doc_id").alias("rep"), c0("low.at"))
    across = chunks.join(table(lowest, "passage-lowest"), "key")
    pairs = shared.select("doc_id", "rep", "at", c0("rep_at")).unionAll(across.select("doc_id", "rep", "at", "c0"))
    return shared, pairs.where("doc_id <> rep")


RANGES = "doc_id long, rep long, a_lo int, a_hi int, b_lo int, b_hi int"


def candidates(pairs: DataFrame, agree: int = AGREE) -> DataFrame:
    """Stretches on which `agree` windows or more agree, per pair of documents (RANGES). pairs: see `met`."""

    def stretches(rows: np.ndarray) -> list[np.ndarray]:
        # rows: (pair, at, c0); pair numbers ascend
        pair, at, c0 = rows.T
        c, first, last = places(at)
        n = len(pair)
        # sweep: +1 where a window begins to hold, -1 after it ends, in order of pair and place
        p, x = np.concatenate([pair, pair]), np.concatenate([first, last + 1])
        step, at = np.concatenate([np.ones(n, int), -np.ones(n, int)]), np.concatenate([np.arange(n)] * 2)
        order = np.lexsort((step, x, p))
        p, x, step, at = p[order], x[order], step[order], at[order]
        depth = np.cumsum(step)
        edge = np.concatenate([(p[1:] != p[:-1]) | (x[1:] != x[:-1]), [True]])  # the last event at a place tells the depth after it
        p_edge, x_edge, d_edge = p[edge], x[edge], depth[edge]
        high = d_edge >= agree
        up = high & ~np.concatenate([[False], high[:-1]])
        down = ~high & np.concatenate([[False], high[:-1]])
        begin, end, whose = x_edge[up], x_edge[down] - 1, p_edge[up]
        if not len(begin):
            return []
        # shift of the partner: from windows that hold within the stretch
        place = whose * (1 << 32) + begin
        which = np.searchsorted(place, pair * (1 << 32) + last, side="right") - 1
        good = (which >= 0) & (whose[np.maximum(which, 0)] == pair) & (end[np.maximum(which, 0)] >= first)
        low, high_shift = np.full(len(begin), 1 << 40), np.full(len(begin), -(1 << 40))
        np.minimum.at(low, which[good], (c0 - c)[good])
        np.maximum.at(high_shift, which[good], (c0 - c)[good])
        stop = end + LEAST
        return [whose, begin, stop, np.maximum(begin + low, 0), stop + high_shift]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: np.ndarray | None = None
        for batch in batches:
            rows = np.stack([x.to_numpy(zero_copy_only=False).astype(np.int64) for x in batch.columns], axis=1)
            if not len(rows):
                continue
            rows = rows if held is None else np.concatenate([held, rows])
            new = np.concatenate([[True], (rows[1:, :2] != rows[:-1, :2]).any(axis=1)])
            cut = int(np.flatnonzero(new)[-1])  # the last pair of documents may go on
            yield from out(rows[:cut])
            held = rows[cut:]
        if held is not None:
            yield from out(held)

    def out(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not len(rows):
            return
        new = np.concatenate([[True], (rows[1:, :2] != rows[:-1, :2]).any(axis=1)])
        starts = rows[new]
        if found := stretches(np.column_stack([np.cumsum(new) - 1, rows[:, 2:]])):
            pair, *ends = found
            arrays = [pa.array(starts[pair, 0]), pa.array(starts[pair, 1]), *(pa.array(x.astype(np.int32)) for x in ends)]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "rep", "a_lo", "a_hi", "b_lo", "b_hi"])

    # a pair of documents has at most as many rows as the smaller one has windows
    return pairs.select("doc_id", "rep", "at", "c0").repartition("doc_id", "rep").sortWithinPartitions("doc_id", "rep").mapInArrow(run, RANGES)


def of_texts(batches: Iterator[pa.RecordBatch], of_row: Callable[..., list[tuple]], names: list[str], types: tuple) -> Iterator[pa.RecordBatch]:
    """of_row(h, doc_id, ...) of all rows (doc_id, text, ...); h: the 32-bit shingle hashes of the text."""
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            ids, texts, *rest = (c.to_pylist() for c in batch.slice(at, 64).columns)
            h, begin = shingles(texts)
            h = (h >> np.uint64(32)).astype("<u4")
            out = [x for k, row in enumerate(zip(ids, *rest, strict=True)) for x in of_row(h[begin[k] : begin[k + 1]], *row)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)], names)


def stretches_of(docs: DataFrame, wanted: DataFrame, table: Table = materialize) -> DataFrame:
    """(doc_id, lo, hi, a, b, h): 32-bit shingle hashes of the wanted stretches (doc_id, lo, hi, a, b). docs: one row for each doc_id."""
    wanted = wanted.groupBy("doc_id", "lo", "hi").agg(F.max("a").alias("a"), F.max("b").alias("b"))
    by_doc = table(wanted.groupBy("doc_id").agg(F.collect_list(F.struct("lo", "hi", "a", "b")).alias("at")), "passage-wanted")
    by_doc = by_doc.withColumnRenamed("doc_id", "_d")
    small = (by_doc.agg(F.sum(32 + 48 * F.size("at"))).first()[0] or 0) <= BROADCAST_BYTES
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    held = own.join(F.broadcast(by_doc) if small else by_doc, F.col("doc_id") == F.col("_d")).select("doc_id", "text", *[F.col(f"at.{x}").alias(x) for x in ("lo", "hi", "a", "b")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(h: np.ndarray, doc_id: int, *at: list) -> list[tuple]:
            return [(doc_id, lo, hi, a, b, h[lo:hi].tobytes()) for lo, hi, a, b in zip(*at, strict=True)]

        yield from of_texts(batches, rows, ["doc_id", "lo", "hi", "a", "b", "h"], (pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.bool_(), pa.binary()))

    return held.mapInArrow(run, "doc_id long, lo int, hi int, a boolean, b boolean, h binary")


def alike(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int, int, int, float]]:
    """(a_start, a_stop, b_start, b_stop, similarity) of the passages of a that are near-duplicates of one of b.

    Matches that lie too far apart for any passage are told apart first. A part that isn't
    alike as a whole falls into runs of matches with one shift; of all stretches from one
    run to another that are alike, the one with the most matches is taken, and so on with
    what lies before and after it.
    """
    if len(a) == len(b) >= LEAST and np.array_equal(a, b):
        return [(0, len(a), 0, len(b), 1.0)]
    order = np.argsort(b, kind="stable")
    ranked = b[order]
    at = np.minimum(np.searchsorted(ranked, a), len(b) - 1)
    hit = np.flatnonzero(ranked[at] == a)
    twin = order[at[hit]]
    anywhere = (at[hit] + 1 < len(b)) & (ranked[np.minimum(at[hit] + 1, len(b) - 1)] == a[hit])  # b has them again elsewhere
    if len(hit) < NEED:
        return []
    if not anywhere.any() and (twin[1:] > twin[:-1]).all():  # then from match s to match e, e - s + 1 are common; what lies between them in a and b tells the rest
        value = 9 * np.arange(len(hit)) - 4 * (hit + twin)
        if (value[NEED - 1 :] + 1 < np.minimum.accumulate(value)[: len(hit) - NEED + 1]).all():
            return []
    all_a, all_b = a.tolist(), b.tolist()
    if anywhere.any():  # what goes on in b as it does in a is matched there, not where b has it first
        before, to, follow = -2, 0, twin.tolist()
        for i, p in enumerate(hit.tolist()):
            if p == before + 1 and to + 1 < len(all_b) and all_b[to + 1] == all_a[p]:
                follow[i] = to + 1
            before, to = p, follow[i]
        twin = np.array(follow)

    def similarity(lo: int, hi: int, b_lo: int, b_hi: int) -> float:
        own, other = set(all_a[lo:hi]), set(all_b[b_lo:b_hi])
        common = len(own & other)
        return common / (len(own) + len(other) - common)

    found, parts = [], [np.arange(len(hit))]
    while parts:
        part = parts.pop()
        if len(part) < SIMILARITY * LEAST:
            continue
        # a passage holds no more mismatches in a row than this
        far = np.flatnonzero(np.diff(hit[part]) - 1 > (1 / SIMILARITY - 1) * len(part)) + 1
        if len(far):
            parts += np.split(part, far)
            continue
        lo, hi = int(hit[part[0]]), int(hit[part[-1]]) + 1
        if hi - lo < LEAST:
            continue
        shift = twin[part] - hit[part]
        near = twin[part][np.abs(shift - int(np.median(shift))) <= (hi - lo)]
        if len(near):
            b_lo, b_hi = int(near.min()), int(near.max()) + 1
            if (same := similarity(lo, hi, b_lo, b_hi)) >= SIMILARITY:
                found.append((lo, hi, b_lo, b_hi, same))
                continue
        first = np.flatnonzero(np.concatenate([[True], (np.diff(hit[part]) > 1) | (np.diff(shift) != 0)]))
        last = np.concatenate([first[1:], [len(part)]]) - 1
        start, stop = hit[part[first]], hit[part[last]] + 1
        b_start, b_stop = twin[part[first]], twin[part[last]] + 1
        options = []
        for i in range(len(first)):  # the matches between two runs bound what they can have in common
            most = last[i:] - first[i] + 1
            n_a, n_b = stop[i:] - start[i], b_stop[i:] - b_start[i]
            ok = (n_a >= LEAST) & (n_b > 0) & (most >= SIMILARITY * (n_a + n_b - np.minimum(most, n_b)))
            options += [(-int(most[j]), int(n_a[j]), i, i + int(j)) for j in np.flatnonzero(ok)]
        for _, _, i, j in sorted(options):
            ends = int(start[i]), int(stop[j]), int(b_start[i]), int(b_stop[j])
            of = twin[part[first[i] : last[j] + 1]]
            common = np.count_nonzero((of >= ends[2]) & (of < ends[3]) | anywhere[part[first[i] : last[j] + 1]])
            if common < SIMILARITY * (ends[1] - ends[0] + ends[3] - ends[2] - common):
                continue
            if (same := similarity(*ends)) >= SIMILARITY:
                found.append((*ends, same))
                parts += [part[: first[i]], part[last[j] + 1 :]]
                break
    return found


PASSAGES = "doc_id long, start int, stop int, twin_id long, twin_start int, twin_stop int, similarity double"


def passage_rows(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.float64())
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], [x.split()[0] for x in PASSAGES.split(", ")])


def verified(docs: DataFrame, ranges: DataFrame, table: Table = materialize) -> DataFrame:
    """Passages in words: [start, stop) of doc_id is a near-duplicate of [twin_start, twin_stop) of twin_id."""
    down = lambda x: F.greatest(F.lit(0), F.floor((F.col(x) - LEAST) / GRAIN) * GRAIN).cast("int")
    up = lambda x: (F.ceil((F.col(x) + LEAST) / GRAIN) * GRAIN).cast("int")
    ranges = ranges.select("doc_id", "rep", down("a_lo").alias("a_lo"), up("a_hi").alias("a_hi"), down("b_lo").alias("b_lo"), up("b_hi").alias("b_hi"))
    ranges = table(ranges.distinct(), "passage-ranges")
    yes, no = F.lit(True), F.lit(False)  # which side of a pair a stretch is
    of_a = ranges.select("doc_id", F.col("a_lo").alias("lo"), F.col("a_hi").alias("hi"), yes.alias("a"), no.alias("b"))
    of_b = ranges.select(F.col("rep").alias("doc_id"), F.col("b_lo").alias("lo"), F.col("b_hi").alias("hi"), no.alias("a"), yes.alias("b"))
    parts = table(stretches_of(docs, of_a.unionAll(of_b), table), "passage-stretches")
    side = lambda name, x: parts.where(x).select(F.col("doc_id").alias(name), F.col("lo").alias(f"{x}_lo"), F.col("hi").alias(f"{x}_hi"), F.col("h").alias(f"h_{x}"))
    both = ranges.join(side("doc_id", "a"), ["doc_id", "a_lo", "a_hi"]).join(side("rep", "b"), ["rep", "b_lo", "b_hi"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, rep, a_lo, b_lo, h_a, h_b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                a, b = np.frombuffer(h_a, "<u4"), np.frombuffer(h_b, "<u4")
                for lo, hi, lo_b, hi_b, same in alike(a, b) if len(a) and len(b) else ():
                    rows.append((doc_id, a_lo + lo, a_lo + hi + SHINGLE - 1, rep, b_lo + lo_b, b_lo + hi_b + SHINGLE - 1, same))
            if rows:
                yield passage_rows(rows)

    return both.select("doc_id", "rep", "a_lo", "b_lo", "h_a", "h_b").mapInArrow(run, PASSAGES)


def undecided(members: DataFrame, found: DataFrame, table: Table = materialize) -> DataFrame:
    """(key, doc_id, at, twins, meet): the windows of keys whose windows passages found don't link yet; meet: the least hash of the key's rows of `gathered`.

    twins: the documents of the passages found that hold the window's minimum, so windows with a common one are linked.
    Where a passage is the same in the key's smallest document for all that the window holds for, that one stands for it. members: see `met`.
    """
    spans = found.groupBy("doc_id").agg(F.collect_set(F.struct("start", "stop", "twin_id", "similarity")).alias("spans"))
    c, before, after = F.shiftright("at", 12), F.shiftright("at", 6).bitwiseAND(63), F.col("at").bitwiseAND(63)
    within = lambda s, low, high: (s["start"] <= low) & (high <= s["stop"])
    same = F.exists("spans", lambda s: (s["similarity"] == 1) & (s["twin_id"] == F.col("rep")) & within(s, c - before, c - after + LEAST + SHINGLE - 1))
    smallest = members.where("chunk = 0").select("key", F.col("rep").alias("doc_id"), F.col("rep_at").alias("at"), F.lit(None).cast("long").alias("rep")).distinct()
    rows = members.select(*NAMES, "rep").unionAll(smallest).join(spans, "doc_id", "left").where(~F.coalesce(same, F.lit(False)))
    twins = F.array_distinct(F.transform(F.filter("spans", lambda s: within(s, c, c + SHINGLE)), lambda s: s["twin_id"]))
    left = table(rows.select(*NAMES, F.coalesce(twins, F.array().cast("array<long>")).alias("twins")), "passage-left")
    root = F.least("doc_id", F.array_min("twins"))
    ends = F.min(root).alias("low"), F.max(root).alias("high"), F.min(F.xxhash64("doc_id", cell_of("at"))).alias("meet")
    opened = left.groupBy("key").agg(*ends).where("low <> high").select("key", "meet")
    return materialize(left.join(table(opened, "passage-open"), "key"), "passage-undecided")


def cell_of(at: str) -> Column:
    """The stretch of LEAST places that a window's minimum is in."""
    return F.floor(F.shiftright(at, 12) / LEAST)


def gathered(rows: DataFrame) -> DataFrame:
    """(key, doc_id, twins, first, last): rows (`undecided`) of one document, cell and twins are one, with the first and the last minimum; key: that of all keys that meet together."""
    c = F.shiftright("at", 12).cast("int")
    cells = rows.groupBy(F.col("meet").alias("key"), "doc_id", F.array_sort("twins").alias("twins"), cell_of("at").alias("cell"))
    return materialize(cells.agg(F.min(c).alias("first"), F.max(c).alias("last")).drop("cell"), "passage-cells")


def beside_texts(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """(doc_id, text, at): each document that rows (doc_id, ...) have, with all of its rows."""
    names = [x for x in rows.columns if x != "doc_id"]
    size = F.sum(48 + 8 * F.size("twins")) if "twins" in names else F.sum(F.lit(40))
    by_doc = materialize(rows.groupBy("doc_id").agg(F.collect_list(F.struct(*names)).alias("at"), size.alias("bytes")), "passage-places").withColumnRenamed("doc_id", "_d")
    small = (by_doc.agg(F.sum(F.col("bytes") + 32)).first()[0] or 0) <= BROADCAST_BYTES
    held = docs.join(F.broadcast(by_doc) if small else by_doc, F.col("doc_id") == F.col("_d"))
    return held.select("doc_id", F.col("text").cast("binary").alias("text"), *[F.col(f"at.{x}").alias(x) for x in names])


def around(h: np.ndarray, first: int, last: int) -> np.ndarray:
    return h[max(0, first - AROUND) : last + AROUND + 1]


def elsewhere(of: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Which places hold a shingle (numbers `of` from 0) that another document has too. doc: the document of each place."""
    one = np.zeros(int(of.max()) + 1, doc.dtype)
    one[of] = doc  # any of the documents that have it
    other = np.zeros(len(one), bool)
    other[of[one[of] != doc]] = True
    return other[of]


def fewest(x: np.ndarray) -> int:
    """How many different shingles make up NEED places of x, at least."""
    return int(np.searchsorted(np.cumsum(-np.sort(-np.unique(x, return_counts=True)[1])), NEED)) + 1


def able(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """rows (`gathered`, and parts) with able: whether NEED of a row's places have shingles in common with other documents' rows of its key, as all have that hold a passage alike to one.

    A row that isn't able may still have the twin of an able one's passage, which repeats a shingle; it stays if it has
    as many different common shingles as such a passage needs. A row's shingles are dealt to parts by hash, and a task
    counts for each part, so a key's rows need not fit one task.
    """

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def dealt(h: np.ndarray, doc_id: int, *places: list) -> list[tuple]:
            out = []
            for key, first, last, parts in zip(*places, strict=True):
                x = around(h, first, last)
                few, of = fewest(x), x % parts
                order = np.argsort(of, kind="stable")
                ends = np.searchsorted(of[order], np.arange(parts + 1))
                out += [(key, q, doc_id, first, few, x[order[ends[q] : ends[q + 1]]].tobytes()) for q in range(parts) if ends[q] < ends[q + 1]]
            return out

        yield from of_texts(batches, dealt, ["key", "part", "doc_id", "first", "few", "h"], (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary()))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            ids, firsts, fews, texts = zip(*held, strict=True)
            h = np.frombuffer(b"".join(texts), "<u4")
            begin = np.cumsum([0, *(len(x) // 4 for x in texts)])
            row = np.repeat(np.arange(len(ids)), np.diff(begin))
            of = np.unique(h, return_inverse=True)[1]
            met = elsewhere(of, np.array(ids)[row])
            n = np.bincount(row[met], minlength=len(ids))
            kinds = np.bincount(np.unique(row[met] * len(h) + of[met]) // len(h), minlength=len(ids))
            columns = [pa.array([last[0]] * len(ids), pa.int64()), pa.array(ids, pa.int64()), pa.array(firsts, pa.int32()), pa.array(fews, pa.int32()), pa.array(n), pa.array(kinds)]
            return pa.RecordBatch.from_arrays(columns, ["key", "doc_id", "first", "few", "n", "kinds"])

        last, held = None, []
        for batch in batches:
            for *key, doc_id, first, few, h in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != last:
                    if held:
                        yield out()
                    last, held = key, []
                held.append((doc_id, first, few, h))
        if held:
            yield out()

    dealt = beside_texts(docs, rows.select("doc_id", "key", "first", "last", "parts")).mapInArrow(deal, "key long, part int, doc_id long, first int, few int, h binary")
    counts = dealt.repartition("key", "part").sortWithinPartitions("key", "part").mapInArrow(count, "key long, doc_id long, first int, few int, n long, kinds long")
    sums = counts.groupBy("key", "doc_id", "first").agg((F.sum("n") >= NEED).alias("able"), F.min("few").alias("few"), F.sum("kinds").alias("kinds"))
    sums = materialize(sums, "passage-counts")
    least = materialize(sums.where("able").groupBy("key").agg(F.min("few").alias("least")), "passage-least")
    stay = sums.join(least, "key").where("able OR kinds >= least").select("key", "doc_id", "first", "able")
    return rows.join(stay, ["key", "doc_id", "first"])


def surroundings(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """(key, doc_id, twins, low, high, side, lo, h): 32-bit hashes h of the shingles around each row (`gathered`), from lo on, a row for each pair (low, high) of blocks that its block, side, is in.

    The able rows of a large key are in blocks from 0 on, which all meet; its other rows are in blocks after those, which meet the able ones only.
    """
    blocks = lambda of: F.ceil(F.sum(of.cast("int")) / LARGE).cast("int")
    large = materialize(rows.groupBy("key").agg(blocks(F.lit(True)).alias("parts")).where("parts > 1"), "passage-large")
    rows = rows.withColumns({"parts": F.lit(1), "others": F.lit(0), "side": F.lit(0)})
    if not large.isEmpty():
        met = materialize(able(docs, rows.drop("parts").join(large, "key")).drop("parts", "others", "side"), "passage-able")
        sizes = materialize(met.groupBy("key").agg(blocks(F.col("able")).alias("parts"), blocks(~F.col("able")).alias("others")), "passage-blocks")
        block = lambda n: F.pmod(F.xxhash64("doc_id"), F.greatest(n, F.lit(1)))
        side = F.when(F.col("able"), block("parts")).otherwise(F.col("parts") + block("others")).cast("int")
        rows = rows.join(large.select("key"), "key", "left_anti").unionByName(met.join(sizes, "key").withColumn("side", side).drop("able"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(h: np.ndarray, doc_id: int, *places: list) -> list[tuple]:
            return [(key, doc_id, twins, *blocks, max(0, first - AROUND), around(h, first, last).tobytes()) for key, twins, first, last, *blocks in zip(*places, strict=True)]

        types = (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
        yield from of_texts(batches, rows, ["key", "doc_id", "twins", "parts", "others", "side", "lo", "h"], types)

    held = beside_texts(docs, rows.select("doc_id", "key", "twins", "first", "last", "parts", "others", "side"))
    own = held.mapInArrow(run, "key long, doc_id long, twins array<long>, parts int, others int, side int, lo int, h binary")
    meets = F.when(F.col("side") < F.col("parts"), F.sequence(F.lit(0), F.col("parts") + F.col("others") - 1)).otherwise(F.sequence(F.lit(0), F.col("parts") - 1))
    cells = F.transform(meets, lambda q: F.struct(F.least("side", q).alias("low"), F.greatest("side", q).alias("high")))
    return own.withColumn("cell", F.explode(cells)).select("key", "doc_id", "twins", "cell.low", "cell.high", "side", "lo", "h")


def joined(docs: list[int], twins: list[list[int]], sides: list[int], texts: list[bytes], compare: Callable[[int, int], bool]) -> None:
    """Calls compare(i, j), docs[i] larger, until all rows that it says are alike are linked; rows are so from the start where they have a twin in common or are one's twin. Rows ascend by document.

    A passage of i that is alike to one of j has SIMILARITY * LEAST shingles of j. Of i's shingles in order of
    how many rows have them, all but the last ones that are fewer than that are looked up, so
    no such pair is missed. Rows with the same shingles as an earlier one meet that one only. If there are several sides, only pairs of different ones count.
    """
    need, across = NEED, len(set(sides)) > 1
    nodes = {}
    names = [nodes.setdefault(x, len(nodes)) for x in docs]
    part = np.arange(len(nodes) + sum(map(len, twins)))
    for name, own in zip(names, twins, strict=True):
        for x in own:
            part[part == part[nodes.setdefault(x, len(nodes))]] = part[name]
    part, first, rows = part[names], {}, []

    def link(i: int, j: int) -> None:
        part[part == part[i]] = part[j]

    for i in range(len(docs)):
        twin = first.setdefault((sides[i], texts[i]), i)
        if twin == i:
            rows.append(i)
        elif part[i] != part[twin] and (docs[i] == docs[twin] or compare(i, twin)):
            link(i, twin)
    own = [np.frombuffer(texts[i], "<u4") for i in rows]
    if len(rows) <= PLAIN:
        ranked = np.concatenate([np.sort(x).astype(np.uint64) | np.uint64(k << 32) for k, x in enumerate(own)])
        for k, i in enumerate(rows):
            others = [m for m in range(k) if part[rows[m]] != part[i] and docs[rows[m]] != docs[i] and (sides[rows[m]] != sides[i] or not across)]
            if not others or len(own[k]) < LEAST:
                continue
            wanted = own[k] | (np.array(others, np.uint64) << np.uint64(32))[:, None]
            hit = ranked[np.minimum(np.searchsorted(ranked, wanted), len(ranked) - 1)] == wanted
            near = np.flatnonzero(np.count_nonzero(hit, axis=1) >= need)
            if len(near):
                new = np.zeros(len(own[k]), bool)
                new[np.unique(own[k], return_index=True)[1]] = True
                near = near[may_hold(hit[near], new)]
                near = near if new.all() or not len(near) else near[holds(hit[near], own[k])]
            for m in near.tolist():
                j = rows[others[m]]
                if part[j] != part[i] and compare(i, j):
                    link(i, j)
        return
    ends = np.cumsum([len(x) for x in own])
    values, of = np.unique(np.concatenate(own), return_inverse=True)
    place = np.full((len(rows), max(LEAST, *map(len, own))), len(values), np.int32)  # numbers of the shingles, and one that none has
    new = np.zeros(place.shape, bool)  # where a row has a shingle first
    for k, (x, end) in enumerate(zip(own, ends.tolist(), strict=True)):
        place[k, : len(x)] = of[end - len(x) : end]
        new[k, np.unique(place[k, : len(x)], return_index=True)[1]] = True
    count = np.bincount(place[new], minlength=len(values) + 1)
    begin = np.cumsum(count) - count
    having = np.repeat(np.arange(len(rows)), new.sum(axis=1))[np.argsort(place[new], kind="stable")]  # the rows that have each shingle, ascending
    seen, local = np.zeros(len(count), np.int64), np.full(len(count), place.shape[1], np.int16)
    at, doc, side = np.array(rows), np.array(docs)[rows], np.array(sides)[rows]
    for k, i in enumerate(rows):
        fresh, shared = place[k][new[k]], place[k][count[place[k]] > 1]
        shared = shared[shared < len(values)]
        if len(shared) >= need:
            order = np.argsort(count[shared] * len(count) + shared, kind="stable")
            prefix = distinct(shared[order[: len(order) - need + 1]])
            others = distinct(np.concatenate([having[begin[p] : begin[p] + seen[p]] for p in prefix.tolist()]))
            others = others[(part[at[others]] != part[i]) & (doc[others] != docs[i]) & ((side[others] != sides[i]) | (not across))]
            if len(others):
                local[fresh] = np.flatnonzero(new[k])
                met_at = local[place[others]]
                if new[k, : len(own[k])].all():  # then a shingle is hit in one place only
                    enough = np.count_nonzero(met_at < place.shape[1], axis=1) >= need
                    met_at, others = met_at[enough], others[enough]
                met = np.zeros((len(others), place.shape[1] + 1), bool)
                np.put_along_axis(met, met_at, True, axis=1)
                hit = met[:, local[place[k]]] & (place[k] < len(values))
                local[fresh] = place.shape[1]
                able = np.flatnonzero(may_hold(hit, new[k]))
                if len(able) and not new[k, : len(own[k])].all():
                    able = able[holds(hit[able], place[k])]
                for j in at[others[able]].tolist():
                    if part[j] != part[i] and compare(i, j):
                        link(i, j)
        seen[fresh] += 1


def may_hold(hit: np.ndarray, new: np.ndarray) -> np.ndarray:
    """Which rows of hit have a stretch of LEAST or more, from a hit to a hit, whose distinct shingles that aren't hit are as few as SIMILARITY allows. new: where a shingle stands first."""
    step = np.where(hit, 1, np.where(new, -math.floor(SIMILARITY / (1 - SIMILARITY) + 1e-9), 0)).astype(np.int16)
    stop = np.cumsum(step, axis=1, dtype=np.int16)
    start = np.minimum.accumulate(np.where(hit, stop - step, np.int16(1 << 14)), axis=1)
    return (hit[:, LEAST - 1 :] & (stop[:, LEAST - 1 :] >= start[:, : hit.shape[1] - LEAST + 1])).any(axis=1)


def holds(hit: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Which rows of hit have a stretch of LEAST or more of row's shingles, from a hit to a hit, of whose distinct ones SIMILARITY are hit. Where shingles repeat, `may_hold` counts a hit again and again."""
    order = np.argsort(row, kind="stable")
    same = row[order[1:]] == row[order[:-1]]
    before = np.full(len(row), -1)  # where the shingle stands before
    before[order[1:][same]] = order[:-1][same]
    start, stop = np.arange(len(row) - LEAST + 1)[:, None], np.arange(len(row))
    first = ((before < start) & (stop >= start)).astype(np.int16)  # of a stretch from start on
    far, out = stop >= start + LEAST - 1, np.zeros(len(hit), bool)
    for k in range(0, len(hit), 64):
        x = hit[k : k + 64]
        step = np.where(x, 1, -math.floor(SIMILARITY / (1 - SIMILARITY) + 1e-9)).astype(np.int16)
        enough = np.cumsum(step[:, None] * first, axis=2, dtype=np.int16) >= 0
        out[k : k + 64] = (enough & far & x[:, None] & x[:, : len(start), None]).any(axis=(1, 2))
    return out


def met_in_full(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """Passages (PASSAGES) around the common minima of keys' windows: enough to link all that are alike. rows: see `undecided`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, []

        def out() -> Iterator[pa.RecordBatch]:
            ids, twins, sides, lows, texts = zip(*sorted(held), strict=True)
            if ids[0] == ids[-1]:
                return
            found = []

            def compare(i: int, j: int) -> bool:
                rows = alike(np.frombuffer(texts[i], "<u4"), np.frombuffer(texts[j], "<u4"))
                found.extend((ids[i], lows[i] + lo, lows[i] + hi + SHINGLE - 1, ids[j], lows[j] + lo_b, lows[j] + hi_b + SHINGLE - 1, same) for lo, hi, lo_b, hi_b, same in rows)
                return bool(rows)

            joined(ids, twins, sides, texts, compare)
            if found:
                yield passage_rows(found)

        for batch in batches:
            for *key, doc_id, twins, side, lo, h in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != last:
                    if held:
                        yield from out()
                    last, held = key, []
                held.append((doc_id, twins, side, lo, h))
        if held:
            yield from out()

    dealt = surroundings(docs, gathered(rows)).select("key", "low", "high", "doc_id", "twins", "side", "lo", "h")
    return dealt.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high").mapInArrow(run, PASSAGES)


def one_row_each(docs: DataFrame) -> DataFrame:
    """docs without rows that have another one's doc_id: the smallest hash of the text stays."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id IS NOT NULL")
    copy = F.xxhash64("text")
    twice = docs.groupBy("doc_id").agg(F.count("*").alias("n"), F.min(copy).alias("least")).where("n > 1")
    twice = materialize(twice.select(F.col("doc_id").alias("of"), "least"), "passage-twice")
    if twice.isEmpty():
        return docs
    held = docs.join(twice, F.col("doc_id") == F.col("of"), "left")
    return held.where(F.col("least").isNull() | (copy == F.col("least"))).select("doc_id", "text")


def passages(docs: DataFrame) -> DataFrame:
    """Near-duplicate passages of at least 50 words that documents share with a smaller document (PASSAGES)."""
    docs = one_row_each(docs)
    with scratch(docs.sparkSession, "passage-tables") as of_windows:
        members, pairs = met(window_table(docs), window_table(docs.sample(LOOK, 1)), of_windows.table)
        forget_shuffles(docs.sparkSession)
        with scratch(docs.sparkSession, "passage-texts") as of_pairs:
            found = materialize(verified(docs, candidates(pairs), of_pairs.table), "passages")
        forget_shuffles(docs.sparkSession)
        rows = undecided(members, found, of_windows.table)
    forget_shuffles(docs.sparkSession)
    return found.unionAll(met_in_full(docs, rows)).distinct()


def op9_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages(read(spark, sf_dir, "documents").select("doc_id", "text"))
