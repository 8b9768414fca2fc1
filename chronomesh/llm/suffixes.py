"""Removal of repeated substrings by distributed prefix doubling over synchronising positions.

Every byte that some string of T bytes covers goes if that string also starts anywhere else.
A suffix sort of all positions would order a row for each byte several times, so ranks are
given to positions that equal strings have in common:

1. Anchors. The owner of a window of T bytes is the leftmost of its K-grams with the least
   hash (K = T // 2 + 1). Equal windows have equal owners at equal offsets, an owner serves
   consecutive windows, and neighbouring owners overlap. Both ends of a text are anchors too.
2. Prefix doubling. An anchor's first rank is that of its K-gram among all that occur twice.
   Its string is then continued by that of the last anchor that starts within it or right
   after it: pairs (rank of the one, rank of the other, offset between them) are counted,
   those that occur twice are sorted by Spark, and their places are the ranks of strings
   twice as long. Offsets so grow from about K to 2K, 4K and so on. Anchors drop out as soon as they are
   unique, and when the strings needed are past the threshold.
3. Contexts. The windows of an owner lie within a context, the string of one anchor or of two
   that overlap; the pair of their ranks and the offset name it. Windows of contexts that occur
   twice all repeat.
4. Bytes. Windows whose owner has equals, but whose context has none, are at the border of a
   repeat. They and those of one context for each rank that shares the owner are compared by
   the owner's rank paired with 128-bit hashes: in blocks of BLOCK windows first, of which one
   whose common part is unique holds no repeat, and one that is met twice as a whole repeats;
   then window by window in the blocks left.

Rows are numbers; hot strings are counted before they are shuffled, and joined back by joins
that Spark can split. What one task holds of a text is at most the text and its anchors.
K-grams and windows are told apart by 128-bit hashes, texts by SHA-256.

Defined results: a null text is empty; texts under T bytes keep all. Repeated rows are
copies of each other, so their texts go as a whole. A cut can fall inside a character, so
what is kept is bytes. Extra columns pass through; new names get underscores before them
where a column has them already.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronomesh.llm.common import free_name, materialize, read
from chronomesh.operators.ranks import ranked
from chronomesh.sources.shared import Scratch, scratch

THRESHOLD = 200
#: Bytes that are hashed at once.
PIECE = 1 << 18
#: Windows of a border that are compared together.
BLOCK = 16
#: A key in memory; keys of texts with borders and runs of texts are broadcast up to this measured size, beyond it texts are shuffled.
KEY_BYTES, BROADCAST_BYTES = 128, 16 << 20
BASE = 0x9E3779B97F4A7C15
TABLE = np.random.default_rng(5).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

ANCHOR = "doc long, i int, a int, lo int, hi int, s int, far int, k1 long, k2 long, key string"
#: Kinds of the rows that a level gives: pairs to be ranked, contexts for a later level, contexts that are settled.
PAIR, PENDING, SETTLED = 0, 1, 2
LEVEL = "kind int, doc long, i int, a int, id long, own long, lo int, hi int, s int, end int, far int, x long, y long, d int, u int"
SPAN = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])


def powers(base: int, n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, base, np.uint64)]))


POWERS, INVERSE = powers(BASE, PIECE), powers(pow(BASE, -1, 1 << 64), PIECE)


def owners(buffer: np.ndarray, t: int) -> np.ndarray:
    """Place of the owner of the window of t bytes at each place of buffer (PIECE bytes at most)."""
    n, k = len(buffer), t // 2 + 1
    prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(TABLE[buffer] * POWERS[:n])])
    g = (prefix[k:] - prefix[:-k]) * INVERSE[: n - k + 1]
    g = (g ^ (g >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    least = (g >> np.uint64(32) << np.uint64(32)) | np.arange(len(g), dtype=np.uint64)
    width, step = t - k + 1, 1
    while step * 2 <= width:
        least, step = np.minimum(least[:-step], least[step:]), step * 2
    if step < width:
        least = np.minimum(least[: len(least) - (width - step)], least[width - step :])
    return (least & np.uint64(0xFFFFFFFF)).astype(np.int64)


def anchors_of(texts: list[bytes], t: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each text of t bytes or more: owners, and the first and last window of each."""
    flat: list[tuple[int, int, bytes]] = []  # text, place, piece
    for j, text in enumerate(texts):
        flat += [(j, at, text[at : at + PIECE]) for at in range(0, max(1, len(text) - t + 1), PIECE - t + 1)]
    own: list[list[np.ndarray]] = [[] for _ in texts]
    at = 0
    while at < len(flat):
        to, size = at + 1, len(flat[at][2])
        while to < len(flat) and size + len(flat[to][2]) <= PIECE:
            size, to = size + len(flat[to][2]), to + 1
        found = owners(np.frombuffer(b"".join(p for _, _, p in flat[at:to]), np.uint8), t)
        start = 0
        for j, place, piece in flat[at:to]:
            own[j].append(found[start : start + len(piece) - t + 1] - start + place)
            start += len(piece)
        at = to
    out = []
    for parts in own:
        whole = np.concatenate(parts)
        first = np.flatnonzero(np.r_[True, whole[1:] != whole[:-1]])
        out.append((whole[first], first, np.r_[first[1:], len(whole)] - 1))
    return out


def anchors(docs: DataFrame, t: int) -> DataFrame:
    """docs (key, text) → ANCHOR: the anchors of each text (lo, hi: its windows, none if hi < lo; s: last anchor up to lo; far: last one that starts within k bytes), and a row with i = -1 and the key."""
    k = t // 2 + 1

    def rows_of(doc: int, text: bytes, own: np.ndarray, first: np.ndarray, last: np.ndarray) -> list[np.ndarray]:
        ends = np.array([0, len(text) - k])
        a = np.union1d(own, ends)
        at = np.searchsorted(a, own)
        lo, hi = np.zeros(len(a), np.int64), np.full(len(a), -1)
        lo[at], hi[at] = first, last
        s = np.searchsorted(a, lo, "right") - 1
        far = np.searchsorted(a, a + k, "right") - 1
        names = np.frombuffer(b"".join([xxhash.xxh3_128_digest(text[p : p + k]) for p in a.tolist()]), "<i8").reshape(-1, 2)
        return [np.full(len(a), doc), np.arange(len(a)), a, lo, hi, s, far, names[:, 0], names[:, 1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        doc = (task.partitionId() if task else 0) << 32
        names = [f.split(" ")[0] for f in ANCHOR.split(", ")]
        kinds = [pa.int64(), *[pa.int32()] * 6, pa.int64(), pa.int64()]
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1).cast(pa.binary()).to_pylist()
            ids, sizes = np.arange(doc, doc + len(texts)), np.array([len(x) for x in texts], np.int32)
            doc += len(texts)
            none = pa.nulls(len(texts), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.full(len(texts), -1, np.int32)), *[none] * 5, *[pa.nulls(len(texts), pa.int64())] * 2, keys], names)
            long = np.flatnonzero(sizes >= t).tolist()
            while long:
                size, n = 0, 0
                while n < len(long) and (not n or size + sizes[long[n]] <= 4 * PIECE):
                    size, n = size + int(sizes[long[n]]), n + 1
                some, long = long[:n], long[n:]
                found = [rows_of(int(ids[j]), texts[j], *f) for j, f in zip(some, anchors_of([texts[j] for j in some], t), strict=True)]
                columns = [pa.array(np.concatenate(c)).cast(kind) for c, kind in zip(zip(*found, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*columns, pa.nulls(len(columns[0]), pa.string())], names)

    return docs.select("key", "text").mapInArrow(run, ANCHOR)


def level_of(columns: dict[str, np.ndarray], t: int) -> dict[str, np.ndarray]:
    """One step of the doubling over whole texts. columns: rows of LEVEL by doc and i, of the kinds PAIR (an anchor, rank x of its string up to end) and PENDING."""
    is_anchor = columns["kind"] == PAIR
    v, c = ({name: x[which] for name, x in columns.items()} for which in (is_anchor, ~is_anchor))
    if not len(v["i"]):
        return c | {"kind": np.full(len(c["i"]), SETTLED), "x": np.full(len(c["i"]), -1)}
    docs = np.unique(columns["doc"])
    at = lambda rows, place: (np.searchsorted(docs, rows["doc"]) << 32) + place
    anchors, ends = at(v, v["i"]), at(v, v["end"])

    def look(wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        found = np.minimum(np.searchsorted(anchors, wanted), len(anchors) - 1)
        return found, anchors[found] == wanted

    left, begins = look(at(c, c["s"]))
    right = np.searchsorted(ends, at(c, c["hi"] + t))
    inside = np.minimum(np.maximum(left, right), len(ends) - 1)
    known = begins & (right < len(ends)) & (v["doc"][inside] == c["doc"]) & (v["a"][inside] <= v["end"][left])
    waiting = begins & ~known  # where even the first string is unique, the context counts as unique
    out = dict(c)
    out["kind"] = np.where(waiting, PENDING, SETTLED)
    out["x"], out["y"] = np.where(known, v["x"][left], -1), np.where(known, v["x"][inside], -1)
    out["d"], out["u"] = np.where(known, v["a"][inside] - v["a"][left], 0), np.where(known, c["a"] - v["a"][left], 0)
    use = np.ones(len(anchors), bool)
    if len(c["i"]):
        reach = np.zeros(len(anchors) + 1, np.int64)
        np.add.at(reach, left[waiting], 1)
        np.add.at(reach, inside[waiting] + 1, -1)
        use = np.cumsum(reach)[:-1] > 0
    partner, has = look(at(v, v["far"]))
    use &= has
    pairs = {name: x[use] for name, x in v.items()}
    partner = partner[use]
    pairs |= {"y": v["x"][partner], "d": v["a"][partner] - pairs["a"], "end": v["end"][partner], "far": v["far"][partner]}
    return {name: np.concatenate([pairs[name], out[name]]) for name in columns}


def level(rows: DataFrame, t: int) -> DataFrame:
    """level_of over all texts, each of which is held as a whole in the task that sorts it."""
    names = [f.split(" ")[0] for f in LEVEL.split(", ")]
    kinds = [pa.int64() if f.endswith("long") else pa.int32() for f in LEVEL.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            table = pa.Table.from_batches(parts)
            columns = level_of({name: table.column(name).to_numpy() for name in names}, t)
            return pa.RecordBatch.from_arrays([pa.array(columns[name]).cast(kind) for name, kind in zip(names, kinds, strict=True)], names)

        held: list[pa.RecordBatch] = []
        for batch in batches:
            doc = batch.column(1).to_numpy()
            cut = int(np.searchsorted(doc, doc[-1])) if len(doc) else 0
            if held and (cut or held[-1].column(1)[-1].as_py() != doc[0]):
                yield out([*held, batch.slice(0, cut)])
                held = [batch.slice(cut)]
            elif cut:
                yield out([batch.slice(0, cut)])
                held = [batch.slice(cut)]
            elif len(doc):
                held.append(batch)
        if held:
            yield out(held)

    return rows.select(*names).repartition("doc").sortWithinPartitions("doc", "i").mapInArrow(run, LEVEL)


def often(rows: DataFrame, by: list[str], name: str) -> DataFrame:
    """Combinations of `by` that occur twice or more, with their place in sorted order."""
    twice = rows.groupBy(*by).agg(F.count("*").alias("_n")).where("_n > 1").select(*by)
    return ranked(twice, [F.col(c) for c in by], name)


def contexts(found: DataFrame, t: int, put: Scratch) -> DataFrame:
    """Settled contexts of all owners whose K-gram occurs twice: LEVEL rows with ranks x and y, -1 if unique. found is dropped."""
    k = t // 2 + 1
    own = found.where("i >= 0")
    first = own.join(often(own, ["k1", "k2"], "r"), ["k1", "k2"]).drop("k1", "k2", "key")
    first = put.table(first.withColumn("id", F.monotonically_increasing_id()), "first")
    put.drop(found)
    blank = {"id": 0, "own": 0, "lo": 0, "hi": 0, "s": 0, "end": 0, "far": 0, "x": -1, "y": -1, "d": 0, "u": 0}
    kinds = dict(f.split(" ") for f in LEVEL.split(", "))

    def lines(rows: DataFrame, kind: int, **given) -> DataFrame:
        row = {"kind": F.lit(kind), "doc": F.col("doc"), "i": F.col("i"), "a": F.col("a")} | {c: F.lit(v) for c, v in blank.items()} | given
        return rows.select(*[row[c].cast(kind_of).alias(c) for c, kind_of in kinds.items()])

    anchor = lambda rows, **given: lines(rows, PAIR, far=F.col("far"), x=F.col("r"), **given)
    rows, settled = anchor(first, end=F.col("a") + k), None
    left = lines(first.where("lo <= hi"), PENDING, own=F.col("r"), **{c: F.col(c) for c in ("id", "lo", "hi", "s")})
    doubled = lambda pairs: anchor(pairs.join(often(pairs, ["x", "y", "d"], "r"), ["x", "y", "d"]), end=F.col("end"))
    once = put.table(level(rows, t), "level")  # no context is as short as one K-gram
    rows = doubled(once)
    while True:
        out = put.table(level(rows.unionAll(left), t), "level")
        if settled is None:
            put.drop(first, once)
        done, left = out.where(F.col("kind") == SETTLED), out.where(F.col("kind") == PENDING)
        settled = done if settled is None else settled.unionAll(done)
        if left.isEmpty():
            return settled
        rows = doubled(out.where(F.col("kind") == PAIR))


def mapped(rows: DataFrame, schema: str, of) -> DataFrame:
    """of(batch) → columns of schema, for each Arrow batch of rows."""
    names = [f.split(" ")[0] for f in schema.split(", ")]
    kinds = [{"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}[f.split(" ")[1]] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) if isinstance(c, list) else pa.array(c).cast(kind) for c, kind in zip(of(batch), kinds, strict=True)], names)

    return rows.mapInArrow(run, schema)


def digests(strings: Iterator[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, strings)), "<i8").reshape(-1, 2)


def slices(docs: DataFrame, wanted: DataFrame, t: int) -> DataFrame:
    """docs (key, text) and wanted (key, of: array of owners) → a row for each owner with the bytes of its windows."""

    def of(batch: pa.RecordBatch) -> list:
        texts, lists = batch.column(0).cast(pa.binary()).to_pylist(), batch.column(1)
        columns = dict(zip(("doc", "id", "own", "a", "lo", "hi"), (c.to_numpy() for c in lists.flatten().flatten()), strict=True))
        text = np.repeat(np.arange(len(texts)), lists.value_lengths().to_numpy())
        places = zip(text.tolist(), columns["lo"].tolist(), (columns["hi"] + t).tolist(), strict=True)
        return [*columns.values(), [texts[j][x:y] for j, x, y in places]]

    return mapped(docs.join(wanted, "key").select("text", "of"), "doc long, id long, own long, a int, lo int, hi int, body binary", of)


def blocks(borders: DataFrame, t: int) -> DataFrame:
    """Blocks of windows at equal distances before their owner: common part (i1, i2), whole (u1, u2), first and last window."""

    def of(batch: pa.RecordBatch) -> list:
        doc, id, own, a, lo, hi = (batch.column(j).to_numpy() for j in range(6))
        bodies = batch.column(6).to_pylist()
        first = (a - hi) // BLOCK
        n = (a - lo) // BLOCK - first + 1
        row = np.repeat(np.arange(len(n)), n)
        b = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + first[row]
        latest = a[row] - BLOCK * b
        x, y = np.maximum(lo[row], latest - BLOCK + 1), np.minimum(hi[row], latest)
        from_ = lo[row]
        parts = zip(row.tolist(), (latest - from_).tolist(), (latest - BLOCK + 1 + t - from_).tolist(), strict=True)
        common = digests(bodies[j][p:q] for j, p, q in parts)
        parts = zip(row.tolist(), (x - from_).tolist(), (y + t - from_).tolist(), strict=True)
        full = digests(bodies[j][p:q] for j, p, q in parts)
        return [doc[row], id[row], own[row], b, a[row] - x, a[row] - y, common[:, 0], common[:, 1], full[:, 0], full[:, 1], x, y]

    return mapped(borders, "doc long, id long, own long, b int, dx int, dy int, i1 long, i2 long, u1 long, u2 long, x int, y int", of)


def windows(borders: DataFrame, t: int) -> DataFrame:
    """borders with `of` (array of first and last windows) → a row for each window: own, delta, h1, h2, doc, id, p."""

    def of(batch: pa.RecordBatch) -> list:
        doc, id, own, a, lo = (batch.column(j).to_numpy() for j in range(5))
        bodies, lists = batch.column(5).to_pylist(), batch.column(6)
        x, y = (c.to_numpy() for c in lists.flatten().flatten())
        row = np.repeat(np.arange(len(a)), lists.value_lengths().to_numpy())
        n = y - x + 1
        p = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(x, n)
        row = np.repeat(row, n)
        h = digests(bodies[j][q : q + t] for j, q in zip(row.tolist(), (p - lo[row]).tolist(), strict=True))
        return [own[row], a[row] - p, h[:, 0], h[:, 1], doc[row], id[row], p]

    return mapped(borders.select("doc", "id", "own", "a", "lo", "body", "of"), "own long, delta int, h1 long, h2 long, doc long, id long, p int", of)


def shared(rows: DataFrame, by: list[str]) -> DataFrame:
    """Values of `by` that rows of two owners have, and the smaller id of both; copies of a text bring the same owner twice."""
    return rows.groupBy(*by).agg(F.min("id").alias("one"), F.max("id").alias("_other")).where("one != _other").drop("_other")


def repeats(docs: DataFrame, found: DataFrame, keys: DataFrame, t: int, put: Scratch) -> DataFrame:
    """(doc, start, end): strings of texts (docs: key, text; found: their anchors, dropped; keys: doc, key) in which every window of t bytes occurs elsewhere."""
    settled = contexts(found, t, put).withColumns({"dl": F.col("lo") - F.col("a"), "dh": F.col("hi") - F.col("a")})
    by, place = ["own", "x", "y", "d", "u", "dl", "dh"], ["doc", "id", "own", "a", "lo", "hi"]
    known = settled.where("x >= 0")
    classes = put.table(known.groupBy(*by).agg(F.count("*").alias("n"), F.min("id").alias("id")), "contexts")
    whole = known.join(classes.where("n > 1").select(*by), by, "left_semi").select("doc", F.col("lo").alias("start"), (F.col("hi") + t).alias("end"))
    ones = classes.select("own", "id", "n").unionAll(settled.where("x < 0").select("own", "id", F.lit(1).cast("long").alias("n")))
    border = ones.groupBy("own").agg(F.count("*").alias("_ones"), F.min("n").alias("_least")).where("_ones > 1 AND _least = 1").select("own")
    picked = settled.select(*place).join(ones.join(border, "own", "left_semi").select("id"), "id")
    wanted = put.table(picked.join(keys, "doc").groupBy("key").agg(F.collect_list(F.struct(*place)).alias("of")), "wanted")
    if wanted.count() * KEY_BYTES <= BROADCAST_BYTES:  # texts without borders needn't be shuffled
        docs = docs.join(F.broadcast(wanted.select("key")), "key", "left_semi")
    borders = put.table(slices(docs, wanted, t), "borders")
    cells = put.table(blocks(borders, t), "blocks")
    alive = cells.join(shared(cells, part := ["own", "b", "i1", "i2"]).drop("one"), part, "left_semi")
    alive = put.table(alive.join(shared(alive, all_of := ["own", "b", "dx", "dy", "u1", "u2"]), all_of, "left"), "alive")
    put.drop(cells)
    # blocks that aren't met as a whole, and one of each that is, if such a block shares its common part
    open_, alike = alive.where("one IS NULL"), alive.where("one = id")
    left = open_.select("id", "x", "y").unionAll(alike.join(open_.select(*part).distinct(), part, "left_semi").select("id", "x", "y"))
    left = left.groupBy("id").agg(F.collect_set(F.struct("x", "y")).alias("of"))
    dense = put.table(windows(borders.dropDuplicates(["id"]).join(left, "id"), t), "windows")
    met = ["own", "delta", "h1", "h2"]
    some = dense.join(shared(dense, met).drop("one"), met, "left_semi").select("doc", F.col("p").alias("start"), (F.col("p") + t).alias("end"))
    return whole.unionAll(alive.where("one IS NOT NULL").select("doc", F.col("x").alias("start"), (F.col("y") + t).alias("end"))).unionAll(some)


def joined(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The maximal runs that strings from starts to ends cover."""
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    first = np.flatnonzero(np.r_[True, starts[1:] > reach[:-1]])
    return starts[first], reach[np.r_[first[1:], len(starts)] - 1]


def runs_of(spans: DataFrame) -> DataFrame:
    """spans (doc, start, end) → (doc, runs), runs an array of starts and ends in turn."""

    def of(batch: pa.RecordBatch) -> Iterator[list[int]]:
        lists = batch.column(1)
        starts, ends = (c.to_numpy().astype(np.int64) for c in lists.flatten().flatten())
        cuts = np.cumsum(lists.value_lengths().to_numpy())[:-1]
        for own in zip(np.split(starts, cuts), np.split(ends, cuts), strict=True):
            yield np.stack(joined(*own), 1).ravel().tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(of(batch), pa.list_(pa.int64()))], ["doc", "runs"])

    return spans.groupBy("doc").agg(F.collect_list(F.struct("start", "end")).alias("of")).mapInArrow(run, "doc long, runs array<long>")


def without_repeats(docs: DataFrame, text: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """docs with `removed` (array of start and end, in bytes: maximal runs) and `kept` (the remaining bytes)."""
    if threshold < 2:
        raise ValueError("threshold must be 2 or more")
    key = free_name(docs, "key")
    removed, kept = (free_name(docs, name) for name in ("removed", "kept"))
    body = F.coalesce(F.col(text), F.lit(""))
    plain = docs.select(F.sha2(body.cast("binary"), 256).alias("key"), body.alias("text"))
    with scratch(docs.sparkSession, "suffixes") as put:
        found = put.table(anchors(plain, threshold), "anchors")
        keys = put.table(found.where("i < 0").select("doc", "key"), "keys")
        runs = runs_of(repeats(plain, found, keys, threshold, put)).join(keys, "doc").groupBy("key").agg(F.min_by("runs", "doc").alias("runs"))
        runs = materialize(runs, "suffix-runs")
    size = runs.agg(F.sum(KEY_BYTES + 8 * F.size("runs"))).first()[0] or 0
    of = free_name(docs, "runs")
    runs = runs.select(F.col("key").alias(key), F.col("runs").alias(of))
    cleaned = docs.withColumn(key, F.sha2(body.cast("binary"), 256)).join(F.broadcast(runs) if size <= BROADCAST_BYTES else runs, key, "left").select(*docs.columns, of)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            spans, rest = [], []
            for t, r in zip(batch.column(at).cast(pa.binary()).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
                t, r = t or b"", r or []
                edges = [0, *r, len(t)]
                spans.append([{"start": a, "end": b} for a, b in zip(r[::2], r[1::2], strict=True)])
                rest.append(b"".join([t[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(spans, span), pa.array(rest, pa.binary())], [*batch.schema.names[:-1], removed, kept])

    return cleaned.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(removed, T.ArrayType(SPAN)), T.StructField(kept, T.BinaryType())]))


def op12_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = without_repeats(read(spark, sf_dir, "documents").select("doc_id", "text"))
    length = F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return cleaned.select(
        "doc_id",
        F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"),
        length.alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
