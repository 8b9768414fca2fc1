"""Classes of similar items by common keys: bucket stars, then everything that stars leave open, exactly.

Items come as (item, keys): a 64-bit identity and the band keys of its min-hashes, or the keys
of its parts. Items
with a common key share a bucket, and each is checked against the bucket's smallest item.
After a union-find, some buckets still hold items of different components that were never
compared. The items of such a bucket are brought together with their texts, and one task
compares all of them by an index over their rarest shingles, a prefix of which two alike
items must share one. What crosses the shuffle is a row for each item left open in a bucket,
never a row for each pair, and buckets of the same items count once.

Buckets too large for one task (mostly lines with a long passage in common) are taken apart
by what their items don't all have: the shingles of all these items are counted, and each
item is keyed by its prefix in the order of counts. Shingles that few items hold give all
pairs, of which the number of common prefix shingles rules out most before any text is read.
Shingles that more items hold are buckets again, compared as above; one that is still too
large is cut into blocks, and every block meets every other one. So two alike items that
share a key are never missed, whatever the size of their buckets.

For the stars, a bucket that many items share is cut into chunks with a smallest item each, and these
are compared among themselves, so no item meets an unbounded number of others and no task
holds an unbounded bucket. Which keys may be that large is read off a histogram of fixed size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronomesh.llm.common import materialize
from chronomesh.llm.components import components

#: Min-hashes of an item: the smallest shingle hash in each of so many cells of the hash's range.
CELLS = 60
#: Cells from which an empty one borrows, one after the other.
DONORS = np.random.default_rng(7).integers(0, CELLS, (CELLS, 24))
#: Items with a rare shingle up to which their pairs are made, to be told apart by their prefixes.
FEW = 32
#: Items, and bytes of their texts, of a bucket or block that one task compares.
LARGE, BYTES = 4096, 4 << 20
#: Items up to which all pairs are compared without an index.
PLAIN = 8
#: Bytes of shingle counts that may be broadcast; more are joined by a shuffle.
BROADCAST_BYTES = 16 << 20
#: Shingles that leave a task in one batch, about.
ROWS_OUT = 1 << 16
#: Cells of the histogram of keys, and rows from which a cell's keys are cut into chunks.
HISTOGRAM, CHUNK = 1 << 14, 20_000
#: One of so many items is looked at for that histogram, which only decides how rows are dealt out.
LOOK = 16
MIX = np.uint64(0x9E3779B97F4A7C15)
#: A key's lowest bits, which tell its band.
BAND = 31


def mixed(x: np.ndarray) -> np.ndarray:
    """x (uint64) with its bits spread over the whole number."""
    x = x ^ (x >> np.uint64(32))
    for _ in range(2):
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
    return x


def keys_of(h: np.ndarray, item: np.ndarray, n: int, rows: int) -> np.ndarray:
    """A key for every `rows` min-hashes of each of n items: shape (n, CELLS // rows). h: mixed shingle hashes; item: whose each one is, from 0; n: no one's."""
    cell = h >> np.uint64(40)  # in place from here on: arrays of all shingles are what takes the time
    cell *= np.uint64(CELLS)
    cell >>= np.uint64(24)
    cell = cell.view(np.int64)
    cell += item * CELLS
    own = np.full((n + 1) * CELLS, 1 << 36, np.int64)
    np.minimum.at(own, cell, (h & np.uint64((1 << 36) - 1)).view(np.int64))
    own[own == 1 << 36] = -1
    own = own[: n * CELLS].reshape(n, CELLS)
    least = own.copy()
    row, column = np.nonzero(own < 0)
    some = (own >= 0).any(axis=1)[row]
    row, column = row[some], column[some]
    for turn in range(DONORS.shape[1] + CELLS):
        if not len(row):
            break
        donor = DONORS[column, turn] if turn < DONORS.shape[1] else (column + turn) % CELLS
        value = own[row, donor]
        found = value >= 0
        least[row[found], column[found]] = value[found]
        row, column = row[~found], column[~found]
    band = np.arange(CELLS // rows, dtype=np.uint64)
    values, keys = least.astype(np.uint64).reshape(n, -1, rows), np.broadcast_to(band + np.uint64(1), (n, len(band)))
    for i in range(rows):
        keys = (keys ^ values[:, :, i]) * MIX
        keys ^= keys >> np.uint64(31)
    keys = (keys & ~np.uint64(BAND)) | band
    return keys.view(np.int64)


def distinct(values: np.ndarray) -> np.ndarray:
    """The distinct values in ascending order; the array given is used up."""
    values.sort()
    return values[np.concatenate([[True], values[1:] != values[:-1]])] if len(values) else values


def similarity_of(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two arrays of distinct values."""
    both = np.concatenate([a, b])
    both.sort()
    common = int(np.count_nonzero(both[1:] == both[:-1]))
    return common / max(1, len(both) - common)


def verified(pairs: DataFrame, texts: DataFrame, shingles: Callable[[bytes], np.ndarray], similarity: float) -> DataFrame:
    """Those of pairs (a, b, root_a, root_b) whose texts (item, text) have a Jaccard similarity of at least that."""
    kept = ["a", "b", "root_a", "root_b"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own = b"", shingles(b"")
        for batch in batches:
            alike = []
            for text_a, text_b in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True):
                if text_a != last:
                    last, own = text_a, shingles(text_a)
                alike.append(similarity_of(own, shingles(text_b)) >= similarity)
            yield batch.select(kept).filter(pa.array(alike, pa.bool_()))

    text = lambda end: texts.select(F.col("item").alias(end), F.col("text").alias(f"text_{end}"))
    both = pairs.join(text("b"), "b").join(text("a"), "a").select(*kept, "text_a", "text_b")
    return both.mapInArrow(run, "a long, b long, root_a long, root_b long")


def histogram_cell(key: Column) -> Column:
    return F.pmod(F.shiftright(key, BAND.bit_length()), F.lit(HISTOGRAM)).cast("int")


def large_cells(rows: DataFrame, share: float = 1) -> DataFrame:
    """(cell, chunks) of the histogram's cells whose keys may be large; rows (key, ...): about that share of all rows."""
    sizes = rows.groupBy(histogram_cell(F.col("key")).alias("cell")).agg((F.count("*") / share).alias("n"))
    sizes = materialize(sizes, "bucket-sizes")  # HISTOGRAM rows at most
    most = sizes.agg(F.greatest(F.lit(float(CHUNK)), 4 * F.sum("n") / HISTOGRAM).alias("most"))
    return sizes.withColumn("most", most.scalar()).where("n > most").select("cell", F.ceil(F.col("n") / F.col("most")).cast("int").alias("chunks"))


def dealt(rows: DataFrame, item: str, large: DataFrame) -> DataFrame:
    """rows (key, item, ...) with chunk: 0, but for keys of the cells in large, whose items are dealt over chunks from 1 on."""
    chunk = F.coalesce(F.pmod(F.xxhash64(item), F.col("chunks")) + 1, F.lit(0)).cast("int")
    return rows.withColumn("cell", histogram_cell(F.col("key"))).join(F.broadcast(large), "cell", "left").select(*rows.columns, chunk.alias("chunk"))


def chunked(rows: DataFrame, item: str = "item", look: DataFrame | None = None, share: float = 1) -> DataFrame:
    """rows (key, item, ...) with chunk: 0, but for keys that may be large, whose items are dealt over chunks from 1 on.

    look: where reading all rows twice is dear, about that share of them; its sizes decide only how rows are dealt out.
    """
    return dealt(rows, item, large_cells(rows if look is None else look, share))


def shared_rows(rows: DataFrame) -> DataFrame:
    """(key, item, rep, chunk) of keys and chunks that several items share, each item once; rep: the smallest of them. rows (key, item), and chunk if there are any."""
    by = [x for x in ("key", "chunk") if x in rows.columns]

    def found(key: np.ndarray, item: np.ndarray, chunk: np.ndarray) -> pa.RecordBatch:
        start = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (chunk[1:] != chunk[:-1])]))
        low, size = np.minimum.reduceat(item, start), np.diff(start, append=len(key))
        several = (low != np.maximum.reduceat(item, start)) | (chunk[start] > 0)
        kept, size, low = np.repeat(several, size), size[several], low[several]
        of, item = np.repeat(np.arange(len(size)), size), item[kept]
        order = np.lexsort((item, of))
        order = order[np.concatenate([[True], (np.diff(of[order]) > 0) | (np.diff(item[order]) != 0)])] if len(order) else order
        arrays = [key[kept][order], item[order], low[of[order]], chunk[kept][order].astype(np.int32)]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], ["key", "item", "rep", "chunk"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, np.int64)] * 3
        for batch in batches:
            columns = [x.to_numpy(zero_copy_only=False) for x in batch.columns]
            columns += [np.zeros(len(columns[0]), np.int64)] * (3 - len(columns))
            rows = [np.concatenate(x) for x in zip(held, columns, strict=True)]
            if not len(rows[0]):
                continue
            new = (rows[0][1:] != rows[0][:-1]) | (rows[2][1:] != rows[2][:-1])
            last = int(np.flatnonzero(new)[-1]) + 1 if new.any() else 0  # the last chunk may go on
            if last:
                yield found(*(x[:last] for x in rows))
            held = [x[last:] for x in rows]
        if len(held[0]):
            yield found(*held)

    return rows.repartition(*by).sortWithinPartitions(*by).mapInArrow(run, "key long, item long, rep long, chunk int")


def pairs_of(a: DataFrame, b: DataFrame, on: str | list) -> DataFrame:
    """Pairs (a, b, root_a, root_b) of items of different components that meet."""
    side = lambda rows, x: rows.withColumnsRenamed({"item": x, "root": f"root_{x}"})
    return side(a, "a").join(side(b, "b"), on).where("a <> b AND root_a <> root_b").select("a", "b", "root_a", "root_b")


def met(table: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members, pairs) of the buckets that several items share. table (item, keys).

    members (key, item, done), done: compared with all others of its bucket; pairs
    (a, b, root_a, root_b): each item with its chunk's smallest, and the smallest of a
    bucket's chunks with the smallest of all. Items are components of their own so far.
    """
    rows = lambda items: items.where(F.size("keys") > 0).select(F.explode("keys").alias("key"), "item")
    large = large_cells(rows(table.where(F.pmod(F.xxhash64("item"), F.lit(LOOK)) == 0)), 1 / LOOK)
    # rows without a chunk are shorter, and mostly there is none
    shared = shared_rows(rows(table) if large.isEmpty() else dealt(rows(table), "item", large))
    shared = materialize(shared, "buckets")
    pairs = shared.where("item <> rep").select(F.col("rep").alias("a"), F.col("item").alias("b"), F.col("rep").alias("root_a"), F.col("item").alias("root_b"))
    # a row for each chunk; those of one key are few
    chunks = shared.where("chunk > 0").select("key", F.col("rep").alias("item"), F.col("rep").alias("root")).distinct()
    lowest = chunks.groupBy("key").agg(F.min(F.struct("item", "root")).alias("low")).select("key", "low.item", "low.root")
    pairs = pairs.unionAll(pairs_of(materialize(lowest, "bucket-lowest"), chunks, "key")).dropDuplicates(["a", "b"])
    done = (F.col("item") == F.col("rep")) & (F.col("chunk") == 0)
    return shared.select("key", "item", done.alias("done")), pairs


def open_members(members: DataFrame, roots: DataFrame, sizes: DataFrame) -> DataFrame:
    """Members (key, item, root, n, bytes) that aren't done, of buckets with such members in different components; n, bytes: how many, and of how much text. sizes: (item, bytes)."""
    left = members.where("NOT done").join(roots.withColumnRenamed("node", "item"), "item", "left").select("key", "item", F.coalesce("root", "item").alias("root"))
    return told_once(left.join(sizes, "item"))


def told_once(left: DataFrame) -> DataFrame:
    """Rows (key, item, root, bytes) of keys that several components share, with n and bytes of the key; of keys that the same items have one stays."""
    left = materialize(left, "bucket-members")
    same = [F.bit_xor(F.xxhash64("item", F.lit(seed))).alias(f"same{seed}") for seed in (0, 1)]
    split = left.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n"), F.sum("bytes").alias("bytes"), *same)
    kept = split.where("low <> high").groupBy("n", "same0", "same1").agg(F.min("key").alias("key"), F.max("bytes").alias("bytes"))
    return left.drop("bytes").join(kept.select("key", "n", "bytes"), "key")


def linked(roots: list[int], sides: list[int], texts: list[bytes], shingles: Callable[[bytes], np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Edges between the roots of alike texts of different sides, if there are several; no more than join what they connect."""
    n, sets, across = len(roots), [shingles(t) for t in texts], len(set(sides)) > 1
    size, side = np.array([len(x) for x in sets]), np.array(sides)
    part = np.unique(np.array(roots), return_inverse=True)[1]
    edges: list[tuple[int, int]] = []

    def join(i: int, j: int) -> None:
        edges.append((roots[i], roots[j]))
        part[part == part[i]] = part[j]

    def apart(j: int, others: np.ndarray) -> np.ndarray:
        near = (np.minimum(size[others], size[j]) >= similarity * np.maximum(size[others], size[j]) * (1 - 1e-9)) & (part[others] != part[j])
        return others[near & (side[others] != side[j]) if across else near]

    if n <= PLAIN:
        for j in range(1, n):
            for i in apart(j, np.arange(j)).tolist():
                if part[i] != part[j] and similarity_of(sets[i], sets[j]) >= similarity:
                    join(i, j)
        return edges
    begin = np.concatenate([[0], np.cumsum(size)])
    _, of, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    order = np.empty(len(count), np.int64)
    order[np.argsort(count, kind="stable")] = np.arange(len(count))
    base = np.repeat(np.arange(n) * len(count), size)
    own = np.sort(base + order[of]) - base  # of each text, rarest shingles first
    lone = np.add.reduceat((count[of] < 2).astype(np.int64), begin[:-1])  # shingles that no other item has come first
    length = (size - np.ceil(size * similarity - 1e-9) + 1).astype(int)
    place = np.arange(len(own)) - np.repeat(begin[:-1], size)
    first = np.flatnonzero((place >= np.repeat(lone, size)) & (place < np.repeat(length, size)))  # the texts' prefixes
    shingle, whose = own[first], np.repeat(np.arange(n), size)[first]
    by = np.argsort(shingle, kind="stable")  # texts that have a shingle in their prefix, ascending
    having, at = whose[by], np.empty(len(by), np.int64)
    at[by] = np.arange(len(by))
    low = np.searchsorted(shingle[by], shingle)  # having[low:at]: the earlier ones
    ends = np.searchsorted(whose, np.arange(n + 1))
    mark, near = np.zeros(len(count), np.uint8), np.zeros(n, bool)
    for j in np.unique(whose[at > low]).tolist():
        near[:j] = False
        for x, y in zip(low[ends[j] : ends[j + 1]].tolist(), at[ends[j] : ends[j + 1]].tolist(), strict=True):
            near[having[x:y]] = True
        if not len(others := apart(j, np.flatnonzero(near[:j]))):
            continue
        mark[own[begin[j] : begin[j + 1]]] = 1
        if 4 * len(others) > j:
            common = np.add.reduceat(mark[own[: begin[j]]], begin[:j], dtype=np.int64)[others]
        else:
            common = np.array([np.count_nonzero(mark[own[begin[i] : begin[i + 1]]]) for i in others.tolist()])
        mark[own[begin[j] : begin[j + 1]]] = 0
        for i in others[common / np.maximum(1, size[others] + size[j] - common) >= similarity].tolist():
            if part[i] != part[j]:
                join(i, j)
    return edges


def compared(rows: DataFrame, texts: DataFrame, shingles: Callable[[bytes], np.ndarray], similarity: float) -> DataFrame:
    """Edges (root_a, root_b) that join the components of all alike items that share a key. rows (key, item, root, n, bytes).

    A key with more than a task compares is cut into blocks, and each pair of blocks is compared by one task.
    """
    parts = F.greatest(F.lit(1), F.ceil(F.col("n") / LARGE), F.ceil(F.col("bytes") / BYTES)).cast("int")
    dealt = rows.select("key", "item", "root", parts.alias("parts")).withColumn("side", F.pmod(F.xxhash64("item"), F.col("parts")).cast("int"))
    cells = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda q: F.struct(F.least("side", q).alias("low"), F.greatest("side", q).alias("high")))
    held = dealt.withColumn("cell", F.explode(cells)).select("item", "key", "cell.low", "cell.high", "side", "root").join(texts.select("item", "text"), "item")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, rows = None, []

        def out() -> Iterator[pa.RecordBatch]:
            roots, sides, own = zip(*rows, strict=True)
            if len(set(roots)) > 1 and (found := linked(roots, sides, own, shingles, similarity)):
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], ["root_a", "root_b"])

        for batch in batches:
            for *key, side, root, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != last:
                    if rows:
                        yield from out()
                    last, rows = key, []
                rows.append((root, side, text))
        if rows:
            yield from out()

    held = held.select("key", "low", "high", "side", "root", "text").repartition("key", "low", "high").sortWithinPartitions("key", "low", "high")
    return held.mapInArrow(run, "root_a long, root_b long").distinct()


def all_pairs(few: DataFrame, possible: Callable[[DataFrame], DataFrame] = lambda pairs: pairs) -> DataFrame:
    """All pairs (a, b, root_a, root_b) of items (key, item, root, ...) of different components that share a key, each made under the smallest key they share only.

    possible: drops pairs that can't be alike, from columns of few that come with _a and _b at their ends.
    """
    own = few.groupBy("item").agg(F.collect_set("key").alias("keys"))
    held = materialize(few.join(own, "item"), "buckets-few")
    a, b = (held.select("key", *[F.col(c).alias(f"{c}_{x}") for c in held.columns if c != "key"]) for x in "ab")
    once = F.col("key") == F.array_min(F.array_intersect("keys_a", "keys_b"))
    met = a.join(b, "key").where((F.col("item_a") < F.col("item_b")) & (F.col("root_a") != F.col("root_b")) & once)
    return possible(met).select(F.col("item_a").alias("a"), F.col("item_b").alias("b"), "root_a", "root_b")


def shingle_rows(held: DataFrame, shingles: Callable[[bytes], np.ndarray]) -> DataFrame:
    """(item, size, shingle) for every distinct shingle of held's (item, text); size: how many the item has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(items: list[int], sets: list[np.ndarray]) -> pa.RecordBatch:
            sizes = [len(x) for x in sets]
            columns = [np.repeat(np.array(items, np.int64), sizes), np.repeat(np.array(sizes, np.int32), sizes), np.concatenate(sets).view(np.int64)]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["item", "size", "shingle"])

        for batch in batches:
            items, sets, n = [], [], 0
            for item, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                items.append(item)
                sets.append(shingles(text))
                n += len(sets[-1])
                if n >= ROWS_OUT:
                    yield out(items, sets)
                    items, sets, n = [], [], 0
            if items:
                yield out(items, sets)

    return held.select("item", "text").mapInArrow(run, "item long, size int, shingle long")


def least_common(size: Column, similarity: float) -> Column:
    """Shingles that an item of that size has in common with any alike one, at least."""
    return F.ceil(size * F.lit(similarity) - F.lit(1e-9))


def rare_shingles(items: DataFrame, texts: DataFrame, shingles: Callable[[bytes], np.ndarray], similarity: float) -> DataFrame:
    """(item, root, size, prefix): the item's prefix, as (n, key) for those shingles that several of items (item, root) hold, rarest first.

    In one order of all shingles two alike items share one of the first size - least_common + 1
    of each. The order is by n, how many items hold a shingle, then by the shingle.
    """
    rows = shingle_rows(items.join(texts, "item"), shingles)
    counts = materialize(rows.groupBy("shingle").agg(F.count("*").alias("n")).where("n > 1"), "bucket-shingles")
    small = 16 * counts.count() <= BROADCAST_BYTES
    found = rows.join(F.broadcast(counts) if small else counts, "shingle").groupBy("item", "size").agg(F.sort_array(F.collect_list(F.struct("n", "shingle"))).alias("all"))
    # shingles that no other item holds come first, and take their places in the prefix
    length = F.col("size") - least_common(F.col("size"), similarity) + 1 - (F.col("size") - F.size("all"))
    key = lambda x: F.struct(x["n"].alias("n"), F.xxhash64(x["shingle"]).bitwiseAND(~BAND).alias("key"))
    prefix = F.transform(F.slice("all", 1, F.greatest(length, F.lit(0)).cast("int")), key)
    return items.join(found.select("item", "size", prefix.alias("prefix")).where(F.size("prefix") > 0), "item")


def may_be_alike(similarity: float) -> Callable[[DataFrame], DataFrame]:
    """Keeps pairs (size_a, size_b, prefix_a, prefix_b) that can have the common shingles which alike items of their sizes need.

    What is common to two items lies in both prefixes, or behind the end of the one that ends first.
    """

    def possible(pairs: DataFrame) -> DataFrame:
        common = F.size(F.array_intersect(F.col("prefix_a.key"), F.col("prefix_b.key")))
        behind = F.greatest(least_common(F.col("size_a"), similarity), least_common(F.col("size_b"), similarity)) - 1
        needed = least_common(F.col("size_a") + F.col("size_b"), similarity / (1 + similarity))
        return pairs.where(common + behind >= needed)

    return possible


def merged(roots: DataFrame | None, edges: DataFrame) -> DataFrame:
    """roots (node, root) after edges (root_a, root_b) between components; nodes that roots lack are components of their own."""
    new = components(edges.select(F.col("root_a").alias("a"), F.col("root_b").alias("b")))
    if roots is None:
        return new
    up = new.select(F.col("node").alias("root"), F.col("root").alias("top"))
    known = roots.join(up, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    return materialize(known.unionAll(new.join(roots, "node", "left_anti").select("node", "root")), "bucket-roots")


def classes(
    table: DataFrame,
    fetch: Callable[[DataFrame], DataFrame],
    shingles: Callable[[bytes], np.ndarray],
    similarity: float,
) -> DataFrame:
    """(node, root) for the items that are linked to another one.

    table: (item, keys). fetch: the texts (item, text) of given items. shingles: those of a
    text, as distinct 64-bit numbers.
    """
    members, pairs = met(table)
    texts = materialize(fetch(members.select("item").distinct()).withColumn("bytes", F.length("text")), "bucket-texts")
    check = lambda pairs: materialize(verified(materialize(pairs, "bucket-pairs"), texts, shingles, similarity), "bucket-edges")
    sizes, ends = texts.select("item", "bytes"), ["root_a", "root_b"]
    roots = merged(None, check(pairs))
    left = materialize(open_members(members, roots, sizes), "buckets-open")
    small = (F.col("n") <= LARGE) & (F.col("bytes") <= BYTES)
    edges, many = compared(left.where(small), texts, shingles, similarity), left.where(~small)
    if not many.isEmpty():
        rare = materialize(rare_shingles(many.select("item", "root").distinct(), texts.select("item", "text"), shingles, similarity), "bucket-rare")
        rows = rare.withColumn("of", F.explode("prefix")).select("of.key", "of.n", "item", "root", "size", "prefix")
        edges = edges.unionAll(check(all_pairs(rows.where(F.col("n") <= FEW).drop("n"), may_be_alike(similarity))).select(ends))
        held = told_once(rows.where(F.col("n") > FEW).select("key", "item", "root").distinct().join(sizes, "item"))
        edges = edges.unionAll(compared(held, texts, shingles, similarity))
    return merged(roots, materialize(edges, "bucket-edges"))
