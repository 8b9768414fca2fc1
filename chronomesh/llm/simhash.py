"""SimHash near-duplicates through pivot distance tables.

Fingerprints: 64-bit SimHash over word shingles (XXH64, seed 42). Equal fingerprints are
collapsed first. For every fingerprint left, a table holds its Hamming distances to many
reference fingerprints (pivots), each taken over one of four blocks of the bits. If two
fingerprints differ in at most two bits, at least two of the four blocks are equal, and
with them all distances to the pivots of these blocks. So the distances to the pivots of
two blocks, in each of the six choices, are exact join keys: no pair is lost. Pairs that
share a key are discarded by the largest difference of any coordinate (over 2), and the
survivors are verified bit by bit.

A key under which more than BUCKET fingerprints meet is refined: its bits that may still
differ are cut into four blocks again, and so on, so no group grows with the data (after
three times at most 2^8 fingerprints can share a key up to equal distances). Members of
one bucket give a spanning forest of their links, never all pairs. Components are found
by distributed union-find.

The pipeline's stage asks for a similarity of shingle sets, at which fingerprints of whole
texts differ in about ten bits, too many for blocks. So there a text is cut into parts by
its shingles' hashes, a few shingles each, and every part gets a fingerprint and its row of
the distance table. Alike texts have many parts in common, whose distances to all pivots are
equal, and these are the join keys; all that meet are verified on their shingles (see
`part_keys`).

Defined results: null, empty and blank texts have fingerprint zero and are linked like
any others; a text with fewer words than a shingle is one shingle. Rows with a null doc_id
are fingerprinted and linked, but give no component its id; a component of only such rows
has a null id. Repeated rows stay. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronomesh.llm.buckets import BAND, classes, distinct, mixed
from chronomesh.llm.common import free_name, materialize, read
from chronomesh.llm.components import components, forest

DISTANCE = 2
BLOCKS = 4
#: Pivots of each block.
PIVOTS = 6
BUCKET = 256
LEVELS = 4
HASH_SEED = 42
LANES = np.uint64(0x0101010101010101)


def fingerprints_of(texts: list[bytes | None], shingle: int) -> np.ndarray:
    """SimHash of each UTF-8 text."""
    digest, hashes, counts = xxhash.xxh64_intdigest, [], []
    for text in texts:
        words = text.lower().split() if text else []  # of bytes: A-Z only, and the six white-space bytes
        if len(words) <= shingle:
            new = [digest(b" ".join(words), HASH_SEED)] if words else []
        else:
            joined = b" ".join(words)
            ends = [*accumulate(map(len, words), lambda a, b: a + b + 1)]
            new = [digest(joined[a:b], HASH_SEED) for a, b in zip([0, *[e + 1 for e in ends[:-shingle]]], ends[shingle - 1 :], strict=True)]
        hashes += new
        counts.append(len(new))
    return majority(np.array(hashes, np.uint64), np.array(counts, np.int64))


def majority(h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """SimHash of each n hashes of h that follow each other; zero where there are none."""
    out = np.zeros(len(n), np.uint64)
    if not len(h):
        return out
    has = np.flatnonzero(n)
    # sums in byte lanes, for which blocks have at most 255 rows and never cross a text
    blocks = -(-n[has] // 255)
    first = np.cumsum(blocks) - blocks
    starts = np.repeat(np.cumsum(n[has]) - n[has], blocks) + 255 * (np.arange(blocks.sum()) - np.repeat(first, blocks))
    value = np.zeros(len(has), np.uint64)
    for k in range(8):
        lanes = np.add.reduceat((h >> np.uint64(k)) & LANES, starts).astype("<u8").view(np.uint8).reshape(-1, 8)
        ones = np.add.reduceat(lanes.astype(np.int64), first, axis=0)
        for byte in range(8):
            value |= (2 * ones[:, byte] > n[has]).astype(np.uint64) << np.uint64(8 * byte + k)
    out[has] = value
    return out


def fingerprints(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, fp) for every row of docs; fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                fp = fingerprints_of(part.column(1).to_pylist(), shingle).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fp)], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, fp long")


def blocks_of(mask: int) -> list[int]:
    """The bits of mask in BLOCKS parts, as masks."""
    bits = [i for i in range(64) if mask >> i & 1]
    return [sum(1 << i for i in bits[k * len(bits) // BLOCKS : (k + 1) * len(bits) // BLOCKS]) for k in range(BLOCKS)]


def pivots() -> np.ndarray:
    """The reference fingerprints: fixed, and alike on all machines."""
    return np.array([xxhash.xxh64_intdigest(f"pivot {i}", HASH_SEED) for i in range(PIVOTS)], np.uint64)


def table(fp: np.ndarray, mask: int) -> np.ndarray:
    """Distances to every pivot over every block of mask: shape (fingerprints, BLOCKS, PIVOTS)."""
    apart = fp[:, None] ^ pivots()[None, :]
    return np.stack([np.bitwise_count(apart & np.uint64(m)) for m in blocks_of(mask)], axis=1)


def packed(distances: np.ndarray) -> list[np.ndarray]:
    """For every block of a `table`, the distances to its pivots in one number."""
    part = distances.astype(np.uint64)
    return [sum(part[:, b, p] << np.uint64(5 * p) for p in range(PIVOTS)) for b in range(BLOCKS)]


def keyed(rows: DataFrame) -> DataFrame:
    """rows (bucket, left, fp), left: the bits that may differ within the bucket. A row for each choice of blocks taken as equal: its new bucket and what is left then."""
    choices = [*combinations(range(BLOCKS), BLOCKS - DISTANCE)]
    mix = np.uint64(0x9E3779B97F4A7C15)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bucket, left, fp = (batch.column(i).to_numpy(zero_copy_only=False).view(np.uint64) for i in range(3))
            for mask in np.unique(left):
                own = left == mask
                distances, of, masks = packed(table(fp[own], int(mask))), bucket[own], blocks_of(int(mask))
                for choice in choices:
                    key = of * mix + np.uint64(choices.index(choice) + 1)
                    for b in choice:
                        key = (key ^ distances[b]) * mix
                        key ^= key >> np.uint64(29)
                    rest = int(mask) & ~sum(masks[b] for b in choice)
                    arrays = [key.view(np.int64), np.full(len(key), rest, np.uint64).view(np.int64), fp[own].view(np.int64)]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], ["bucket", "left", "fp"])

    return rows.mapInArrow(run, "bucket long, left long, fp long")


def links(rows: DataFrame) -> DataFrame:
    """Links (a, b) among the fingerprints of each bucket, as a spanning forest. rows (bucket, fp): buckets lie whole in a partition and are sorted."""

    def found(bucket: np.ndarray, fp: np.ndarray) -> pa.RecordBatch | None:
        coordinates, ends, step = table(fp, (1 << 64) - 1).reshape(len(fp), -1).astype(np.int8), [], 1
        at = np.flatnonzero(bucket[:-1] == bucket[1:])
        while len(at):  # pairs that stand `step` apart in one bucket
            near = at[np.abs(coordinates[at] - coordinates[at + step]).max(axis=1) <= DISTANCE]
            near = near[np.bitwise_count(fp[near] ^ fp[near + step]) <= DISTANCE]
            ends.append((near, near + step))
            step += 1
            at = at[at + step < len(fp)]
            at = at[bucket[at] == bucket[at + step]]
        if not ends:
            return None
        a, b = (np.concatenate(x) for x in zip(*ends, strict=True))
        a, b = forest(fp[a].view(np.int64), fp[b].view(np.int64))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"]) if len(a) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_bucket, held_fp = np.empty(0, np.int64), np.empty(0, np.uint64)
        for batch in batches:
            bucket = np.concatenate([held_bucket, batch.column(0).to_numpy(zero_copy_only=False)])
            fp = np.concatenate([held_fp, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)])
            if not len(bucket):
                continue
            whole = int(np.searchsorted(bucket, bucket[-1]))  # the last bucket may go on
            if whole and (out := found(bucket[:whole], fp[:whole])) is not None:
                yield out
            held_bucket, held_fp = bucket[whole:], fp[whole:]
        if len(held_fp) and (out := found(held_bucket, held_fp)) is not None:
            yield out

    return rows.select("bucket", "fp").mapInArrow(run, "a long, b long")


def near_pairs(distinct: DataFrame) -> DataFrame:
    """Links (a, b) between distinct fingerprints (fp) at DISTANCE bits or fewer: enough of them to keep every component whole."""
    rows = distinct.select(F.lit(0).cast("long").alias("bucket"), F.lit(-1).cast("long").alias("left"), "fp")
    found = []
    for level in range(LEVELS):
        keys = materialize(keyed(rows), "simhash-keys")
        sizes = materialize(keys.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), "simhash-buckets")
        fits = F.col("n") <= BUCKET if level < LEVELS - 1 else F.lit(True)
        shared = keys.join(sizes, "bucket")
        found.append(materialize(links(shared.where(fits).repartition("bucket").sortWithinPartitions("bucket", "fp")), "simhash-links"))
        if level == LEVELS - 1 or sizes.where(~fits).isEmpty():
            break
        rows = materialize(shared.where(~fits).select("bucket", "left", "fp"), "simhash-large")
    out = found[0]
    for more in found[1:]:
        out = out.unionAll(more)
    return out


def cluster(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, fp, component_id) for every row of docs."""
    fps = materialize(fingerprints(docs, shingle), "simhash-fingerprints")
    distinct = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-distinct")
    roots = components(near_pairs(distinct.select("fp"))).withColumnRenamed("node", "fp")
    rooted = materialize(distinct.join(roots, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root")), "simhash-rooted")
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    ids = materialize(rooted.join(least, "root").select("fp", "component_id"), "simhash-components")
    return fps.join(ids, "fp")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cluster(read(spark, sf_dir, "documents"), 3)
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: For the stage: words in a shingle, and the similarity from which two documents are near-duplicates.
STAGE_SHINGLE, SIMILARITY = 5, 0.8
#: Parts of a text that get a key at most; shingles of a part on average, at most, where all parts get one and where not all do.
PARTS, FINE, COARSE = 32, 2.5, 5
#: Shingles that a part must have to get a key, in texts of more than PARTS * FINE.
FULL = 3
#: Bytes of ids that may be broadcast, at 32 a row; more are joined by a shuffle.
BROADCAST_BYTES = 16 << 20


def levels(n: np.ndarray) -> np.ndarray:
    """Binary logarithm of the parts that a text of n shingles is cut into: 16 at least."""
    log = lambda size: np.ceil(np.log2(np.maximum(n / size, 1))).astype(int)
    return np.maximum(4, np.minimum(log(FINE), np.maximum(PARTS.bit_length() - 1, log(COARSE))))


def part_keys(h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys, how many each text has): what texts are joined by. h: distinct shingle hashes, n of each text one after another, at least one.

    A key stands for the distances of a part's fingerprint to all pivots. Parts are cut by the
    first bits of a shingle's hash, so equal parts have equal keys. Texts of other sizes than
    SIMILARITY allows may be cut otherwise; any two within it have one way in common, as
    each is cut for the sizes a little below and above its own. At SIMILARITY
    a part of m shingles is free of differences with a probability of about exp(-m / 4), and
    two texts have no part in common about once in 7,000 cases, in the worst sizes.
    """
    spread, text = mixed(h), np.repeat(np.arange(len(n)), n)
    low, high = levels(n * 0.89), levels(n * 1.12)  # 1.12 / 0.89 is more than 1 / SIMILARITY
    keys, owners, factor = [], [], np.uint64(0x9E3779B97F4A7C15)
    for more in range(int((high - low).max(initial=-1)) + 1):
        level = low + more
        part = (spread >> (64 - level[text]).astype(np.uint64)).astype(np.int64)
        at = np.flatnonzero((part < PARTS) & (level <= high)[text])
        place = text[at] * PARTS + part[at]
        order = np.argsort(place, kind="stable")
        place, size = np.unique(place[order], return_counts=True)
        fp, of, part = majority(h[at[order]], size), place // PARTS, place % PARTS
        kept = (size >= FULL) | (n[of] <= PARTS * FINE)
        fp, of, part = fp[kept], of[kept], part[kept]
        key = (level[of] * PARTS + part + 1).astype(np.uint64)
        for distances in packed(table(fp, (1 << 64) - 1)):
            key = (key ^ distances) * factor
            key ^= key >> np.uint64(29)
        keys.append(((key & ~np.uint64(BAND)) | part.astype(np.uint64)).view(np.int64))
        owners.append(of)
    keys, owners = np.concatenate([np.empty(0, np.int64), *keys]), np.concatenate([np.empty(0, np.int64), *owners])
    return keys[np.argsort(owners, kind="stable")], np.bincount(owners, minlength=len(n))


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, copy, item, keys): copy is a hash of the text, item one of its words, keys are its `part_keys` over shingles of STAGE_SHINGLE words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                normal = [normal_form(t) for t in part.column(2).to_pylist()]
                items = [identity(t) for t in normal]
                h = [shingles(t) for t in normal]
                keys, counts = part_keys(np.concatenate(h), np.array([len(x) for x in h]))
                offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
                arrays = [part.column(0), part.column(1), pa.array(items, pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(keys))]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "copy", "item", "keys"])

    return plain(docs).mapInArrow(run, "doc_id long, copy long, item long, keys array<long>")


def plain(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("copy"), F.col("text").cast("binary").alias("text"))


def normal_form(text: bytes | None) -> bytes:
    return b" ".join(text.lower().split()) if text else b""


def identity(text: bytes) -> int:
    return xxhash.xxh64_intdigest(text, 7) - (1 << 63)


def shingles(text: bytes) -> np.ndarray:
    """64-bit hashes of the distinct shingles of STAGE_SHINGLE words of a text in normal form; a shorter text is one shingle."""
    n = STAGE_SHINGLE
    ends = [*accumulate(map(len, text.split(b" ")), lambda a, b: a + b + 1)]
    parts = [text[a:b] for a, b in zip([0, *[e + 1 for e in ends[:-n]]], ends[n - 1 :], strict=True)] if len(ends) > n else [text]
    return distinct(np.fromiter(map(xxhash.xxh64_intdigest, parts), np.uint64, len(parts)))


def matching(docs: DataFrame, side: DataFrame, how: str) -> DataFrame:
    """docs joined with side by (of, copy): the id and the hash of the text of a row of docs. side's columns must not be docs' own."""
    of, copy = (free_name(docs, x) for x in ("of", "copy"))
    side = side.withColumnsRenamed({"of": of, "copy": copy})
    small = 32 * side.count() <= BROADCAST_BYTES
    on = (F.col("doc_id").cast("long") == F.col(of)) & (F.xxhash64("text") == F.col(copy))
    out = docs.join(F.broadcast(side) if small else side, on, how)
    return out.drop(of, copy)


def near_texts(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """(node, root) for the texts of rows (sketches) that are SIMILARITY alike to another one.

    Texts meet where the distances to all pivots are equal for one of their parts, and all that meet are verified on their shingles.
    """
    places = materialize(rows.groupBy("item").agg(F.min(F.struct("doc_id", "copy")).alias("at")), "similar-items")

    def fetch(wanted: DataFrame) -> DataFrame:
        at = materialize(places.join(wanted, "item", "left_semi").select("item", F.col("at.doc_id").alias("of"), F.col("at.copy").alias("copy")), "similar-wanted")

        def normal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([normal_form(t) for t in batch.column(1).to_pylist()], pa.binary())], ["item", "text"])

        held = matching(docs.select("doc_id", "text"), at, "inner").select("item", F.col("text").cast("binary").alias("text"))
        return held.mapInArrow(normal, "item long, text binary").dropDuplicates(["item"])

    return classes(rows.select("item", "keys"), fetch, shingles, SIMILARITY)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: the one with the smallest doc_id, then the smallest hash of its text.

    Documents without a doc_id stay. Rows with the same doc_id and other texts are documents
    of their own; of rows with the same doc_id and text one stays, whichever it is.
    """
    own = docs.where(F.col("doc_id").isNotNull())
    rows = materialize(sketches(own), "similar")
    place = F.struct("doc_id", "copy")
    items = rows.groupBy("item").agg(F.min(place).alias("first"))
    roots = near_texts(own, rows).withColumnRenamed("node", "item")
    rooted = materialize(items.join(roots, "item", "left").select("item", "first", F.coalesce("root", "item").alias("root")), "similar-roots")
    least = rooted.groupBy("root").agg(F.min("first").alias("keep"))
    keep = rooted.join(least, "root").select("item", "keep")
    of = lambda rows: materialize(rows.select(F.col("doc_id").alias("of"), "copy").distinct(), "similar-rows")
    left = matching(own, of(rows.join(keep, "item").where(place != F.col("keep"))), "left_anti")
    twice = of(rows.groupBy("doc_id", "copy").count().where("count > 1"))
    if not twice.isEmpty():
        left = matching(left, twice, "left_anti").unionAll(matching(left, twice, "left_semi").dropDuplicates(["doc_id", "text"]))
    return left.unionAll(docs.where(F.col("doc_id").isNull()))
