"""Fuzzy line dedup: MinHash over character shingles, high-recall banding, exact verification, distributed union-find.

Lines are compared by their normal form (white space at the ends dropped, runs of it one
space); equal ones are one class from the start. Every other line gets min-hashes over its
shingles of LONGER characters, in bands; lines that share a band's key meet in a bucket. These
shingles are longer than those of the similarity because lines of one language share many
short ones, and would meet though they are far from alike. A bucket never emits all its pairs (see buckets.py): each line is verified against
the bucket's smallest one, and what a union-find then leaves in different components is
compared in full. Verified means a Jaccard similarity of the shingle sets of at
least SIMILARITY, computed on the lines themselves. At that similarity about 0.7 of the
longer shingles are common, and the bands miss two lines about once in 60 pairs.

Of each component the first occurrence stays, by doc_id, then line number. Blank lines are
never duplicates and always stay.

Defined results: null and empty texts have one blank line. Lines shorter than a shingle are
one shingle. Rows with equal doc_id and text are one document and get the same verdicts; rows
with equal doc_id and other texts are told apart by the text's hash. A null doc_id sorts
last. Very long lines are shingled whole. An empty table gives no rows. Extra columns pass
through the stage. Classes are told apart by a 64-bit hash of the normal form.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronomesh.llm.buckets import CELLS, classes, distinct, keys_of, mixed
from chronomesh.llm.common import free_name, let, materialize, read

#: Characters of a shingle for the similarity, and for the min-hashes.
SHINGLE, LONGER = 5, 8
SIMILARITY = 0.8
#: Min-hashes of a band, and bands of a line.
ROWS = 4
BANDS = CELLS // ROWS
#: Lines whose min-hashes are taken together.
TOGETHER = 4096
#: Bytes of line numbers that may be broadcast; more are joined by a shuffle.
BROADCAST_BYTES = 16 << 20
#: Line classes that a task remembers so as to give their keys only once.
REMEMBERED = 1 << 20


def normal(line: bytes) -> bytes:
    return b" ".join(line.split())


def numbers(data: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit number for every `size` characters (code points, uint32) that follow each other in data."""
    # numbers of one, two, four ... characters make up those of size, from its highest binary digit on
    one = out = data.astype(np.uint64)
    have, factor = 1, 0x9E3779B97F4A7C15
    for digit in bin(size)[3:]:
        out = out[:-have] * np.uint64(pow(factor, have, 1 << 64)) + out[have:]
        have *= 2
        if digit == "1":
            out = out[:-1] * np.uint64(factor) + one[have:]
            have += 1
    return out


def band_keys(lines: list[bytes]) -> np.ndarray:
    """A key for each band of each line: shape (lines, BANDS)."""
    # lines are set one after another; a short one is repeated up to one shingle
    texts = (x.decode("utf-8", "replace") for x in lines)
    padded = [x if len(x) >= LONGER else (x * LONGER)[:LONGER] for x in texts]
    data = np.frombuffer("".join(padded).encode("utf-32-le"), "<u4")
    sizes = np.array([len(x) for x in padded])
    of = np.repeat(np.arange(len(lines)), sizes)
    of[(np.cumsum(sizes)[:, None] - 1 - np.arange(LONGER - 1)).ravel()] = len(lines)  # shingles that reach into the next line are no one's
    return keys_of(mixed(numbers(data, LONGER)), of[: len(data) - LONGER + 1], len(lines), ROWS)


LINES = "doc_id long, copy long, line_no int, line long, keys array<long>"


def line_table(docs: DataFrame) -> DataFrame:
    """A row for each line that isn't blank; keys only where the task meets its class first. copy: hash of the document's text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for at in range(0, batch.num_rows, 32):  # few, so that arrays stay in the processor's cache
                part = batch.slice(at, 32)
                rows, numbers, hashes, new, where = [], [], [], [], []
                for row, text in enumerate(part.column(2).to_pylist()):
                    for no, raw in enumerate(text.split(b"\n")):
                        if not (line := normal(raw)):
                            continue
                        h = xxhash.xxh64_intdigest(line, 7) - (1 << 63)
                        if h not in seen:
                            seen.add(h)
                            where.append(len(hashes))
                            new.append(line)
                        hashes.append(h)
                        rows.append(row)
                        numbers.append(no)
                if not rows:
                    continue
                offsets = np.zeros(len(rows) + 1, np.int32)
                offsets[np.array(where, int) + 1] = BANDS
                values = np.concatenate([np.empty(0, np.int64), *(band_keys(new[i : i + TOGETHER]).ravel() for i in range(0, len(new), TOGETHER))])
                keys = pa.ListArray.from_arrays(pa.array(np.cumsum(offsets).astype(np.int32)), pa.array(values))
                of = pa.array(rows, pa.int32())
                arrays = [part.column(0).take(of), part.column(1).take(of), pa.array(numbers, pa.int32()), pa.array(hashes, pa.int64()), keys]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "copy", "line_no", "line", "keys"])
            if len(seen) > REMEMBERED:
                seen.clear()

    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("copy"), text.alias("text")).mapInArrow(run, LINES)


def wanted_texts(docs: DataFrame, first: DataFrame, wanted: DataFrame) -> DataFrame:
    """(item, text): the normal form of each wanted line class, read from the place where it stands first. first: (line, first)."""
    at = first.join(wanted.withColumnRenamed("item", "line"), "line", "left_semi")
    by_doc = at.groupBy(F.col("first.doc_id").alias("of"), F.col("first.copy").alias("of_copy")).agg(F.collect_list("first.line_no").alias("wanted"))
    by_doc = materialize(by_doc, "line-places")
    size = by_doc.agg(F.sum(40 + 4 * F.size("wanted"))).first()[0] or 0
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("copy"), "text")
    on = F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("copy") == F.col("of_copy"))
    held = own.join(F.broadcast(by_doc) if size <= BROADCAST_BYTES else by_doc, on).select(F.col("text").cast("binary").alias("text"), "wanted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {}
            for text, numbers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                all_lines = text.split(b"\n")
                for line in (normal(all_lines[n]) for n in numbers):
                    out[xxhash.xxh64_intdigest(line, 7) - (1 << 63)] = line
            yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.int64()), pa.array(list(out.values()), pa.binary())], ["item", "text"])

    return held.mapInArrow(run, "item long, text binary").dropDuplicates(["item"])


def shingles(text: bytes) -> np.ndarray:
    """The distinct shingles of a line, as 64-bit numbers."""
    line = text.decode("utf-8", "replace").ljust(SHINGLE, "\0")
    return distinct(numbers(np.frombuffer(line.encode("utf-32-le"), "<u4"), SHINGLE))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, copy, line_no, line, class, kept) for every line that isn't blank."""
    lines = materialize(line_table(docs), "lines")
    # a null doc_id sorts last; the order is that of the struct
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "copy", "line_no")
    first = materialize(lines.groupBy("line").agg(F.min(place).alias("first")), "lines-first")
    table = lines.select(F.col("line").alias("item"), "keys")
    roots = classes(table, lambda wanted: wanted_texts(docs, first, wanted), shingles, SIMILARITY)
    roots = roots.withColumnsRenamed({"node": "line", "root": "class"})
    classed = materialize(first.join(roots, "line", "left").select("line", F.coalesce("class", "line").alias("class"), "first"), "line-classes")
    best = classed.groupBy("class").agg(F.min("first").alias("keep"))
    decided = classed.join(best, "class").select("line", "class", "keep")
    return lines.drop("keys").join(decided, "line").select("doc_id", "copy", "line_no", "line", "class", (place == F.col("keep")).alias("kept"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "line_no", F.col("class").alias("class_id"), "kept")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without the lines that aren't kept. Documents all of whose lines go stay, with an empty text."""
    of, copy, gone = (free_name(docs, x) for x in ("of", "copy", "gone"))
    lost = dedup_lines(docs).where("NOT kept").groupBy("doc_id", "copy").agg(F.collect_set("line_no").alias(gone))
    lost = materialize(lost, "lines-gone").withColumnsRenamed({"doc_id": of, "copy": copy})
    on = F.col("doc_id").cast("long").eqNullSafe(F.col(of)) & (F.xxhash64("text") == F.col(copy))
    numbers = lambda lines: F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(gone))
    rest = let(F.split("text", "\n"), lambda lines: F.array_join(F.transform(numbers(lines), lambda i: lines[i]), "\n"))
    out = docs.join(lost, on, "left").withColumn("text", F.when(F.col(gone).isNull(), F.col("text")).otherwise(rest))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(gone).isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))
    return out.select(docs.columns)
