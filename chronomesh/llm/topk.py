"""Exact top-k inner-product search with block-at-a-time pruning.

Vectors are cut by range of id into blocks of BLOCK rows. A block holds a forward index
(its vectors as one matrix) and, for every dimension (the "terms"), its largest and
smallest value. For a query, the sum over the terms of the largest contribution a block
could make is an upper bound of any score in it. A query visits the blocks in descending
order of that bound and stops at the first whose bound is below its k-th score so far, so
the result is exact.

Blocks meet queries by a shuffle: GROUPS ranges of blocks times groups of queries, each
pair of groups in one task call; a pair returns at most k rows a query, and a window over
those picks the final k. Nothing is broadcast or collected.

Defined results: vectors that are null or hold a null or non-finite component take no part,
nor do rows without an id. Vectors of different lengths are compared as if padded with
zeros, an empty one with zeros alone. Components count as floor(64 * x); scores beyond 64
bits are clipped. Rows that share an id are each a query and a candidate for the others, and
their answers tie; only a query's own row is left out. A query without candidates returns
no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from collections.abc import Iterator
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronomesh.llm.common import materialize, read

SCALE = 64
BLOCK = 256
QUERY_BLOCK = 512
QUERY_GROUP = 4
GROUPS = 2048
#: Blocks that meet in one task call at least.
LEAST = 32
NONE = np.iinfo(np.int64).min


def whole(x: Column) -> Column:
    """floor(SCALE * x) of every component; null unless all are finite."""
    finite = F.forall(x, lambda c: F.coalesce(~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) != float("inf")), F.lit(False)))
    return F.when(x.isNotNull() & finite, F.transform(x, lambda c: F.floor(F.lit(float(SCALE)) * c.cast("double")).cast("long")))


def trimmed(v: Column) -> Column:
    """v without the zeros at its end, so that vectors that are equal once padded are equal."""
    last = F.array_position(F.transform(F.reverse(v), lambda c: c != 0), True)
    return F.slice(v, F.lit(1), F.when(last > 0, F.size(v) - last + 1).otherwise(0).cast("int"))


def packed(rows: DataFrame, size: int) -> DataFrame:
    """rows (vec_id, v) as blocks of at most `size`, by range of vec_id: (block, dims, ids, matrix, once), the last three little-endian 64-bit.

    once: 1 for the first of rows with the same vec_id and vector. Equal rows tie, so leaving that one out is leaving a query's own row out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        number = (task.partitionId() if task else 0) << 32

        def out(rows: list[tuple[int, list[int]]]) -> pa.RecordBatch:
            nonlocal last
            once = [int(x != y) for x, y in zip([last, *rows[:-1]], rows, strict=True)]
            last = rows[-1]
            ids, vectors = zip(*rows, strict=True)
            dims = max(map(len, vectors))
            matrix = np.array([v + [0] * (dims - len(v)) for v in vectors], "<i8")
            row = {"block": number, "dims": dims, "ids": np.array(ids, "<i8").tobytes(), "matrix": matrix.tobytes(), "once": np.array(once, "<i8").tobytes()}
            return pa.RecordBatch.from_pylist([row], schema)

        schema = pa.schema([("block", pa.int64()), ("dims", pa.int32()), ("ids", pa.binary()), ("matrix", pa.binary()), ("once", pa.binary())])
        last: tuple[int, list[int]] | None = None
        held: list[tuple[int, list[int]]] = []
        for batch in batches:
            held += zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            while len(held) >= size:
                yield out(held[:size])
                held, number = held[size:], number + 1
        if held:
            yield out(held)

    ordered = rows.repartitionByRange("vec_id", "v").sortWithinPartitions("vec_id", "v")
    return ordered.mapInArrow(run, "block long, dims int, ids binary, matrix binary, once binary")


def unpacked(table: pa.Table, dims: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, matrix, once) of each block, padded to dims."""
    out = []
    for d, ids, matrix, once in zip(*(table.column(c).to_pylist() for c in ("dims", "ids", "matrix", "once")), strict=True):
        own = np.frombuffer(ids, "<i8")
        m = np.frombuffer(matrix, "<i8").reshape(len(own), d)
        out.append((own, np.pad(m, ((0, 0), (0, dims - d))), np.frombuffer(once, "<i8") == 1))
    return out


def products(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Exact inner products as 64-bit integers: in doubles where no partial sum can pass 2^53, else in whole numbers of any size."""
    most = float(np.abs(queries.astype(float)).max(initial=0)) * float(np.abs(vectors.astype(float)).max(initial=0)) * queries.shape[1]
    if most < 2**53:
        return (queries.astype(float) @ vectors.astype(float).T).astype(np.int64)
    exact = queries.astype(object) @ vectors.astype(object).T
    return np.clip(exact, -(2**63) + 1, 2**63 - 1).astype(np.int64)


def search(ids: np.ndarray, queries: np.ndarray, blocks: list[tuple[np.ndarray, np.ndarray, np.ndarray]], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Best k (vec_id, score) in blocks for each query; NONE where there are fewer."""
    n = len(ids)
    best_id, best = np.full((n, k), np.iinfo(np.int64).max), np.full((n, k), NONE)
    high, low = (np.stack([f(m, axis=0) for _, m, _ in blocks]).astype(float) for f in (np.max, np.min))
    q = queries.astype(float)
    bounds = np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T
    bounds += 1 + 1e-9 * (np.abs(q) @ np.maximum(np.abs(high), np.abs(low)).T)  # never below the exact sum, whatever is rounded
    order = np.argsort(-bounds, axis=1, kind="stable")
    alive = np.arange(n)
    for turn in range(len(blocks)):
        at = order[alive, turn]
        go = bounds[alive, at] >= best[alive, -1].astype(float)
        alive, at = alive[go], at[go]
        if not len(alive):
            break
        for block in np.unique(at):
            own = alive[at == block]
            block_ids, matrix, once = blocks[block]
            scores = products(queries[own], matrix)
            a, b = np.nonzero((ids[own][:, None] == block_ids[None, :]) & once[None, :])
            self = (queries[own][a] == matrix[b]).all(axis=1)
            scores[a[self], b[self]] = NONE
            better = (scores >= best[own, -1][:, None]).any(axis=1) & (scores.max(axis=1) > NONE)
            own, scores = own[better], scores[better]
            if not len(own):
                continue
            all_scores = np.concatenate([best[own], scores], axis=1)
            all_ids = np.concatenate([best_id[own], np.broadcast_to(block_ids, scores.shape)], axis=1)
            first = np.lexsort((all_ids, np.where(all_scores == NONE, 1, 0), -np.maximum(all_scores, NONE + 1)), axis=1)[:, :k]
            best[own], best_id[own] = np.take_along_axis(all_scores, first, 1), np.take_along_axis(all_ids, first, 1)
    return best_id, best


def top_k(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of vectors for each query; both have (vec_id, embedding)."""
    ready = lambda df: df.select(F.col("vec_id").cast("long").alias("vec_id"), trimmed(whole(F.col("embedding"))).alias("v")).where("vec_id IS NOT NULL AND v IS NOT NULL")
    blocks = materialize(packed(ready(vectors), BLOCK), "topk-blocks")
    asked = materialize(packed(ready(queries), QUERY_BLOCK), "topk-queries")
    numbered = lambda df, size: df.withColumn("g", F.floor((F.row_number().over(Window.orderBy("block")) - 1) / size))
    n_blocks, n_asked = blocks.count(), asked.count()
    per_group = max(LEAST, -(-n_blocks // GROUPS))
    groups, query_groups = -(-n_blocks // per_group), -(-n_asked // QUERY_GROUP)
    # only numbers are ordered as a whole; matrices stay where they are until they meet
    number = lambda df, size, name: df.join(numbered(df.select("block"), size), "block").withColumnRenamed("g", name)
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    schema = "q_block long, q_row int, query_id long, vec_id long, score long"
    if not groups or not query_groups:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["q_block", "q_row", "query_id", "vec_id", "score"]
        empty = pa.table([pa.array([], pa.int32() if c == "q_row" else pa.int64()) for c in names], names)
        if not left.num_rows or not right.num_rows:
            return empty
        dims, out = max(max(t.column("dims").to_pylist()) for t in (left, right)), [empty]
        index = unpacked(right, dims)
        for block, (ids, matrix, _) in zip(left.column("block").to_pylist(), unpacked(left, dims), strict=True):
            found, scores = search(ids, matrix, index, k)
            row, rank = np.nonzero(scores > NONE)
            columns = [np.full(len(row), block), row.astype(np.int32), ids[row], found[row, rank], scores[row, rank]]
            out.append(pa.table([pa.array(x) for x in columns], names))
        return pa.concat_tables(out)

    left = number(asked, QUERY_GROUP, "qg").withColumn("bg", each(groups))
    right = number(blocks, per_group, "bg").withColumn("qg", each(query_groups))
    met = left.groupBy("qg", "bg").cogroup(right.groupBy("qg", "bg")).applyInArrow(meet, schema)
    rank = F.row_number().over(Window.partitionBy("q_block", "q_row").orderBy(F.desc("score"), "vec_id"))
    return met.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return top_k(rows, rows.where(F.col("vec_id") % 20 == 0), 20)


ORACLE = """
WITH e AS (
  SELECT row_number() OVER () AS own, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0
), s AS (
  SELECT q.own, q.vec_id AS query_id, c.vec_id,
         CAST(coalesce(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])), 0) AS BIGINT) AS score
  FROM e q JOIN e c ON q.vec_id % 20 = 0 AND c.own <> q.own
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY own ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
