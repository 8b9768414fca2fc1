"""Mixing sources to target weights by capped water-filling, with seeded whole and fractional repetitions.

Every source gets a share of the total by its weight; a target stops at `max_epochs` times
its source's size, and what is left over goes to the other sources by weight until no
target is above its cap. The fixed point of that is one water level: target = min(cap,
level * weight), and the level follows from the sources sorted by cap / weight, with one
row per source.

A source's whole repetitions are its target divided by its size. The rest is taken from
its documents in a seeded order (the digest of seed and doc_id) until it is used up; the
last document gives only part of its words. To find that document no source is ever
sorted as a whole: sizes are summed by digest prefix first, and only documents under one
prefix of each source are ordered. What is kept is one cut (a digest) for each source, so
every row decides for itself and texts are never shuffled.

Defined results: null texts have size 0 and take nothing; null is a source of its own and
comes last; a null doc_id is digested as an empty one. Rows with the same doc_id and source
are taken or left together, and where the cut falls on them they share the words left over
by size. An empty table gives an empty result. Extra columns pass through the stage.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronomesh.llm.common import free_name, materialize, n_words, read, words

WEIGHTS = (1, 2, 3)
MAX_EPOCHS = 3
SEED = "mix-1"
#: Documents of a source that one digest prefix may hold on average; the prefix grows with the table.
PER_PREFIX = 20_000


def digest(doc_id: Column, seed: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))))


def targets(sizes: DataFrame, weights: tuple, max_epochs: int) -> DataFrame:
    """One row per source: source, source_size, target. sizes: (source, size)."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    level = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = level.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    share = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    rows = (
        sizes.groupBy("source")
        .agg(F.sum("size").alias("source_size"))
        .withColumn("weight", share)
        .withColumn("cap", F.col("source_size").cast("double") * max_epochs)
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(every).cast("double"))
        .withColumn("weight_left", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("total_left", F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("capped", F.col("cap") * F.col("weight_left") <= F.col("total_left") * F.col("weight"))
    )
    first = F.min(F.when(~F.col("capped"), F.struct("ratio", "total_left", "weight_left"))).over(every)
    water = first["total_left"] / first["weight_left"]
    return rows.select("source", "source_size", F.when(F.col("capped"), F.col("cap")).otherwise(water * F.col("weight")).alias("target"))


def plan(sized: DataFrame, weights: tuple = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """One row per source with its target, whole repetitions and cut. sized: (source, size, digest)."""
    goal = F.round("target").cast("long")
    per_source = (
        targets(sized.select("source", "size"), weights, max_epochs)
        .withColumn("whole", F.when(F.col("source_size") > 0, F.floor(goal / F.col("source_size"))).otherwise(F.lit(0)))
        .withColumn("rest", goal - F.col("whole") * F.col("source_size"))
    )
    per_source = materialize(per_source, "mix-sources")
    digits = max(1, math.ceil(math.log(max(1, sized.count() / PER_PREFIX), 16)))
    prefix = F.substring("digest", 1, digits)

    def crossing(rows: DataFrame, key: str) -> DataFrame:
        """The row of each source in which the running sum of its sizes, in order of key, reaches what is wanted."""
        upto = F.sum("n").over(Window.partitionBy("source").orderBy(key).rowsBetween(Window.unboundedPreceding, 0))
        return rows.withColumn("upto", upto).where((F.col("upto") - F.col("n") < F.col("want")) & (F.col("want") <= F.col("upto")))

    def same(rows: DataFrame, other: DataFrame) -> DataFrame:
        other = other.withColumnRenamed("source", "_s")
        return rows.join(other, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")

    sums = sized.groupBy("source", prefix.alias("prefix")).agg(F.sum("size").alias("n"))
    at = crossing(same(sums, per_source.select("source", F.col("rest").alias("want"))), "prefix")
    at = materialize(at.select("source", F.col("prefix").alias("_prefix"), (F.col("want") - (F.col("upto") - F.col("n"))).alias("want")), "mix-prefixes")
    near = same(sized, at).where(prefix == F.col("_prefix")).groupBy("source", "digest", "want").agg(F.sum("size").alias("n"))
    cut = crossing(near, "digest").select(
        F.col("source").alias("_s"), F.col("digest").alias("cut"), (F.col("want") - (F.col("upto") - F.col("n"))).alias("cut_words"), F.col("n").alias("cut_size")
    )
    return materialize(per_source.join(cut, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s", "rest"), "mix-plan")


def extra_words() -> Column:
    """Words that a document gives beyond its whole repetitions."""
    part = F.floor(F.col("cut_words").cast("double") * F.col("size") / F.col("cut_size"))
    return F.when(F.col("digest") < F.col("cut"), F.col("size")).when(F.col("digest") == F.col("cut"), part).otherwise(F.lit(0)).cast("long")


def sized(docs: DataFrame, seed: str) -> DataFrame:
    return docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), digest(F.col("doc_id"), seed).alias("digest"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = materialize(sized(read(spark, sf_dir, "documents"), SEED), "mix-sizes")
    sources = plan(docs).withColumnRenamed("source", "_s")
    return (
        docs.join(sources, F.col("source").eqNullSafe(F.col("_s")))
        .withColumn("taken", F.col("whole") * F.col("size") + extra_words())
        .select("doc_id", "size", "source_size", "target", "taken")
    )


def repeat(docs: DataFrame, seed: str = SEED, weights: tuple = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """docs mixed: each document as many times as it is taken whole, and once more with its first words where it is taken in part."""
    table = materialize(sized(docs, seed), "mix-sizes")
    names = {c: free_name(docs, c) for c in ("size", "digest", "_s", "_plan", "_part")}
    sources = plan(table, weights, max_epochs).select(F.col("source").alias(names["_s"]), F.struct("whole", "cut", "cut_words", "cut_size").alias(names["_plan"]))
    size, key, p = F.col(names["size"]), F.col(names["digest"]), F.col(names["_plan"])
    part = F.floor(p["cut_words"].cast("double") * size / p["cut_size"])
    extra = F.when(key < p["cut"], size).when(key == p["cut"], part).otherwise(F.lit(0))
    first = F.array_join(F.slice(words(F.col("text")), F.lit(1), F.col(names["_part"]).cast("int")), " ")
    whole = F.array_repeat(F.lit(0), (p["whole"] + F.when(extra >= size, 1).otherwise(0)).cast("int"))
    some = F.when((extra > 0) & (extra < size), F.array(extra.cast("int"))).otherwise(F.array().cast("array<int>"))
    mixed = (
        docs.withColumn(names["size"], n_words(F.col("text")))
        .where(size > 0)
        .withColumn(names["digest"], digest(F.col("doc_id"), seed))
        .join(sources, F.col("source").eqNullSafe(F.col(names["_s"])))
        .withColumn(names["_part"], F.explode(F.concat(whole, some)))
        .withColumn("text", F.when(F.col(names["_part"]) > 0, first).otherwise(F.col("text")))
    )
    if "n_chars" in docs.columns:
        mixed = mixed.withColumn("n_chars", F.when(F.col(names["_part"]) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return mixed.select(docs.columns)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return repeat(docs)


ORACLE = r"""
WITH s AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS digest
  FROM documents
), g AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CAST(1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS DOUBLE) AS weight
  FROM s GROUP BY source
), c AS (
  SELECT *, 3.0::DOUBLE * source_size AS cap, 3.0::DOUBLE * source_size / weight AS ratio FROM g
), l AS (
  SELECT *, sum(weight) OVER () - coalesce(sum(weight) OVER o, 0) AS weight_left,
         CAST(sum(source_size) OVER () AS DOUBLE) - coalesce(sum(cap) OVER o, 0) AS total_left
  FROM c WINDOW o AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), k AS (
  SELECT *, cap * weight_left <= total_left * weight AS capped FROM l
), u AS (
  SELECT total_left / weight_left AS level FROM k WHERE NOT capped ORDER BY ratio, source NULLS LAST LIMIT 1
), t AS (
  SELECT source, source_size, CASE WHEN capped THEN cap ELSE (SELECT level FROM u) * weight END AS target FROM k
), w AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(round(target) AS BIGINT) // source_size ELSE 0 END AS whole FROM t
), r AS (
  SELECT *, CAST(round(target) AS BIGINT) - whole * source_size AS rest FROM w
), d AS (
  SELECT source, digest, sum(size) AS n, sum(sum(size)) OVER (PARTITION BY source ORDER BY digest) AS upto
  FROM s GROUP BY source, digest
)
SELECT s.doc_id, s.size, r.source_size, r.target,
       CAST(r.whole * s.size + CASE WHEN d.upto <= r.rest THEN s.size
                                    WHEN d.upto - d.n < r.rest THEN floor(CAST(r.rest - (d.upto - d.n) AS DOUBLE) * s.size / d.n)
                                    ELSE 0 END AS BIGINT) AS taken
FROM s JOIN r ON s.source IS NOT DISTINCT FROM r.source
JOIN d ON s.source IS NOT DISTINCT FROM d.source AND s.digest = d.digest
"""
