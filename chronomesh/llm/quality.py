"""Quality rules: countable base rules, then a hashed n-gram log-likelihood ratio between a trusted target and the raw corpus.

Every n-gram of a text (its words, and each two neighbouring ones) is hashed
into a fixed number of buckets. Two multinomials are counted over the buckets: one over
all documents (raw), one over documents labelled as good (target). A document's score is
the mean of log(p_target / p_raw) over its n-grams, so its length does not matter. The
threshold is a low quantile of the scores of all labelled good documents that took no part in
the counts, so it is the same for every document and for every run.

All of it is DataFrame functions. Texts are never shuffled: scoring happens in the row,
against one array of weights whose size is the number of buckets.

Defined results: null, empty and blank texts have no words, fail the base rules and are
not kept. Repeated rows are judged each on its own. With no labelled good document there
is no verdict beyond the base rules: whatever passes them is kept. Extra columns pass
through; those with the name of a result column are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronomesh.llm.common import SPACE, free_name, let, materialize, read, words

BUCKETS = 1 << 16
#: Labelled good documents that the target multinomial is fitted on: the first by hash of doc_id.
FIT_ROWS = 20_000
#: Held-out ids that may be broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 200_000
#: Ranks of the threshold's quantile are right to one in this many of the held-out documents.
ACCURACY = 1_000_000
#: Share of unseen trusted documents that the threshold may lose, and the margin below that quantile.
LOSS = 0.002
MARGIN = 0.05
SMOOTHING = 0.5
WINDOW = 8
SYMBOLS = "[#*$%&|<>]+"


def hashes(text: Column) -> Column:
    """One 64-bit hash for each word of text."""
    return F.transform(words(text), lambda w: F.xxhash64(w))


def neighbours(x: Column, by: int) -> Column:
    """A hash for each two elements of x that stand `by` apart."""
    return F.zip_with(F.slice(x, F.lit(1), F.greatest(F.size(x) - by, F.lit(0))), F.slice(x, by + 1, F.size(x)), lambda a, b: F.xxhash64(a, b))


def grams(h: Column, buckets: int) -> Column:
    """Buckets of a text's n-grams, its words and each two neighbouring words; h: hashes of the words."""
    return F.transform(F.concat(h, neighbours(h, 1)), lambda x: F.pmod(x, F.lit(buckets)).cast("int"))


def repeated_words(h: Column) -> Column:
    """Words that lie in a window of WINDOW words found twice or more; h: hashes of the words.

    Windows are compared by a 64-bit hash, made from those of its halves. Only texts that
    repeat a window go on to sort (hash, position); a repeated window then covers the words
    up to the next one's start.
    """
    windows = let(let(neighbours(h, 1), lambda x: neighbours(x, 2)), lambda x: neighbours(x, 4))

    def starts(h: Column) -> Column:
        """Ascending positions of the windows that have an equal one."""
        ordered = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        before = lambda s: F.concat(F.array(F.lit(None).cast("struct<h:bigint,i:int>")), F.slice(s, 1, F.size(s) - 1))
        marked = let(
            ordered,
            lambda s: F.zip_with(
                s,
                F.arrays_zip(before(s).alias("p"), F.slice(s, 2, F.size(s)).alias("n")),
                lambda x, y: F.when((x["h"] == y["p"]["h"]) | (x["h"] == y["n"]["h"]), x["i"]),
            ),
        )
        return F.sort_array(F.filter(marked, lambda i: i.isNotNull()))

    covered = lambda r: F.aggregate(
        F.zip_with(r, F.slice(r, 2, F.size(r)), lambda a, b: F.least(F.coalesce(b - a, F.lit(WINDOW)), F.lit(WINDOW))), F.lit(0), lambda x, y: x + y
    )
    return let(windows, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), let(starts(h), covered)).otherwise(0)).cast("long")


def base_columns(docs: DataFrame) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{SPACE[1:]}"))
    return (
        docs.withColumn("_h", hashes(F.col("text"))).withColumns(
            {
                "n_words": F.size("_h").cast("long"),
                "word_chars": F.length(F.regexp_replace(text, f"{SPACE}+", "")).cast("long"),
                "n_symbols": (F.length(text) - F.length(F.regexp_replace(text, SYMBOLS, ""))).cast("long"),
                "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
                "n_repeat_words": repeated_words(F.col("_h")),
                "_grams": grams(F.col("_h"), BUCKETS),
            }
        )
        .withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))
        .drop("_h")
    )


def counts(docs: DataFrame, buckets: int, name: str) -> DataFrame:
    """N-grams of docs by bucket; summed in each task before the shuffle, so at most `buckets` rows leave a task."""
    gram = docs.select(F.explode(let(hashes(F.col("text")), lambda h: grams(h, buckets))).alias("bucket"))
    return gram.groupBy("bucket").agg(F.count("*").alias(name))


def weights(spark: SparkSession, raw: DataFrame, target: DataFrame, buckets: int) -> DataFrame:
    """One row with one array: log(p_target / p_raw) for every bucket, both smoothed."""
    both = (
        spark.range(buckets)
        .select(F.col("id").cast("int").alias("bucket"))
        .join(raw, "bucket", "left")
        .join(target, "bucket", "left")
        .na.fill(0, ["raw", "target"])
    )
    rows = both.agg(
        F.array_sort(F.collect_list(F.struct("bucket", "raw", "target"))).alias("rows"), F.sum("raw").alias("n_raw"), F.sum("target").alias("n_target")
    )
    p = lambda n, total: (n + F.lit(SMOOTHING)) / (total + F.lit(SMOOTHING * buckets))
    return rows.select(
        F.transform("rows", lambda r: F.log(p(r["target"], F.col("n_target"))) - F.log(p(r["raw"], F.col("n_raw")))).alias("weights")
    )


def score(gram_buckets: Column, weight: Column) -> Column:
    total = F.aggregate(gram_buckets, F.lit(0.0), lambda a, b: a + weight[b])
    return F.when(F.size(gram_buckets) > 0, total / F.size(gram_buckets)).otherwise(F.lit(0.0))


def trusted(labels: DataFrame, held: bool, rows: int | None = None) -> DataFrame:
    """Ids of labelled good documents, at most `rows` if given, split in two by hash: those the target is fitted on and those held out."""
    fold = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(5)) == 0
    ids = labels.where((F.col("quality") == 1) & F.col("doc_id").isNotNull() & (fold if held else ~fold)).select("doc_id").distinct()
    return ids if rows is None else ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


def fit(corpus: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(weights, threshold), each one row with one column; the counts cover all of corpus."""
    spark = corpus.sparkSession
    ids = materialize(trusted(labels, False, FIT_ROWS), "quality-fit")
    held = materialize(trusted(labels, True), "quality-held")
    small = held.count() <= BROADCAST_ROWS
    raw = counts(corpus.select("text"), BUCKETS, "raw")
    target = counts(corpus.select("doc_id", "text").join(F.broadcast(ids), "doc_id", "left_semi"), BUCKETS, "target")
    table = materialize(weights(spark, raw, target, BUCKETS), "quality-weights")
    sample = (
        corpus.select("doc_id", "text")
        .join(F.broadcast(held) if small else held, "doc_id", "left_semi")
        .withColumn("_weights", table.scalar())
        .select(let(let(hashes(F.col("text")), lambda h: grams(h, BUCKETS)), lambda g: score(g, F.col("_weights"))).alias("llr"))
    )
    return table, materialize(sample.agg((F.percentile_approx("llr", LOSS, ACCURACY) - F.lit(MARGIN)).alias("threshold")), "quality-threshold")


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs with the base columns, llr (double), threshold (double, null without labels) and kept."""
    table, cut = fit(docs, labels)
    return (
        base_columns(docs)
        .withColumn("_weights", table.scalar())
        .withColumn("llr", score(F.col("_grams"), F.col("_weights")))
        .withColumn("threshold", cut.scalar())
        .withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("llr") >= F.col("threshold"), F.lit(True)))
        .drop("_grams", "_weights")
    )


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return judge(docs, read(spark, sf_dir, "labels")).drop("text", "threshold")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the rules keep. Only what the verdict needs is computed, once for each row; the log-likelihood ratio only where the base rules pass."""
    table, cut = fit(docs, read(spark, sf_dir, "labels"))
    names = [free_name(docs, "_weights"), free_name(docs, "_threshold")]
    llr = lambda h: let(grams(h, BUCKETS), lambda g: score(g, F.col(names[0])))
    passes = lambda h: (F.size(h) >= 20) & (100 * repeated_words(h) <= 30 * F.size(h))
    kept = let(hashes(F.col("text")), lambda h: F.when(passes(h), F.coalesce(llr(h) >= F.col(names[1]), F.lit(True))).otherwise(F.lit(False)))
    return docs.withColumn(names[0], table.scalar()).withColumn(names[1], cut.scalar()).where(kept).select(docs.columns)
