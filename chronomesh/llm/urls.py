"""URL filters: host and path rules first, then a logistic regression on hashed character n-grams of host and path.

The regression is trained from a small labelled URL table (LABELLED by default, at most
FIT_ROWS rows). Training is full-batch gradient descent inside one row: the examples as
sparse vectors, their transpose by bucket, and an aggregate over the steps, so it uses
DataFrame functions only and gives the same weights on every run. Judging a url needs no
shuffle: the row hashes its own n-grams and adds their weights up.

Defined results: a null url, or one without `://`, has an empty host and an empty path, fits
no rule and is judged by the method from its intercept alone. Long urls are read whole,
repeated rows are judged alike, an empty table gives an empty result, and other columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronomesh.llm.common import let, materialize, read

#: (verdict, host and path); a rule fits its host and all subdomains, the longest one wins.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
BUCKETS = 1 << 12
NGRAMS = (3, 4)
STEPS = 200
RATE = 8.0
L2 = 1e-4
FIT_ROWS = 2_000

#: Words that hosts of unwanted kinds (gambling, adult, pharmacy, spam, advertising, cracks) and of wanted kinds use, and what hosts add to them.
_UNWANTED = (
    "casino poker slots jackpot roulette betting sportbet bets lottery gamble porn adult xxx escort camgirl sexcam "
    "pills viagra cialis pharmacy meds steroids dietpills payday quickloan spam clickbait popunder adserver adclick tracker "
    "warez crack keygen torrent replica fakewatch getrich freemoney"
).split()
_WANTED = (
    "library museum university school college garden kitchen cooking recipes weather science physics history music theatre "
    "travel hiking football chess news journal gazette council hospital clinic bakery books archive maps forum wiki blog "
    "software linux python engineering energy railway harbour parliament station airport ferry cinema orchestra painting poetry biology "
    "chemistry geology astronomy"
).split()
_BEFORE = ("", "my", "best", "the", "city", "new")
_AFTER = ("", "-online", "world", "-24", "hub", "-club")
_ENDS = ("test", "example", "invalid")
_PREFIXES = ("", "www.", "blog.", "m.")
_LANGS = ("en", "de", "fr", "es")


def labelled(spark: SparkSession) -> DataFrame:
    """The built-in table (url, label): label 1 for unwanted hosts. What stands around a host's word follows its place in the list, alike for both labels."""
    rows = []
    for label, all_words in ((1, _UNWANTED), (0, _WANTED)):
        for i, word in enumerate(all_words):
            for k in range(6):
                host = f"{_PREFIXES[(i + k) % 4]}{_BEFORE[k]}{word}{_AFTER[(i + k) % 6]}.{_ENDS[(i + k) % 3]}"
                rows.append((f"http://{host}/{_LANGS[(i + 3 * k) % 4]}/{37 * i + 411 * k + 5}", label))
    return spark.createDataFrame(rows, "url string, label int")


def host_and_path(url: Column) -> tuple[Column, Column]:
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    text = F.coalesce(url, F.lit(""))
    host = F.translate(F.regexp_extract(text, pattern, 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(text, pattern, 2)


def grams(host: Column, path: Column) -> Column:
    """Buckets of the character n-grams of host and path, each field with its own hash seed and with marked ends, then the intercept's bucket 0."""

    def of(text: Column, field: str, n: int) -> Column:
        s = F.concat(F.lit("^"), text, F.lit("$"))
        bucket = lambda i: (F.pmod(F.xxhash64(F.lit(field), F.substring(s, i, F.lit(n))), F.lit(BUCKETS - 1)) + 1).cast("int")
        return F.when(F.length(s) >= n, F.transform(F.sequence(F.lit(1), F.length(s) - (n - 1)), bucket)).otherwise(F.array().cast("array<int>"))

    return F.concat(*[of(text, field, n) for text, field in ((host, "h"), (path, "p")) for n in NGRAMS], F.array(F.lit(0)))


def vector(buckets: Column) -> Column:
    """Weight of one n-gram: 1 / sqrt(number of n-grams), so long urls don't outweigh short ones."""
    return F.lit(1.0) / F.sqrt(F.size(buckets).cast("double"))


def train(table: DataFrame) -> DataFrame:
    """One row with one array: the weight of each bucket. table: (url, label), the first FIT_ROWS by hash are used."""
    host, path = host_and_path(F.col("url"))
    rows = (
        table.where(F.col("url").isNotNull() & F.col("label").isNotNull())
        .select("url", "label", F.xxhash64("url").alias("h"))
        .orderBy("h", "url", "label")
        .limit(FIT_ROWS)
        .select(F.struct("h", "url", "label").alias("k"), F.col("label").cast("double").alias("y"), grams(host, path).alias("b"))
        .agg(F.array_sort(F.collect_list(F.struct("k", "y", "b"))).alias("rows"))
        .select(F.posexplode("rows").alias("i", "r"))
        .select("i", F.col("r.y").alias("y"), F.col("r.b").alias("b"), vector(F.col("r.b")).alias("v"))
    )
    rows = materialize(rows, "url-examples")
    examples = rows.agg(F.array_sort(F.collect_list(F.struct("i", "y", "v", "b"))).alias("examples"))
    inverse = (
        rows.select("i", "v", F.explode("b").alias("b"))
        .groupBy("b")
        .agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("at"))
        .agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("b", "at")))).alias("m"))
        .select(F.transform(F.sequence(F.lit(0), F.lit(BUCKETS - 1)), lambda b: F.coalesce(F.element_at(F.col("m"), b), F.array().cast("array<struct<i:int,v:double>>"))).alias("inverse"))
    )
    row = materialize(examples.withColumn("inverse", materialize(inverse, "url-inverse").scalar()), "url-training")
    n = F.greatest(F.size("examples"), F.lit(1)).cast("double")

    def residuals(w: Column) -> Column:
        return F.transform("examples", lambda e: F.lit(1.0) / (1 + F.exp(-F.aggregate(e["b"], F.lit(0.0), lambda a, b: a + w[b] * e["v"]))) - e["y"])

    def step(w: Column, _: Column) -> Column:
        gradient = lambda r, at: F.aggregate(at, F.lit(0.0), lambda a, p: a + r[p["i"]] * p["v"])
        return let(residuals(w), lambda r: F.zip_with(w, F.col("inverse"), lambda x, at: x - F.lit(RATE) * (gradient(r, at) / n + F.lit(L2) * x)))

    zero = F.array_repeat(F.lit(0.0), BUCKETS)
    return materialize(row.select(F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), zero, step).alias("weights")), "url-weights")


def fitting(host: Column, path: Column, rules: tuple) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none does."""
    rule = verdict = F.lit(None).cast("string")
    for action, text in sorted(rules, key=lambda r: len(r[1])):
        at, slash, rest = text.partition("/")
        fits = ((host == at) | host.endswith(f".{at}")) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(action)).otherwise(verdict)
    return rule, verdict


def judge(pages: DataFrame, weights: DataFrame, rules: tuple = RULES) -> DataFrame:
    """pages (page_id, url) with host, path, rule, score (probability of label 1) and verdict."""
    host, path = host_and_path(F.col("url"))
    rule, by_rule = fitting(F.col("host"), F.col("path"), rules)
    margin = let(grams(F.col("host"), F.col("path")), lambda b: F.aggregate(b, F.lit(0.0), lambda a, x: a + F.col("_weights")[x]) * vector(b))
    return (
        pages.select("page_id", host.alias("host"), path.alias("path"))
        .withColumn("_weights", weights.scalar())
        .select("page_id", "host", "path", rule.alias("rule"), by_rule.alias("_by_rule"), (1 / (1 + F.exp(-margin))).alias("score"))
        .withColumn("verdict", F.coalesce("_by_rule", F.when(F.col("score") >= 0.5, F.lit("block")).otherwise(F.lit("allow"))))
        .drop("_by_rule")
    )


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read(spark, sf_dir, "pages").select("page_id", "url"), train(labelled(spark)))
