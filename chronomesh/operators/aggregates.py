"""Summaries: densities, quantiles, shares, entropies, event-related means, correlations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def shares(df: DataFrame, keys: list[str]) -> DataFrame:
    """Counts by keys and their share of all rows."""
    counts = df.groupBy(*keys).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def occupancy(df: DataFrame, row: str, column: str) -> DataFrame:
    """Counts for all pairs of the rows and columns that occur, zero where they don't meet."""
    grid = df.select(row).distinct().crossJoin(df.select(column).distinct())
    counts = df.groupBy(row, column).agg(F.count("*").alias("n"))
    return grid.join(counts, [row, column], "left").na.fill(0, ["n"])


def normalised(counts: DataFrame, row: str) -> DataFrame:
    """n over its row's sum; a row of zeros stays zero."""
    whole = F.sum("n").over(Window.partitionBy(row))
    return counts.withColumn("p", F.col("n") / F.when(whole == 0, F.lit(1)).otherwise(whole))


def histogram(df: DataFrame, keys: list[str], value: str, low: Column, high: Column, bins: int) -> DataFrame:
    """(keys, bin, centre, density): equal bins, the last one closed on the right; values outside are ignored. Every bin of every key is there."""
    width = (F.col("_hi") - F.col("_lo")) / bins
    rows = df.withColumns({"_lo": low, "_hi": high}).where(F.col(value).between(F.col("_lo"), F.col("_hi")))
    place = F.least(F.floor((F.col(value) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins), F.lit(bins - 1))
    counts = rows.groupBy(*keys, "_lo", "_hi", place.cast("long").alias("bin")).agg(F.count("*").alias("n"))
    sums = counts.groupBy(*keys, "_lo", "_hi").agg(F.sum("n").alias("_all")).withColumn("bin", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long"))))
    out = sums.join(counts.select(*keys, "bin", "n"), [*keys, "bin"], "left").na.fill(0, ["n"])
    return out.select(*keys, "bin", (F.col("_lo") + (F.col("bin") + 0.5) * width).alias("centre"), (F.col("n") / (F.col("_all") * width)).alias("density"), "n")


def event_related(rows: DataFrame, keys: list[str], value: str, ddof: int = 1) -> DataFrame:
    """mean and standard error of the value by keys (offsets)."""
    spread = F.stddev_samp(value) if ddof else F.stddev_pop(value)
    return rows.groupBy(*keys).agg(F.avg(value).alias("mean"), (spread / F.sqrt(F.count(value))).alias("sem"), F.count(value).alias("n"))


def zscored(df: DataFrame, key: str, value: str, name: str = "z") -> DataFrame:
    """(x - mean) / population deviation by key; null where that is zero."""
    stats = df.groupBy(key).agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"))
    return df.join(stats, key).withColumn(name, (F.col(value) - F.col("_m")) / F.nullif(F.col("_s"), F.lit(0.0))).drop("_m", "_s")


def block_scaled(df: DataFrame, key: str, kind: str, value: str, name: str = "scaled") -> DataFrame:
    """Values centred by key, over the root mean square of their kind."""
    centres = df.groupBy(key).agg(F.avg(value).alias("_m"))
    centred = df.join(centres, key).withColumn("_c", F.col(value) - F.col("_m"))
    rms = centred.groupBy(kind).agg(F.sqrt(F.avg(F.col("_c") * F.col("_c"))).alias("_rms"))
    return centred.join(rms, kind).withColumn(name, F.col("_c") / F.nullif(F.col("_rms"), F.lit(0.0))).drop("_m", "_c", "_rms")


def entropy(counts: DataFrame, keys: list[str], epsilon: float = 1e-12) -> DataFrame:
    """Shannon entropy in bits of the counts n by keys, zero counts included."""
    p = F.col("n") / F.sum("n").over(Window.partitionBy(*keys))
    return counts.withColumn("_p", p).groupBy(*keys).agg((-F.sum(F.col("_p") * F.log2(F.col("_p") + epsilon))).alias("entropy"))


def diversity(counts: DataFrame, keys: list[str], bins: int) -> DataFrame:
    """Entropy over log2(bins); zero cells are skipped and an empty row has none."""
    whole = F.sum("n").over(Window.partitionBy(*keys))
    p = F.when(F.col("n") > 0, F.col("n") / whole)
    return counts.withColumn("_p", p).groupBy(*keys).agg(F.coalesce(-F.sum(F.col("_p") * F.log2("_p")) / F.log2(F.lit(float(bins))), F.lit(0.0)).alias("diversity"))


def correlation(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Pearson correlation by keys, zero where a side is constant."""
    r = F.when((F.stddev_pop(x) > 0) & (F.stddev_pop(y) > 0), F.corr(x, y)).otherwise(F.lit(0.0))
    return df.groupBy(*keys).agg(r.alias("r"), F.count("*").alias("n"))


def energy_localisation(curve: DataFrame, key: str, index: str) -> DataFrame:
    """1 - 2 min(A, 1 - A), A the trapezoid area below the cumulative energy share over time scaled to [0, 1]."""
    from chronomesh.operators.sequences import framed

    steps = framed(curve, key, index, 1, 0, lambda w: {"_a": (F.col("share") + F.lag("share").over(w)) / 2})
    area = F.sum("_a") / F.nullif(F.count("_a"), F.lit(0))
    out = steps.groupBy(key).agg(area.alias("_area"))
    return out.select(key, F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - 2 * F.least(F.col("_area"), 1 - F.col("_area")))).alias("localisation"))


def first_best(df: DataFrame, keys: list[str], value: str, by: str, tie: str, largest: bool = True) -> DataFrame:
    """The row's value with the largest (or smallest) by; of equal ones that with the smallest tie."""
    score = F.struct((-F.col(by) if largest else F.col(by)).alias("s"), F.col(tie))
    return df.groupBy(*keys).agg(F.min_by(value, score).alias(value), (F.max(by) if largest else F.min(by)).alias(by))
