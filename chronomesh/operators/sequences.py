"""Operators on ordered samples: differences, edges, runs, refractory filters, peaks, cumulative curves.

Tables have a key (channel), a gap-free integer index and values. Frames of bounded reach
never need a whole channel in one task: `haloed` cuts channels into chunks of the index and
copies the rows near an edge into the neighbouring chunk, so a window over (key, chunk)
gives the same values for a chunk's own rows. Unbounded running sums are taken per chunk
and offset by the sums of the chunks before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronomesh.operators.ranges import key_ranks, spaced
from chronomesh.sources.shared import materialize

#: Samples of a channel that one task orders together.
CHUNK = 1 << 20


def haloed(df: DataFrame, index: str, before: int, after: int, chunk: int = CHUNK) -> DataFrame:
    """df with _chunk and _own: rows within `before` ahead of a chunk's start or `after` past its end are copied into it, with _own false."""
    home = F.floor(F.col(index) / chunk)
    first, last = F.floor((F.col(index) - after) / chunk), F.floor((F.col(index) + before) / chunk)
    return df.withColumn("_chunk", F.explode(F.sequence(F.greatest(first, F.lit(0).cast("long")), last))).withColumn("_own", F.col("_chunk") == home)


def framed(df: DataFrame, key: str, index: str, before: int, after: int, columns, chunk: int = CHUNK) -> DataFrame:
    """df with columns(w) added; w is a window over the key's samples in order of index, that must reach at most `before` back and `after` ahead."""
    rows = haloed(df, index, before, after, chunk)
    w = Window.partitionBy(key, "_chunk").orderBy(index)
    return rows.withColumns(columns(w)).where("_own").drop("_chunk", "_own")


def running_sum(df: DataFrame, key: str, index: str, value: Column, name: str, chunk: int = CHUNK) -> DataFrame:
    """df with name: the sum of value over the key's samples up to and including this one."""
    rows = df.withColumns({"_chunk": F.floor(F.col(index) / chunk), "_v": value})
    sums = rows.groupBy(key, "_chunk").agg(F.sum("_v").alias("_s"))
    ahead = Window.partitionBy(key).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumn("_before", F.coalesce(F.sum("_s").over(ahead), F.lit(0))).drop("_s")
    upto = Window.partitionBy(key, "_chunk").orderBy(index).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.join(offsets, [key, "_chunk"]).withColumn(name, F.sum("_v").over(upto) + F.col("_before"))
    return out.drop("_chunk", "_v", "_before")


def first_difference(df: DataFrame, key: str, index: str, value: str, name: str = "dx") -> DataFrame:
    """x(i) - x(i-1), the first sample against zero."""
    return framed(df, key, index, 1, 0, lambda w: {name: F.col(value) - F.coalesce(F.lag(value).over(w), F.lit(0.0))})


def edges(df: DataFrame, key: str, index: str, on: Column, keep_first: bool) -> DataFrame:
    """Samples where `on` turns true; keep_first: also a first sample that is on."""
    rows = framed(df.withColumn("_on", on), key, index, 1, 0, lambda w: {"_was": F.lag("_on").over(w)})
    return rows.where(F.col("_on") & ~F.coalesce("_was", F.lit(not keep_first))).drop("_on", "_was")


def runs(df: DataFrame, key: str, index: str, labels: list[str]) -> DataFrame:
    """(key, block, start, stop, n, labels): maximal runs of samples with equal labels; nulls equal each other."""
    changed = lambda w: {"_new": F.coalesce(~F.struct(*labels).eqNullSafe(F.lag(F.struct(*labels)).over(w)), F.lit(True)).cast("long")}
    blocks = running_sum(framed(df, key, index, 1, 0, changed), key, index, F.col("_new"), "block")
    return blocks.groupBy(key, "block").agg(F.min(index).alias("start"), F.max(index).alias("stop"), F.count("*").alias("n"), *[F.min_by(c, index).alias(c) for c in labels])


def refractory(df: DataFrame, key: str, time: str, gap: int) -> DataFrame:
    """Events at least `gap` after the last accepted one of their key: (key, time).

    By ranges of a key's time (ranges.spaced), so a long channel is swept by many tasks.
    """
    rows = df.select(key, time).withColumn("_x", F.lit(0))
    return spaced(rows, key, time, "_x", gap).drop("_x")


def clock(df: DataFrame, key: str, order: str, rt: Column, start: float, lead: float, tail: float) -> DataFrame:
    """Synthetic event times: each trial starts when the one before has ended. Adds t_stim and t_resp."""
    rows = running_sum(df.withColumn("_step", lead + rt + tail), key, order, F.col("_step"), "_end")
    begin = F.col("_end") - F.col("_step") + start
    return rows.withColumns({"t_stim": begin + lead, "t_resp": begin + lead + rt}).drop("_step", "_end")


def cumulative_energy(df: DataFrame, key: str, index: str, value: str) -> DataFrame:
    """Share of the key's energy up to each sample; a linear ramp where there is none."""
    rows = running_sum(df, key, index, F.col(value) * F.col(value), "_e")
    sums = df.groupBy(key).agg(F.sum(F.col(value) * F.col(value)).alias("_all"), F.count("*").alias("_n"), F.min(index).alias("_first"))
    ramp = (F.col(index) - F.col("_first") + 1) / F.col("_n")
    return rows.join(sums, key).withColumn("share", F.when(F.col("_all") > 0, F.col("_e") / F.col("_all")).otherwise(ramp)).drop("_e", "_all", "_n", "_first")


def local_maxima(df: DataFrame, key: str, index: str, value: str, threshold: float) -> DataFrame:
    """Samples above the threshold, not below the one before and above the next."""
    near = lambda w: {"_p": F.lag(value).over(w), "_n": F.lead(value).over(w)}
    rows = framed(df, key, index, 1, 1, near)
    return rows.where((F.col(value) > threshold) & (F.col(value) >= F.col("_p")) & (F.col(value) > F.col("_n"))).drop("_p", "_n")


def spaced_peaks(peaks: DataFrame, key: str, index: str, value: str, distance: int) -> DataFrame:
    """Peaks at least `distance` apart, taken in order; one too near the last kept replaces it if it is taller.

    By ranges of a key's index (ranges.spaced).
    """
    return spaced(peaks, key, index, value, distance)


def half_widths(df: DataFrame, peaks: DataFrame, key: str, index: str, value: str, pedestal: Column, reach: int = 64) -> DataFrame:
    """rise, decay, width and asymmetry (rise over decay, 1 without decay) of each peak at half its height above the pedestal.

    pedestal: a column of peaks. A side ends at the nearest sample not above half height, or
    at the record's edge. Peaks are looked at `reach` samples around; those with an open side
    again with eight times the reach, and so on, so a peak costs about its own width. The rows
    looked at are never broadcast: Spark takes them to be as few as the peaks they come from.
    """
    samples = df.select(key, index, value)
    ends = samples.groupBy(key).agg(F.min(index).alias("_first"), F.max(index).alias("_end"))
    half = (pedestal + 0.5 * (F.col(value) - pedestal)).alias("half")
    open_ = materialize(peaks.select(key, F.col(index).alias("peak"), half).join(ends, key), "peaks-open")
    out = None
    while out is None or not open_.isEmpty():
        low, high = F.greatest("_first", F.col("peak") - reach), F.least("_end", F.col("peak") + reach)
        near = open_.withColumn(index, F.explode(F.sequence(low, high))).hint("merge").join(samples, [key, index])
        under = F.col(value) <= F.col("half")
        at = near.groupBy(key, "peak", "half", "_first", "_end").agg(
            F.max(F.when(under & (F.col(index) <= F.col("peak")), F.col(index))).alias("_l"),
            F.min(F.when(under & (F.col(index) >= F.col("peak")), F.col(index))).alias("_r"),
        )
        left = F.when(F.col("peak") - reach <= F.col("_first"), F.coalesce("_l", "_first")).otherwise(F.col("_l"))
        right = F.when(F.col("peak") + reach >= F.col("_end"), F.coalesce("_r", "_end")).otherwise(F.col("_r"))
        at = materialize(at.withColumns({"_l": left, "_r": right}), "peaks-met")
        found = at.where("_l IS NOT NULL AND _r IS NOT NULL").select(key, "peak", "_l", "_r")
        out = found if out is None else out.unionAll(found)
        open_ = at.where("_l IS NULL OR _r IS NULL").select(*open_.columns)
        reach *= 8
    rise, decay = F.col("peak") - F.col("_l"), F.col("_r") - F.col("peak")
    asymmetry = F.when(decay == 0, F.lit(1.0)).otherwise(rise / decay)
    return out.select(key, F.col("peak").alias(index), rise.alias("rise"), decay.alias("decay"), (rise + decay).alias("width"), asymmetry.alias("asymmetry"))


def ecdf(df: DataFrame, key: str, value: str, tie: str) -> DataFrame:
    """Rank of each value by key over the key's count; ties get distinct steps in order of tie."""
    ranks = key_ranks(df, [key], [F.col(value), F.col(tie)], "ecdf", "_n")
    return ranks.withColumn("ecdf", F.col("ecdf") / F.col("_n")).drop("_n")
