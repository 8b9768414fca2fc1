"""Joins that align signals, events and annotations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronomesh.operators.ranges import following, key_ranks


def positional(left: DataFrame, right: DataFrame, key: str, left_order: list[str], right_order: list[str]) -> DataFrame:
    """The n-th row of each side by key, up to the shorter; n starts at 0. The sides share no column but the key."""
    number = lambda df, order: key_ranks(df, [key], [F.col(c) for c in order], "n").withColumn("n", F.col("n") - 1)
    return number(left, left_order).join(number(right, right_order), [key, "n"])


def drop_positions(df: DataFrame, key: str, order: list[str], low: int, high: int, surplus: Column) -> DataFrame:
    """df without the rows low..high (0-based, by key), where surplus holds."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1
    return df.withColumn("_n", n).where(~(surplus & F.col("_n").between(low, high))).drop("_n")


def bucketed(samples: DataFrame, notes: DataFrame, key: str, index: str, rate: int, second: str, label: str, row: str) -> DataFrame:
    """samples with the label of their second (index // rate); of several notes in a second the last row counts, none gives null."""
    last = notes.groupBy(key, F.col(second).alias("_sec")).agg(F.max_by(label, row).alias(label))
    return samples.withColumn("_sec", F.floor(F.col(index) / rate)).join(last, [key, "_sec"], "left").drop("_sec")


#: Names up to which every text is looked through for each of them, in its row.
FEW_NAMES = 64


def containing(texts: DataFrame, names: DataFrame, text: str, name: str, value: str, order: str) -> DataFrame:
    """texts with the value of the first of names (by order) whose trimmed name is part of text, null if none is.

    Few names are looked for in the row, so no text leaves its task. With more of them a
    text meets names by equality: it is cut into its distinct parts of every length that a
    name has, and those that are a name's are brought back by the text. An empty name is part of every text.
    """
    parts = names.select(F.trim(name).alias("_part"), F.col(value), F.col(order).alias("_order")).where("_part IS NOT NULL")
    best = parts.groupBy("_part").agg(F.min_by(value, "_order").alias(value), F.min("_order").alias("_order"))
    if best.limit(FEW_NAMES + 1).count() <= FEW_NAMES:
        held = best.where("_order IS NOT NULL").agg(F.sort_array(F.collect_list(F.struct("_order", F.col(value).alias("_value"), "_part"))).alias("held"))
        first = F.get(F.filter(F.col("_held"), lambda n: F.contains(F.col(text), n["_part"])), F.lit(0))
        return texts.withColumn("_held", held.scalar()).withColumn(value, first["_value"]).drop("_held")
    lengths = parts.agg(F.collect_set(F.length("_part")).alias("lengths"))  # as many as names have lengths
    rows = texts.select(text).withColumn("_n", F.explode(lengths.scalar())).where(F.col("_n") <= F.length(text))
    cut = F.transform(F.sequence(F.lit(1), F.length(text) - F.col("_n") + 1), lambda i: F.substring(F.col(text), i, F.col("_n")))
    found = rows.withColumn("_part", F.explode(F.array_distinct(cut))).join(best, "_part")
    return texts.join(found.groupBy(text).agg(F.min_by(value, "_order").alias(value)), text, "left").select(*texts.columns, value)


def looked_up(rows: DataFrame, dimension: DataFrame, key: str, value: str, default: str) -> DataFrame:
    """rows with the dimension's value for the key, else for the key without spaces, else the default."""
    exact = dimension.select(F.col(key).alias("_k"), F.col(value).alias("_v"))
    loose = dimension.select(F.translate(key, " ", "").alias("_k2"), F.col(value).alias("_v2")).groupBy("_k2").agg(F.min("_v2").alias("_v2"))
    out = rows.join(exact, F.col(key) == F.col("_k"), "left").join(loose, F.translate(key, " ", "") == F.col("_k2"), "left")
    return out.withColumn(value, F.coalesce("_v", "_v2", F.lit(default))).drop("_k", "_v", "_k2", "_v2")


def epochs(signal: DataFrame, events: DataFrame, key: str, index: str, at: str, before: int, after: int, ends: DataFrame | None = None) -> DataFrame:
    """A row for each event and offset in -before..after with the sample there. Events whose window leaves the record are dropped whole.

    The offsets are exploded on the events' side, so the join is on equality; Spark takes them
    to be as few as the events, so they are never broadcast. ends: (key,
    first, last) of each record, from signal by default.
    """
    ends = ends or signal.groupBy(key).agg(F.min(index).alias("first"), F.max(index).alias("last"))
    inside = events.join(ends, key).where((F.col(at) - before >= F.col("first")) & (F.col(at) + after <= F.col("last"))).drop("first", "last")
    out = inside.withColumn("offset", F.explode(F.sequence(F.lit(-before), F.lit(after)))).withColumn(index, F.col(at) + F.col("offset"))
    return out.hint("merge").join(signal, [key, index])


def next_sample(events: DataFrame, grid: DataFrame, key: str, time: str, t: str, index: str) -> DataFrame:
    """The first sample of the grid at or after each event: (key, index), each once; events past the end are dropped.

    Events and samples are set into one order, cut by ranges of time; a range carries its
    first sample over to the ranges before, so nothing is compared pairwise.
    """
    return following(events, grid, key, time, t, index).select(key, index).dropna().distinct()


def lagged(left: DataFrame, right: DataFrame, key: str, index: str, low: int, high: int, chunk: int = 1 << 16) -> DataFrame:
    """left (key, index, x) and right (key, index, s) at all lags: (key, lag, x at i + lag, s at i).

    Both sides are set into one order, cut into chunks of the index with a halo of the left side; a row of the right side gathers what lies at its lags.
    """
    values, own = [c for c in left.columns if c not in (key, index)], [c for c in right.columns if c not in (key, index)]
    at = lambda df, add: df.withColumn("_chunk", F.explode(add))
    home = F.floor(F.col(index) / chunk)
    near = F.sequence(F.floor((F.col(index) - high) / chunk), F.floor((F.col(index) - low) / chunk))
    sides = at(left.where(F.col(key).isNotNull()).select(key, index, F.struct(index, *values).alias("_left")), near), right.withColumn("_chunk", home)
    both = sides[0].withColumn("_right", F.lit(False)).unionByName(sides[1].withColumn("_right", F.lit(True)), allowMissingColumns=True)
    reach = Window.partitionBy(key, "_chunk").orderBy(index).rangeBetween(low, high)
    met = both.withColumn("_met", F.collect_list("_left").over(reach)).where("_right").select(key, index, *own, F.explode("_met").alias("_m"))
    return met.select(key, F.col(f"_m.{index}").alias(index), *own, (F.col(f"_m.{index}") - F.col(index)).cast("int").alias("lag"), *[F.col(f"_m.{c}").alias(c) for c in values])


def takens(df: DataFrame, key: str, index: str, vector: str, m: int, lag: int) -> DataFrame:
    """Delay vectors, newest block first; the first (m - 1) * lag rows have none."""
    from chronomesh.operators.sequences import framed

    reach = (m - 1) * lag
    blocks = lambda w: {"_d": F.concat(*[F.lag(vector, k * lag).over(w) if k else F.col(vector) for k in range(m)])}
    return framed(df, key, index, reach, 0, blocks).where(F.col(index) >= reach).withColumn(vector, F.col("_d")).drop("_d")


def complete(rows: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """rows whose keys aren't done yet."""
    return rows.join(done, keys, "left_anti")
