"""Order within a key whose rows may be too many for one task: ranks, exact quantiles, as-of lookups and spaced events by ranges.

Rows are cut by range of (key, order) and written to the shared folder with the number of
their range, so every pass sees the same ranges. Whatever crosses a range is one small row
for each range and key: a count, a first value, or the map from the state that enters to the
one that leaves. Windows and tasks hold one range of a key at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronomesh.sources.shared import materialize

PART = "_range"


def ranged(df: DataFrame, keys: list[str], order: list[Column], parts: int | None = None) -> DataFrame:
    """df with PART: rows of smaller (keys, order) have the same or a smaller number. parts: how many, as many as Spark shuffles to by default."""
    by = [*map(F.col, keys), *order]
    cut = df.repartitionByRange(*by) if parts is None else df.repartitionByRange(parts, *by)
    return materialize(cut.withColumn(PART, F.spark_partition_id()), "ranges")


def before(sizes: DataFrame, keys: list[str], name: str) -> DataFrame:
    """sizes (keys, PART, name) with name replaced by its sum over the key's ranges before; a row for each range of a key."""
    ahead = Window.partitionBy(*keys).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    return sizes.withColumn(name, F.coalesce(F.sum(name).over(ahead), F.lit(0).cast("long")))


def key_ranks(df: DataFrame, keys: list[str], order: list[Column], name: str, total: str | None = None, parts: int | None = None) -> DataFrame:
    """df with name: a row's place from 1 among its key's rows in that order (which should have no ties), and total: the key's rows."""
    rows = ranged(df, keys, order, parts)
    sizes = rows.groupBy(*keys, PART).agg(F.count("*").alias("_before"))
    offsets = before(sizes, keys, "_before")
    if total is not None:
        offsets = offsets.join(sizes.groupBy(*keys).agg(F.sum("_before").alias(total)).select(*[F.col(k).alias(f"_{k}") for k in keys], total), _same([F.col(k) for k in keys], [F.col(f"_{k}") for k in keys])).drop(*[f"_{k}" for k in keys])
    offsets = offsets.select(*[F.col(c).alias(f"_o_{c}") for c in (*keys, PART)], "_before", *([total] if total else []))
    place = F.row_number().over(Window.partitionBy(*keys, PART).orderBy(*order)).cast("long")
    out = rows.withColumn(name, place).join(offsets, _same([F.col(c) for c in (*keys, PART)], [F.col(f"_o_{c}") for c in (*keys, PART)]))
    return out.withColumn(name, F.col(name) + F.col("_before")).drop(PART, "_before", *[f"_o_{c}" for c in (*keys, PART)])


def _same(left: list[Column], right: list[Column]) -> Column:
    """Equality that also joins null keys."""
    out = F.lit(True)
    for a, b in zip(left, right, strict=True):
        out = out & a.eqNullSafe(b)
    return out


def quantiles(df: DataFrame, keys: list[str], value: str, at: list[float], parts: int | None = None) -> DataFrame:
    """(keys, q, x): exact quantiles with linear interpolation between neighbouring ranks. Null values don't count; a key without others has none.

    Equal values are counted first. Counts by range tell which range holds a wanted rank; only
    the rows of these ranges are put in order.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_x")).agg(F.count("*").alias("_n"))
    rows = ranged(counts, keys, [F.col("_x")], parts)
    sizes = materialize(rows.groupBy(*keys, PART).agg(F.sum("_n").alias("_n")), "quantile-sizes")
    totals = sizes.groupBy(*keys).agg(F.sum("_n").alias("_all"))
    place = F.col("q") * (F.col("_all") - 1)
    want = totals.withColumn("q", F.explode(F.array(*map(F.lit, at)))).withColumn("_rank", F.explode(F.array_distinct(F.array(F.floor(place), F.ceil(place))))).withColumn("_share", place - F.floor(place))
    spans = before(sizes.withColumn("_from", F.col("_n")), keys, "_from")
    of = lambda df, names: df.select(*[F.col(c).alias(f"_w_{c}") if c in (*keys, PART) else F.col(c) for c in names])
    held = [F.col(k) for k in keys]
    known = spans.join(of(want, [*keys, "q", "_rank", "_share"]), _same(held, [F.col(f"_w_{k}") for k in keys]) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_from") + F.col("_n")))
    known = of(known.select(*keys, PART, "q", "_rank", "_share", "_from"), [*keys, PART, "q", "_rank", "_share", "_from"])
    parts_of = known.select(*[f"_w_{k}" for k in keys], f"_w_{PART}").distinct()
    on = _same([*held, F.col(PART)], [*[F.col(f"_w_{k}") for k in keys], F.col(f"_w_{PART}")])
    upto = F.sum("_n").over(Window.partitionBy(*keys, PART).orderBy("_x").rowsBetween(Window.unboundedPreceding, 0))
    picked = rows.join(parts_of, on, "left_semi").withColumn("_upto", upto).join(known, on & (F.col("_rank") - F.col("_from") < F.col("_upto")) & (F.col("_rank") - F.col("_from") >= F.col("_upto") - F.col("_n")))
    low, high = F.min("_x"), F.max("_x")
    return picked.groupBy(*keys, "q").agg((low + F.max("_share") * (high - low)).alias("x"))


def at_places(df: DataFrame, order: list[Column], places: list[int], name: str, parts: int | None = None) -> DataFrame:
    """The rows of df at these places (from 0) of its order, which should have no ties, with name: the place. Only ranges that hold one are put in order."""
    rows = ranged(df, [], order, parts)
    sizes = before(rows.groupBy(PART).agg(F.count("*").alias("_n")).withColumn("_from", F.col("_n")), [], "_from")
    wanted = F.array(*[F.lit(p).cast("long") for p in places])
    inside = F.filter(wanted, lambda p: (p >= F.col("_from")) & (p < F.col("_from") + F.col("_n")))
    held = sizes.select(F.col(PART).alias("_p"), "_from", inside.alias("_places")).where(F.size("_places") > 0)  # a row for each place at most
    place = F.row_number().over(Window.partitionBy(PART).orderBy(*order)) - 1 + F.col("_from")
    found = rows.join(F.broadcast(held), F.col(PART) == F.col("_p")).withColumn(name, place.cast("long"))
    return found.where(F.array_contains("_places", F.col(name))).drop(PART, "_p", "_from", "_places")


def following(events: DataFrame, grid: DataFrame, key: str, time: str, t: str, index: str, parts: int | None = None) -> DataFrame:
    """events (key, time) with the index of the key's first grid row (key, t, index) at or after them; null past the end."""
    at = F.col(index).cast(dict(grid.dtypes)[index])
    both = grid.select(key, F.col(t).alias("_t"), F.lit(1).alias("_s"), at.alias(index)).unionByName(
        events.select(key, F.col(time).alias("_t"), F.lit(0).alias("_s"), F.lit(None).cast(dict(grid.dtypes)[index]).alias(index))
    )
    rows = ranged(both.where("_t IS NOT NULL"), [key], [F.col("_t"), F.col("_s")], parts)
    heads = rows.groupBy(key, PART).agg(F.min_by(index, F.when(F.col("_s") == 1, F.col("_t"))).alias("_head"))
    later = Window.partitionBy(key).orderBy(PART).rowsBetween(1, Window.unboundedFollowing)
    carried = heads.select(F.col(key).alias("_key"), F.col(PART).alias("_part"), F.first("_head", ignorenulls=True).over(later).alias("_next"))
    ahead = Window.partitionBy(key, PART).orderBy("_t", "_s").rowsBetween(0, Window.unboundedFollowing)
    inside = rows.withColumn(index, F.first(index, ignorenulls=True).over(ahead)).where("_s = 0")
    out = inside.join(carried, _same([F.col(key), F.col(PART)], [F.col("_key"), F.col("_part")]))
    return out.select(key, F.col("_t").alias(time), F.coalesce(index, "_next").alias(index))


def steps(i: np.ndarray, x: np.ndarray, distance) -> np.ndarray:
    """For each event, the first later one that is `distance` away or larger in x; the number of events if there is none."""
    far = np.searchsorted(i, i + distance)
    if len(x) and (x == x[0]).all():
        return far
    larger, stack = np.full(len(x), len(x)), []
    for n, v in enumerate(x.tolist()):
        while stack and x[stack[-1]] < v:
            larger[stack.pop()] = n
        stack.append(n)
    return np.minimum(far, larger)


def ends(step: np.ndarray) -> np.ndarray:
    """The last event that is reached from each one by steps."""
    out = np.arange(len(step) + 1)
    out[:-1] = step
    last = np.where(step == len(step), np.arange(len(step)), -1)
    todo, at = last < 0, step.copy()
    while todo.any():  # paths double in length
        here = np.flatnonzero(todo)
        target = at[here]
        done = last[target] >= 0
        last[here[done]] = last[target[done]]
        at[here[~done]] = at[target[~done]]
        todo[here[done]] = False
    return last


def passage(i: np.ndarray, x: np.ndarray, distance) -> tuple[list[int], list[int]]:
    """The map of a range from the event held before it to the one held after it, as the events that may be held first and, for each, the last.

    near: the events within `distance` of the first that are larger than all before, one of
    which can take over from a smaller held event. far: of events to which a held one may give
    way by distance, the last of those that lead to one end.
    """
    end = ends(steps(i, x, distance))
    window = int(np.searchsorted(i, i[0] + distance))
    top = np.maximum.accumulate(x[:window])
    near = np.flatnonzero(np.r_[True, top[1:] > top[:-1]]).tolist()
    reach = min(window, len(i) - 1) + 1
    far = np.flatnonzero(np.r_[end[1:reach] != end[: reach - 1], True]).tolist()
    return [*near, *far], end[[*near, *far]].tolist() + [len(near)]


def spaced(events: DataFrame, key: str, index: str, value: str, distance, parts: int | None = None) -> DataFrame:
    """Events (key, index, value) at least `distance` apart, taken in order; one too near the last kept replaces it if it is larger.

    A range of a key is reduced to the map from the event held when it begins to the one held
    when it ends: which of its events takes over first decides, and paths from neighbouring
    events soon join, so the map has a few entries. One task for each key follows the maps, not the
    events. Then every range is swept with the event it starts from. Events without index or value are left out.
    """
    rows = ranged(events.select(key, index, value).where(F.col(index).isNotNull() & F.col(value).isNotNull()), [key], [F.col(index)], parts)
    kinds = dict(rows.dtypes)
    names = [key, index, value]
    state = f"_i {kinds[index]}, _x {kinds[value]}"
    rows = rows.select(*names, PART)

    def arrays(table: pa.Table) -> tuple[np.ndarray, np.ndarray, pa.Table]:
        table = table.sort_by([(index, "ascending")])
        return table.column(index).to_numpy(), table.column(value).to_numpy(), table

    def summary(table: pa.Table) -> pa.Table:
        i, x, table = arrays(table)
        first, (*last, n_near) = passage(i, x, distance)
        own = table.slice(0, 1).select([key, PART])
        of = lambda c, at: pa.array([table.column(c).combine_chunks().take(pa.array(at)).to_pylist()], pa.list_(table.schema.field(c).type))
        fields = {"_end": table.column(index).slice(len(i) - 1), "_near": pa.array([n_near], pa.int32())}
        fields |= {"_fi": of(index, first), "_fx": of(value, first), "_li": of(index, last), "_lx": of(value, last)}
        return pa.table({key: own.column(key), PART: own.column(PART), **fields})

    maps = rows.groupBy(key, PART).applyInArrow(
        summary, f"`{key}` {kinds[key]}, `{PART}` int, _end {kinds[index]}, _near int, _fi array<{kinds[index]}>, _fx array<{kinds[value]}>, _li array<{kinds[index]}>, _lx array<{kinds[value]}>"
    )

    def follow(table: pa.Table) -> pa.Table:
        held, entering, known = None, [], table.sort_by([(PART, "ascending")])
        for r in known.to_pylist():
            entering.append(held)
            n, at = r["_near"], None
            if held is None:
                at = 0  # the first event, which is larger than all before it
            else:
                larger = next((j for j in range(n) if r["_fx"][j] > held[1]), None)
                until = held[0] + distance
                if larger is not None and r["_fi"][larger] < until:
                    at = larger
                elif r["_end"] >= until:
                    at = next(j for j in range(n, len(r["_fi"])) if r["_fi"][j] >= until)
            if at is not None:
                held = (r["_li"][at], r["_lx"][at])
        last = [False] * (len(entering) - 1) + [True]
        pick = lambda j, c: pa.array([e and e[j] for e in entering], table.schema.field(c).type.value_type)
        return pa.table({key: known.column(key), PART: known.column(PART), "_i": pick(0, "_fi"), "_x": pick(1, "_fx"), "_last": pa.array(last)})

    states = maps.groupBy(key).applyInArrow(follow, f"`{key}` {kinds[key]}, `{PART}` int, {state}, _last boolean")

    def sweep(table: pa.Table, entered: pa.Table) -> pa.Table:
        i, x, table = arrays(table)
        come = entered.to_pylist()[0]
        kept, step = [], steps(i, x, distance)
        if come["_i"] is None:
            at, gone = 0, False
        else:
            far, larger = int(np.searchsorted(i, come["_i"] + distance)), np.flatnonzero(x > come["_x"])
            at = min(far, int(larger[0]) if len(larger) else len(i))
            gone = at == far and at < len(i) or (at == len(i) and come["_last"])
        while at < len(i):
            to = int(step[at])
            if to < len(i) and i[to] - i[at] >= distance or to == len(i) and come["_last"]:
                kept.append(at)
            at = to
        out = table.select(names).take(pa.array(kept, pa.int64()))
        if gone:
            row = {key: table.column(key).slice(0, 1), index: pa.array([come["_i"]], table.schema.field(index).type), value: pa.array([come["_x"]], table.schema.field(value).type)}
            out = pa.concat_tables([pa.table(row, schema=out.schema), out])
        return out

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in names)
    return rows.groupBy(key, PART).cogroup(states.groupBy(key, PART)).applyInArrow(sweep, schema)
