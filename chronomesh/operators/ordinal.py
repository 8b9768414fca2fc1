"""Ordinal-pattern entropy and statistical complexity over many window scales.

A pattern of order m is the ranking of m neighbouring samples; of equal samples the earlier
ranks first. For many scales, channels are cut into chunks that overlap by the widest window;
in a chunk, patterns are counted once between the places where any window begins or ends,
and running sums of these counts give every window's counts as a difference. So a sample
makes one row, or few near a chunk's edge, however many windows hold it.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronomesh.functions.columns import total
from chronomesh.operators.sequences import framed, haloed

EPSILON = 1e-13
ORDERS = (6, 5, 4, 3)


def order_for(window: int) -> int:
    """Largest order whose patterns a window can hold five times over, 3 at least."""
    return next((m for m in ORDERS if window >= 5 * math.factorial(m)), 3)


def order_column(window: Column) -> Column:
    out = F.lit(3)
    for m in reversed(ORDERS):
        out = F.when(window >= 5 * math.factorial(m), F.lit(m)).otherwise(out)
    return out


def q0(n: int) -> float:
    """What scales the Jensen-Shannon divergence from uniform over n states to at most 1."""
    return -2 / (((n + 1) / n) * math.log2(n + 1) + math.log2(n) - 2 * math.log2(2 * n))


def q0_column(n: Column) -> Column:
    """q0 of a column of numbers of states (double, 2 or more)."""
    return -2 / (((n + 1) / n) * F.log2(n + 1) + F.log2(n) - 2 * F.log2(2 * n))


def pattern_code(values: list[Column]) -> Column:
    """Number of the values' ranking, from the inversions of each value against those after it."""
    m = len(values)
    code = F.lit(0).cast("long")
    for j in range(m - 1):
        inversions = sum((F.when(values[j] > values[k], 1).otherwise(0) for k in range(j + 1, m)), F.lit(0))
        code = code + inversions * math.factorial(m - 1 - j)
    return code


def patterns(df: DataFrame, key: str, index: str, value: str, m: int, lag: int = 1) -> DataFrame:
    """(key, index, code): the pattern that starts at each sample; the last (m - 1) * lag have none."""
    reach = (m - 1) * lag
    ahead = lambda w: {"_last": F.lead(value, reach).over(w), "code": pattern_code([F.lead(value, k * lag).over(w) if k else F.col(value) for k in range(m)])}
    rows = framed(df.select(key, index, value), key, index, 0, reach, ahead)
    return rows.where(F.col("_last").isNotNull()).select(key, index, "code")


def entropy_complexity(counts: DataFrame, keys: list[str], m: int) -> DataFrame:
    """Normalised permutation entropy and complexity from pattern counts n; patterns not seen count in the mixed entropy."""
    states = math.factorial(m)
    u = 1.0 / states
    unseen = -0.5 * u * math.log2(0.5 * u + EPSILON)
    sums = counts.groupBy(*keys).agg(F.sum("n").alias("_all"), F.count("*").alias("_seen"), F.collect_list("n").alias("_n"))
    p = lambda x: x / F.col("_all")
    term = lambda x: -x * F.log2(x + EPSILON)
    plain = F.aggregate(F.array_sort("_n"), F.lit(0.0), lambda a, x: a + term(p(x)))
    mixed = F.aggregate(F.array_sort("_n"), F.lit(0.0), lambda a, x: a + term((p(x) + u) / 2)) + (states - F.col("_seen")) * unseen
    out = sums.withColumns({"_h": plain, "_mixed": mixed}).withColumn("pe", F.col("_h") / math.log2(states))
    divergence = F.col("_mixed") - F.col("_h") / 2 - math.log2(states) / 2
    return out.select(*keys, "pe", (divergence * F.col("pe") * q0(states)).alias("sc"))


def window_grid(rate: float, seconds: list[float]) -> list[tuple[int, float, int]]:
    """(samples, seconds, order) of each window length."""
    return [(w, s, order_for(w)) for s in seconds for w in [round(s * rate)]]


def with_windows(recordings: DataFrame, rate: str, seconds: list[float]) -> DataFrame:
    """recordings with a row for each window length: seconds, w (samples at the recording's rate, half to even) and m, the order for it."""
    out = recordings.withColumn("seconds", F.explode(F.array(*map(F.lit, seconds))))
    out = out.withColumn("w", F.bround(F.col("seconds") * F.col(rate), 0).cast("long"))
    return out.withColumn("m", order_column(F.col("w")))


def codes_of(x: np.ndarray, m: int) -> np.ndarray:
    """Numbers of the patterns that start at each sample, as `pattern_code` gives them."""
    n = len(x) - m + 1
    parts = [x[k : n + k] for k in range(m)]
    code = np.zeros(max(n, 0), np.int64)
    for j in range(m - 1):
        for k in range(j + 1, m):
            code += (parts[j] > parts[k]) * math.factorial(m - 1 - j)
    return code


def entropies(counts: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """(pe, sc) of each row of pattern counts."""
    n = math.factorial(m)
    p = counts / counts.sum(axis=1, keepdims=True)
    h = lambda x: (-x * np.log2(x + EPSILON)).sum(axis=1)
    plain, mixed = h(p), h((p + 1 / n) / 2)
    pe = plain / math.log2(n)
    return pe, (mixed - plain / 2 - math.log2(n) / 2) * pe * q0(n)


def chunk_features(x: np.ndarray, start: int, first: int, stop: int, windows: list[int], stride: int) -> list[tuple]:
    """(window, m, centre, pe_left, sc_left, pe_right, sc_right) for the centres in [first, stop), as arrays. x: the samples from start on."""
    widest = max(windows)
    least = max(first, widest)
    centres = np.arange(widest + -(-(least - widest) // stride) * stride, min(stop, start + len(x) - widest), stride)
    if not len(centres):
        return []
    out, by_order = [], {}
    for w in windows:
        by_order.setdefault(order_for(w), []).append(w)
    for m, own in sorted(by_order.items()):
        # patterns [c - W, c - m] lie in the left window, [c, c + W - m] in the right one
        ends = {w: [centres - w, centres - m + 1, centres, centres + w - m + 1] for w in own}
        places = np.unique(np.concatenate([e for w in own for e in ends[w]]))
        code = codes_of(x, m)
        between = np.searchsorted(places, start + np.arange(len(code)), side="right")
        n = math.factorial(m)
        before = np.cumsum(np.bincount(between * n + code, minlength=(len(places) + 1) * n).reshape(-1, n), axis=0)
        for w in own:
            at = [before[np.searchsorted(places, e)] for e in ends[w]]
            sides = [*entropies(at[1] - at[0], m), *entropies(at[3] - at[2], m)]
            out.append((np.full(len(centres), w), np.full(len(centres), m), centres, *sides))
    return out


#: Samples of a channel whose centres one call works on.
SPAN = 1 << 15


def features(df: DataFrame, key: str, index: str, value: str, windows: list[int], stride: int) -> DataFrame:
    """(key, window, m, centre, pe and sc of both sides, their absolute changes and delta_ec), rounded half to even at 5 decimals."""
    widest = max(windows)
    kind = dict(df.dtypes)[key]
    names = [key, "window", "m", "centre", "pe_left", "sc_left", "pe_right", "sc_right"]
    rows = haloed(df.select(F.col(key), F.col(index).cast("long").alias("_i"), F.col(value).cast("double").alias("_x")), "_i", widest, widest, SPAN)

    def run(keys: tuple, part: pa.Table) -> pa.Table:
        i = part.column("_i").to_numpy()
        order = np.argsort(i)
        i, x, chunk = i[order], part.column("_x").to_numpy()[order], keys[1].as_py()
        found = chunk_features(x, int(i[0]), chunk * SPAN, (chunk + 1) * SPAN, windows, stride)
        columns = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [np.empty(0)] * 7
        kinds = [pa.int64(), pa.int32(), pa.int64()] + [pa.float64()] * 4
        own = [pa.array(c).cast(k) for c, k in zip(columns, kinds, strict=True)]
        return pa.table([pa.array([keys[0].as_py()] * len(columns[0]), keys[0].type), *own], names)

    schema = f"{key} {kind}, window long, m int, centre long, pe_left double, sc_left double, pe_right double, sc_right double"
    out = rows.select(key, "_chunk", "_i", "_x").groupBy(key, "_chunk").applyInArrow(run, schema)
    out = out.withColumns({c: F.bround(c, 5) for c in names[4:]})
    d_pe, d_sc = F.abs(F.col("pe_left") - F.col("pe_right")), F.abs(F.col("sc_left") - F.col("sc_right"))
    return out.withColumns({"d_pe": d_pe, "d_sc": d_sc, "delta_ec": d_pe + d_sc})


def tag(seconds: Column, order: Column) -> Column:
    """Display name of a scale: three decimals below a second, one above."""
    return F.concat(F.lit("w_"), F.when(seconds < 1, F.format_string("%.3f", seconds)).otherwise(F.format_string("%.1f", seconds)), F.lit("s_m"), order)


def parse_tag(name: Column) -> tuple[Column, Column]:
    """Seconds and order from a display name; null where it isn't one."""
    part = lambda i: F.nullif(F.regexp_extract(name, r"^w_([0-9.]+)s_m([0-9]+)$", i), F.lit(""))
    return part(1).cast("double"), part(2).cast("int")


def jensen_shannon(p: Column, q: Column) -> Column:
    """Divergence in bits of two arrays of probabilities of one length; zeros count nothing."""
    bits = lambda x: -total(x, lambda v: F.when(v > 0, v * F.log2(v)).otherwise(F.lit(0.0)))
    return bits(F.zip_with(p, q, lambda a, b: (a + b) / 2)) - (bits(p) + bits(q)) / 2


def largest_complexity(m: int, points: int = 2000) -> float:
    """Largest complexity of the distributions in which one state has p and the others share the rest, p on a grid."""
    n = math.factorial(m)
    p = np.linspace(1 / n, 1 - 1e-12, points)
    rest = (1 - p) / (n - 1)
    h = lambda x: -x * np.log2(x)
    plain = h(p) + (n - 1) * h(rest)
    mixed = h((p + 1 / n) / 2) + (n - 1) * h((rest + 1 / n) / 2)
    return float(np.max(q0(n) * (mixed - plain / 2 - math.log2(n) / 2) * plain / math.log2(n)))


def displacement(d_pe: Column, d_sc: Column, window: Column, m: Column) -> Column:
    """Length of the step in the entropy-complexity plane, weighted by how many patterns a window has for each state; d_sc is scaled by the largest complexity."""
    states = F.factorial(m)
    return F.sqrt(d_pe * d_pe + d_sc * d_sc) * F.sqrt((window - m + 1) / states)
