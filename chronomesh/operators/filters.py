"""Filters along a channel: band-pass, polynomial smoothing, Gaussian bumps. Channels are filtered in chunks with a halo, in Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronomesh.operators.sequences import CHUNK, haloed


def chunked(df: DataFrame, key: str, index: str, value: str, reach: int, filtered, chunk: int = CHUNK) -> DataFrame:
    """(key, index, value) filtered: filtered(x, starts, ends) gets a chunk's samples with up to `reach` more on each side, and whether the record starts or ends there."""
    last = df.groupBy(key).agg(F.max(index).alias("_last"))
    rows = haloed(df.select(key, index, value), index, reach, reach, chunk).join(last, key)
    kind = dict(df.dtypes)[key]

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by(index)
        i = table.column(index).to_numpy()
        out = filtered(table.column(value).to_numpy().astype(float), i[0] == 0, i[-1] == table.column("_last")[0].as_py())
        own = table.column("_own").to_numpy(zero_copy_only=False)
        return pa.table([table.column(key), pa.array(i.astype(np.int64)), pa.array(out)], [key, index, value]).filter(pa.array(own))

    return rows.groupBy(key, "_chunk").applyInArrow(run, f"{key} {kind}, {index} long, {value} double")


def band_taps(rate: float, low: float, high: float, length: int) -> np.ndarray:
    """Windowed-sinc band-pass of odd length (Hamming), zero phase when centred."""
    t = np.arange(length) - (length - 1) / 2
    ideal = lambda f: 2 * f / rate * np.sinc(2 * f / rate * t)
    return (ideal(high) - ideal(low)) * np.hamming(length)


def band_pass(df: DataFrame, key: str, index: str, value: str, rate: float, low: float, high: float, length: int, chunk: int = CHUNK) -> DataFrame:
    """Zero-phase band-pass; past its ends a record is mirrored."""
    taps, half = band_taps(rate, low, high, length), length // 2

    def filtered(x: np.ndarray, starts: bool, ends: bool) -> np.ndarray:
        pad = min(half, len(x) - 1)
        wide = np.pad(x, (pad, pad), mode="reflect") if len(x) > 1 else np.pad(x, (half, half), mode="edge")
        extra = (len(wide) - len(x)) // 2
        return np.convolve(wide, taps, mode="same")[extra : extra + len(x)]

    return chunked(df, key, index, value, half, filtered, chunk)


def smoothed(df: DataFrame, key: str, index: str, value: str, length: int, chunk: int = CHUNK) -> DataFrame:
    """Savitzky-Golay smoothing by parabolas over an odd length of 5 or more, never below zero; the ends are read off the first and last parabola."""
    length = max(5, length | 1)
    half = length // 2
    t = np.arange(length) - half
    projector = np.vander(t, 3) @ np.linalg.pinv(np.vander(t, 3))

    def filtered(x: np.ndarray, starts: bool, ends: bool) -> np.ndarray:
        if len(x) < length:
            return np.maximum(x, 0)
        out = np.convolve(x, projector[half][::-1], mode="same")
        out[:half] = (projector @ x[:length])[:half]
        out[-half:] = (projector @ x[-length:])[-half:]
        return np.maximum(out, 0)

    return chunked(df, key, index, value, half, filtered, chunk)


def bumps(events: DataFrame, grid: DataFrame, key: str, at: str, index: str, sigma: float) -> DataFrame:
    """Gaussian bumps (cut at four deviations) at the events, on the grid (key, index), scaled to a largest value of 1 by key."""
    reach = int(4 * max(1.0, sigma) + 0.5)
    offset = F.explode(F.sequence(F.lit(-reach), F.lit(reach)))
    near = events.select(key, F.col(at).alias("_e")).withColumn("_o", offset).withColumn(index, F.col("_e") + F.col("_o"))
    sums = near.groupBy(key, index).agg(F.sum(F.exp(-0.5 * F.pow(F.col("_o") / max(1.0, sigma), 2))).alias("_v"))
    rows = grid.select(key, index).join(sums, [key, index], "left").na.fill(0.0, ["_v"])
    top = rows.groupBy(key).agg(F.max("_v").alias("_top"))
    return rows.join(top, key).select(key, index, F.when(F.col("_top") > 0, F.col("_v") / F.col("_top")).otherwise(F.lit(0.0)).alias("regressor"))
