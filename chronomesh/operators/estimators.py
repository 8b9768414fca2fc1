"""Intrinsic-dimension estimates from a spectrum: an array of eigenvalues in descending order."""

from __future__ import annotations

import math
from functools import cache

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from chronomesh.functions.columns import argmax, total

TINY = float(np.finfo(np.float32).eps)


def positive(ev: Column) -> Column:
    return F.transform(ev, lambda x: F.greatest(x.cast("double"), F.lit(0.0)))


def threshold_dimension(ev: Column, threshold: float = 0.5) -> Column:
    return F.size(F.filter(ev, lambda x: x > threshold)).cast("long")


def ratio_gap_dimension(ev: Column, tiny: float = TINY) -> Column:
    """Place of the largest ratio of neighbours; zero where the first eigenvalue is noise."""
    v = positive(ev)
    ratios = F.zip_with(F.slice(v, F.lit(1), F.size(v) - 1), F.slice(v, F.lit(2), F.size(v) - 1), lambda a, b: a / (b + tiny))
    return F.when(F.element_at(v, 1) > 10 * tiny, argmax(ratios) + 1).otherwise(F.lit(0)).cast("long")


@cache
def noise_median(beta: float, steps: int = 20_000) -> float:
    """Median singular value of pure noise of unit deviation at aspect beta (Marchenko-Pastur).

    With eigenvalues written as 1 + beta - 2 sqrt(beta) cos(t), t from 0 to pi, the density in
    t is 2 sin(t)^2 / (pi * eigenvalue), which is smooth; its half-way point is interpolated.
    """
    beta = min(1.0, max(1e-3, beta))
    t = np.linspace(0.0, math.pi, steps + 1)[1:]
    eigenvalue = 1 + beta - 2 * math.sqrt(beta) * np.cos(t)
    density = np.sin(t) ** 2 / eigenvalue
    mass = np.cumsum((density + np.concatenate([[0.0], density[:-1]])) / 2)
    middle = np.interp(mass[-1] / 2, mass, t)
    return math.sqrt(1 + beta - 2 * math.sqrt(beta) * math.cos(middle))


def hard_threshold(beta: float) -> float:
    """Optimal hard threshold for singular values at aspect beta, in noise deviations (Gavish and Donoho)."""
    b = min(1.0, max(1e-3, beta))
    return math.sqrt((2 * (b + 1) + 8 * b / (b + 1 + math.sqrt(b * b + 14 * b + 1))) / b)


def noise_dimension(ev: Column, k: int, features: int) -> Column:
    """Singular values above the hard threshold; the noise level is the median of the lower half of the k of them. features: dimension of the full space."""
    start = max(1, k // 2)
    if k - start < 2:
        return F.lit(0).cast("long")
    beta = min(1.0, k / features)
    s = F.transform(positive(ev), lambda x: F.sqrt(x))
    bulk = F.array_sort(F.slice(s, start + 1, k - start))
    n = k - start
    median = (F.element_at(bulk, (n + 1) // 2) + F.element_at(bulk, n // 2 + 1)) / 2
    cut = median * (hard_threshold(beta) / noise_median(beta))
    return F.size(F.filter(s, lambda x: x > cut)).cast("long")


def participation_ratio(ev: Column) -> Column:
    sums = total(ev, lambda x: x.cast("double"))
    return sums * sums / (total(ev, lambda x: x.cast("double") * x.cast("double")) + 1e-12)


def rank_bound_broken(ev: Column, hilbert: int, floor: float = 1e-5) -> Column:
    """More eigenvalues above the floor than a state space of that size allows."""
    return F.size(F.filter(ev, lambda x: x > floor)) > 2 * (hilbert - 1)


def unit_sum(ev: Column) -> Column:
    whole = total(ev, lambda x: x.cast("double"))
    return F.when(whole > 0, F.transform(ev, lambda x: x.cast("double") / whole)).otherwise(F.transform(ev, lambda x: x.cast("double")))
