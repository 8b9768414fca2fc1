"""Scalar and array column functions that several operators use."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def half_even(x: Column, digits: int = 6) -> Column:
    """x rounded half to even, as the numeric policy asks for every float that leaves a query."""
    return F.bround(x, digits)


def finite_or_zero(x: Column) -> Column:
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), F.lit(0.0)).otherwise(x)


def is_finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def clamp(x: Column, low: float | None = None, high: float | None = None) -> Column:
    out = x if low is None else F.greatest(x, F.lit(low))
    return out if high is None else F.least(out, F.lit(high))


def close(a: Column, b: Column, relative: float = 1e-9) -> Column:
    return F.abs(a - b) <= relative * F.greatest(F.abs(a), F.abs(b))


def slug(text: Column) -> Column:
    """Lower-case letters and digits; anything else becomes one underscore."""
    return F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_")


def canonical(text: Column, aliases: dict[str, str]) -> Column:
    """Trimmed lower-case text, with aliases replaced by their canonical name."""
    key = F.lower(F.trim(text))
    out = key
    for alias, name in aliases.items():
        out = F.when(key == alias, F.lit(name)).otherwise(out)
    return out


def first_existing(df: DataFrame, names: Sequence[str]) -> Column:
    """The first of names that df has; null if none."""
    found = [n for n in names if n in df.columns]
    return F.col(found[0]) if found else F.lit(None)


def numbered(df: DataFrame, prefix: str) -> list[str]:
    """Columns of df that are prefix and a number, in numeric order."""
    return sorted((c for c in df.columns if c.startswith(prefix) and c[len(prefix) :].isdigit()), key=lambda c: int(c[len(prefix) :]))


def total(values: Column, term=lambda x: x) -> Column:
    """Sum of term(x) over an array of doubles."""
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + term(x))


def argmax(values: Column) -> Column:
    """0-based place of the first largest element."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("long")
