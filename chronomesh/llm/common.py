"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronomesh.sources.shared import materialize

__all__ = ["SPACE", "free_name", "let", "materialize", "n_words", "read", "words"]

#: White space of the word pattern `[^\x20\x09-\x0D]+`, as a Java character class.
SPACE = r"[ \t-\r]"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def words(text: Column) -> Column:
    """Array of the words of text; null and blank texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"{SPACE}+"), lambda w: w != "")


def n_words(text: Column) -> Column:
    """Number of words, without building the filtered array."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, f"{SPACE}+"))).cast("long")


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once per row, also where body uses it inside other lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def free_name(df: DataFrame, name: str) -> str:
    """name, with underscores before it until no column of df has it (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
