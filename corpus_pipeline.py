"""Corpus pipeline: quality rules, line dedup, near-dedup, mixing, packing; each stage reads the Parquet its predecessor wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chronomesh.llm import lines, mixing, packing, quality, simhash
from chronomesh.llm.common import materialize, read

STAGES = [
    ("quality_rules", quality.stage),
    ("line_dedup", lines.stage),
    ("near_dedup", simhash.stage),
    ("mixing", mixing.stage),
    ("packing", packing.stage),
]

#: The stages use learned weights, hashes and a tokenizer, which SQL can't express; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, one after the other."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
