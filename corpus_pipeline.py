"""The training-corpus pipeline: STAGES over `documents`, each written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import pipeline

STAGES = [
    ("quality rules", pipeline.keep_good),
    ("simhash near-dedup", pipeline.keep_one_of_each),
    ("benchmark decontamination", pipeline.keep_unseen),
    ("pii", pipeline.hide_personal),
    ("packing", pipeline.pack),
]
# Fingerprint components, fitted weights and tokenizers have no SQL form; tests/llm holds the brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after another, over the whole `documents` table."""
    return pipeline.run(spark, sf_dir, STAGES)
