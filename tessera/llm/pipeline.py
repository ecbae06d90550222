"""Pipeline stages: each takes (spark, docs, sf_dir) and works on all that the one before kept.

Stages but the last return the columns of documents: a stage reads these five, drops
others, and fails with Spark's error for an unknown column where one of them is missing.
Null ids, null texts and repeated rows follow the rules that each operator's docstring
states; an empty table goes through all stages.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import decontam, packing, pii, quality, simhash
from tessera.session import checkpoint_dir

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality rules: documents they reject go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.kept(docs.select(*COLUMNS), labels)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash near-duplicates: one document of each component stays."""
    return simhash.one_of_each(docs.select(*COLUMNS))


def keep_unseen(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Decontamination: documents that contain a benchmark item go."""
    return decontam.decontaminate(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def hide_personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data: every span is replaced by its kind; n_chars follows."""
    return pii.redact(docs.select(*COLUMNS), pii.train(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packing: the pieces of the token windows."""
    return packing.pack_documents(docs, packing.tokenizer_path("word_bpe_49k.json"))


def run(spark: SparkSession, sf_dir: str, stages: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]]) -> DataFrame:
    """The stages over `documents`; each result but the last is written as Parquet to
    the cluster's shared checkpoint folder and read again as the next one's input."""
    folder = f"{checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(stages):
        docs = stage(spark, docs, sf_dir)
        if k < len(stages) - 1:
            docs.write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
    return docs
