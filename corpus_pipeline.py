"""The corpus pipeline: each stage works on what its predecessor kept, written and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from gridproof.llm import decontaminate, line_dedup, mixing, ngram_join, quality_crf
from gridproof.sources.scratch import shared_folder


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the line labels keep."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_crf.keep(docs, quality_crf.train(docs, labels))


def line_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later repeats of runs of lines; n_chars follows the text.

    A document of whose words less than a fifth stays is a near copy of what stood
    earlier and goes: what is left of it would pass the next stage unseen.
    """
    return line_dedup.keep_rest(docs, least_percent=20)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group."""
    return ngram_join.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without test items."""
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies of the documents by the target weights of their sources, in shards."""
    return mixing.mix_plan(docs).mixed()


STAGES = [
    ("quality_rules", quality_rules),
    ("line_duplicates", line_duplicates),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("source_mix", source_mix),
]

#: The first stage holds a trained model, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/stages-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
