"""From raw documents to token ids: quality, toxicity, near-duplicates, decontamination, encoding.

Every stage takes the documents that the one before it kept and, but for the last, returns documents with all their columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from holdfast.llm import bpe, decontaminate, jaccard, quality, toxicity
from holdfast.llm.common import prepared, release, table
from holdfast.session import new_folder


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the certified cutoffs keep."""
    return quality.keep_good(docs, table(prepared(spark), sf_dir, "labels"))


def toxic_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic."""
    return toxicity.clean(docs, table(prepared(spark), sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-duplicates: the one of smallest doc_id."""
    prepared(spark)
    return jaccard.one_of_each(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by benchmark items."""
    return decontaminate.clean(docs, table(prepared(spark), sf_dir, "benchmark"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Counts and digests of the ids of each document."""
    prepared(spark)
    return bpe.encode(docs.select("doc_id", "text"), ("n_tokens", "ids_sha256", "decoded_sha256"), keep=False)


STAGES = [
    ("quality_rules", quality_rules),
    ("toxicity", toxic_documents),
    ("near_duplicates", near_duplicates),
    ("decontamination", benchmark_passages),
    ("byte_bpe", token_ids),
]

#: The stages use a trained machine and byte-pair merges, which SQL cannot express; see tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written as Parquet and read again.

    The driver lets go of a stage's plans before the next one, else they add up in its memory.
    """
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_folder(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        release(spark)
        docs = spark.read.parquet(path)
    return docs
