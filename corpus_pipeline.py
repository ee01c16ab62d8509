"""The corpus pipeline: quality rules, exact and near deduplication, mixing, encoding.

Every stage takes what its predecessor kept; all but the last return the
columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from geoloom.llm import bpe, exact_dedup, mixing, near, quality
from geoloom.llm.common import table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the base rules or the decision list learned from the labels reject."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.keep(docs, quality.learn(quality.sample(docs, labels)))


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays."""
    return exact_dedup.keep_last(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by SimHash fingerprints at most 4 bits apart, or by a similarity of 0.8 of
    their five-word shingles, the one with the smallest doc_id stays."""
    return near.keep_first(docs, radius=4)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or drops documents so that the sources meet their target weights."""
    return mixing.mix(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every document, and digests of ids and decoded text."""
    return bpe.encode(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("exact dedup", exact_dedup_stage),
    ("simhash near-dedup", near_dedup),
    ("source mix", source_mix),
    ("bpe encoding", encoding),
]

#: The learned list, the components and BPE are beyond SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = table(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
