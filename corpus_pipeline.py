"""The corpus pipeline: filter, deduplicate, decontaminate, mix and shard documents.

Every stage takes (spark, docs, sf_dir) and returns the documents it keeps, all
columns kept; the last returns the shard and slot of every document of the mix. The
result of a stage is written to the shared folder and read back as the next one's
input. Empty tables go through as empty tables; each operator says what it makes of
nulls, empty texts and repeated rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from timelens.llm import decontaminate, jaccard, mixing, quality, sharding
from timelens.llm.tables import read_table, settle


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes for good; trained on labels of these documents."""
    return quality.keep_good(docs, read_table(spark, sf_dir, "labels"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of every group of near duplicates."""
    return jaccard.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.take_mix(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", good_documents),
    ("ngram_jaccard_join", one_of_each),
    ("benchmark_decontamination", decontamination),
    ("curriculum_mix", mixture),
    ("sharding", shards),
]

#: The classifier's scores cannot be written in SQL; tests follow the stages by hand.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
