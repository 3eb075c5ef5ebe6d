"""The registered queries of this subpackage and the SQL that some of them follow."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timelens.llm import (
    decontaminate,
    hostrules,
    jaccard,
    languages,
    licenses,
    mixing,
    phrases,
    prefixes,
    quality,
    repeats,
    sharding,
    toxicity,
    warc,
)
from timelens.llm.sql import ORACLE
from timelens.llm.tables import read_table, work_dir


def op1_ngram_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    return quality.judge_quality(docs, labels)


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")
    return decontaminate.judge_contamination(docs, benchmark).drop("signature")


def op3_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = repeats.remove_repeats(read_table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op4_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hostrules.judge_documents(read_table(spark, sf_dir, "documents"))


def op5_dictionary_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.archive_pages(read_table(spark, sf_dir, "pages"), work_dir(spark, "warc"))
    return records.drop("payload")


def op6_rendezvous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(read_table(spark, sf_dir, "documents"))


def op7_string_kernel_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    return toxicity.judge_toxicity(docs, labels)


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link_documents(read_table(spark, sf_dir, "documents"))


def op9_license_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(read_table(spark, sf_dir, "documents"))


def op10_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(read_table(spark, sf_dir, "documents"))


def op11_hyperdimensional_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages.judge_language(read_table(spark, sf_dir, "documents"))


def op12_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(read_table(spark, sf_dir, "documents"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixes.prefix_trie(read_table(spark, sf_dir, "conversations"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            op1_ngram_quality,
            op2_decontaminate,
            op3_recompression,
            op4_host_rules,
            op5_dictionary_warc,
            op6_rendezvous_shards,
            op7_string_kernel_toxicity,
            op8_jaccard_join,
            op9_license_notices,
            op10_curriculum_mix,
            op11_hyperdimensional_language,
            op12_phrase_mining,
            op13_prefix_trie,
        )
    }


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
