"""The queries of this package and, where SQL can express them, the same results as SQL."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from boxmetrics.llm import sql
from boxmetrics.llm.clustering import centroid_clusters
from boxmetrics.llm.decontamination import contamination
from boxmetrics.llm.filter_audit import audit
from boxmetrics.llm.language_model import scored as language_scores
from boxmetrics.llm.line_rules import quality as line_quality
from boxmetrics.llm.packing import Vocabulary, packed
from boxmetrics.llm.privacy import personal_data
from boxmetrics.llm.quality import scored
from boxmetrics.llm.secrets import secrets
from boxmetrics.llm.sharding import sharded
from boxmetrics.llm.simhash import near_duplicates
from boxmetrics.llm.substrings import deduplicated
from boxmetrics.llm.tokenization import round_trips


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/documents.parquet")


def vocabulary() -> Vocabulary:
    """The byte-level vocabulary of `byte_bpe_50k.json`, as ranks; all machines have the file.

    Only the added tokens are read from the JSON itself.
    """
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        added = json.load(file)["added_tokens"]
    if any(token[flag] for token in added for flag in ("single_word", "lstrip", "rstrip", "normalized")):
        raise ValueError("added tokens are found as they are, without regard to what is beside them")
    tokens = tuple((token["content"], token["id"]) for token in added)
    return Vocabulary(str(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN, tokens)


def op1_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packed(_documents(spark, folder), vocabulary())


def op2_secrets(spark: SparkSession, folder: str) -> DataFrame:
    return secrets(_documents(spark, folder))


def op3_substrings(spark: SparkSession, folder: str) -> DataFrame:
    return deduplicated(_documents(spark, folder))


def op4_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    items = spark.read.parquet(f"{folder.rstrip('/')}/benchmark.parquet")
    return contamination(_documents(spark, folder), items).drop("text_hash")


def op5_quality(spark: SparkSession, folder: str) -> DataFrame:
    labels = spark.read.parquet(f"{folder.rstrip('/')}/labels.parquet")
    return scored(_documents(spark, folder), labels)


def op6_language_model(spark: SparkSession, folder: str) -> DataFrame:
    return language_scores(_documents(spark, folder))


def op7_line_rules(spark: SparkSession, folder: str) -> DataFrame:
    return line_quality(_documents(spark, folder)).drop("clean_text")


def op8_privacy(spark: SparkSession, folder: str) -> DataFrame:
    return personal_data(_documents(spark, folder))


def op9_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(_documents(spark, folder)).select("doc_id", "fingerprint", "component_id")


def op10_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharded(_documents(spark, folder))


def op11_tokenization(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    return round_trips(_documents(spark, folder), str(public_tokenizers.path("byte_bpe_50k.json")))


def op12_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    labels = spark.read.parquet(f"{folder.rstrip('/')}/labels.parquet")
    return audit(_documents(spark, folder), labels)


def op13_clustering(spark: SparkSession, folder: str) -> DataFrame:
    return centroid_clusters(spark.read.parquet(f"{folder.rstrip('/')}/embeddings.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_packing": op1_packing,
        "op2_secrets": op2_secrets,
        "op3_substrings": op3_substrings,
        "op4_decontamination": op4_decontamination,
        "op5_quality": op5_quality,
        "op6_language_model": op6_language_model,
        "op7_line_rules": op7_line_rules,
        "op8_privacy": op8_privacy,
        "op9_simhash": op9_simhash,
        "op10_sharding": op10_sharding,
        "op11_tokenization": op11_tokenization,
        "op12_filter_audit": op12_filter_audit,
        "op13_clustering": op13_clustering,
    }


def oracle_sql() -> dict[str, str]:
    return sql.oracle_sql()
