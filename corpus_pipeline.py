"""A corpus pipeline: quality, near duplicates, benchmark passages, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame. Its result is written as
Parquet and read again as the next stage's documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxmetrics.llm.common import scratch_folder, small_or_merged, stored, with_results
from boxmetrics.llm.decontamination import contamination
from boxmetrics.llm.packing import packed
from boxmetrics.llm.privacy import redacted
from boxmetrics.llm.quality import KEPT_SCORE, quality_score, trained
from boxmetrics.llm.queries import vocabulary
from boxmetrics.llm.simhash import representatives


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _rows_of(docs: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """The documents, all columns as they are, that have or have not one of the keys."""
    whole = docs.select(F.struct(*[F.col(f"`{name}`") for name in docs.columns]).alias("row"))
    named = whole.select(
        "row",
        F.col("row.doc_id").cast("long").alias("doc_id"),
        F.xxhash64(F.coalesce(F.col("row.text").cast("string"), F.lit(""))).alias("text_hash"),
    )
    # Few keys go to the rows; only where they are many the rows are shuffled to them.
    listed = small_or_merged(stored(keys.select("doc_id", "text_hash"), "keys"))
    return with_results(named, listed, how).select("row.*")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts. It is trained on the labelled ones given.

    A null or empty text is judged as a text without words. A row without an id is never
    trained on. Without labels of both kinds no document is rejected.
    """
    forest = trained(docs, _table(spark, sf_dir, "labels"))
    return docs.filter(quality_score(F.col("text"), forest) >= KEPT_SCORE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group; of rows with equal id and text, the one whose other
    values are the smallest, column by column, nulls first. A null text equals an empty one."""
    kept = _rows_of(docs, representatives(docs), "left_semi")
    row = F.struct(*[F.col(f"`{name}`") for name in docs.columns])
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return kept.groupBy("doc_id", text.alias("words")).agg(F.min(row).alias("row")).select("row.*")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any passage of the benchmark; null and empty texts have none."""
    found = contamination(docs, _table(spark, sf_dir, "benchmark"))
    hit = found.filter("contaminated").select("doc_id", "text_hash").distinct()
    return _rows_of(docs, hit, "left_anti")


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind. A null text stays null, and its
    `n_chars` then is null too."""
    cleaned = redacted(docs)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        cleaned = cleaned.withColumn("n_chars", F.length("text").cast(kind))
    return cleaned


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in their sequences; a null or empty text is its end id alone."""
    return packed(docs, vocabulary())


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("packing", packing),
]

#: Trees, fingerprints and token ids are beyond SQL; the tests go stage by stage instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to `documents`; each result but the last is stored in between."""
    folder = f"{scratch_folder(spark)}/boxmetrics-llm/pipeline-{uuid.uuid4().hex}"
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
