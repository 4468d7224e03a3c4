"""What the text operators share: row identity, stored intermediate tables, numbering.

Rows are told apart by `doc_id` and a hash of the text. Rows that repeat both are copies of
each other and get equal results, one per row. A null text counts as an empty one.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from boxmetrics.operators.sizing import fits

KEY = ("doc_id", "text_hash")
NUMBERING_BUCKETS = 4096
#: What a list of row keys may take as a broadcast. Beyond it the join shuffles.
KEYS_LIMIT_BYTES = 32 * 1024 * 1024

_local_folders: list[tempfile.TemporaryDirectory] = []


def scratch_folder(spark: SparkSession) -> str:
    """The folder all executors share, as `spark.checkpoint.dir` names it.

    Only a session on one machine may go without; it gets a folder that ends with it.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.conf.get("spark.master", "").startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    if not _local_folders:
        _local_folders.append(tempfile.TemporaryDirectory(prefix="boxmetrics-llm-"))
    return _local_folders[0].name


def stored(frame: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder: computed once, and safe from lost executors."""
    spark = frame.sparkSession
    folder = f"{scratch_folder(spark)}/boxmetrics-llm/{name}-{uuid.uuid4().hex}"
    frame.write.option("compression", "zstd").parquet(folder)
    return spark.read.schema(frame.schema).parquet(folder)


def keyed(documents: DataFrame) -> DataFrame:
    """Only id, text and hash of the text; other columns, whatever their names, are left out."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumn(
        "text_hash", F.xxhash64("text")
    )


def with_results(documents: DataFrame, results: DataFrame, how: str = "left") -> DataFrame:
    """Rows joined to results that have at most one row per key; keys may be null."""
    named = results.withColumnsRenamed({name: f"_{name}" for name in KEY})
    same = documents["doc_id"].eqNullSafe(named["_doc_id"]) & (documents["text_hash"] == named["_text_hash"])
    joined = documents.join(named, same, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop("_doc_id", "_text_hash")


def small_or_merged(frame: DataFrame, limit: int = KEYS_LIMIT_BYTES) -> DataFrame:
    """Hinted as a broadcast if its measured size allows it, otherwise as a merge."""
    return F.broadcast(frame) if fits(frame, limit) else frame.hint("merge")


def numbered(frame: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """Gapless numbers from 0 within each value of `group`, also where one value has most rows.

    The rows of a group are dealt over buckets by a hash of `order`, numbered there, and
    moved by the sizes of the buckets before. Rows that agree in `order` are alike; which
    of them comes first does not matter.
    """
    rows = frame.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(NUMBERING_BUCKETS)).cast("int"))
    sizes = rows.groupBy(group, "_bucket").agg(F.count("*").alias("_size"))
    before = F.sum("_size").over(_before(group))
    starts = sizes.select(group, "_bucket", F.coalesce(before, F.lit(0)).cast("long").alias("_start"))
    within = F.row_number().over(_within(group, order))
    numbers = rows.withColumn("_row", within - 1)
    return (
        numbers.join(starts, [group, "_bucket"])
        .withColumn(name, F.col("_start") + F.col("_row"))
        .drop("_bucket", "_start", "_row")
    )


def _before(group: str):
    return Window.partitionBy(group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)


def _within(group: str, order: list[str]):
    return Window.partitionBy(group, "_bucket").orderBy(*order)
