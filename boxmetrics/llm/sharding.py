"""Sharding by jump consistent hashing (Lamping and Veach, 2014).

The number of shards and the key decide; there is no ring to store. When a shard is added,
each key stays or moves into the new shard.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxmetrics.llm.common import numbered

SHARDS = 24
ROW_BYTES = 8


def jump_shards(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each unsigned 64-bit key."""
    state = keys.astype(np.uint64)
    shard = np.zeros(len(state), dtype=np.int64)
    jump = np.zeros(len(state), dtype=np.int64)
    active = np.arange(len(state))
    while len(active):
        shard[active] = jump[active]
        state[active] = state[active] * np.uint64(2862933555777941757) + np.uint64(1)
        step = float(1 << 31) / ((state[active] >> np.uint64(33)).astype(np.float64) + 1.0)
        jump[active] = ((shard[active] + 1) * step).astype(np.int64)
        active = active[jump[active] < shards]
    return shard


def shard_of(key: Column, shards: int) -> Column:
    @F.arrow_udf("int")
    def assigned(keys: pa.Array) -> pa.Array:
        values = keys.to_numpy(zero_copy_only=False).view(np.uint64)
        return pa.array(jump_shards(values, shards).astype(np.int32))

    return assigned(key)


def stable_key() -> Column:
    """Hash of the id alone. Rows without an id are spread by their text instead."""
    return F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id")).otherwise(F.xxhash64("text_crc32", "size"))


def sharded(documents: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Shard and place in the shard of every document.

    Each input row gives one row, repeated rows too. A null text has no bytes. Rows with
    equal ids go to the same shard; rows without an id are spread by size and checksum of
    their text. Slots run from 0 without gaps in every shard. Other columns are ignored.
    """
    # A checksum reads the text as bytes; null and empty texts have 0.
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text).cast("long") + ROW_BYTES).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    ).withColumn("key", stable_key())
    placed = rows.withColumns(
        {"shard": shard_of(F.col("key"), shards), "grown_shard": shard_of(F.col("key"), shards + 1)}
    )
    return numbered(placed, "shard", ["doc_id", "size", "text_crc32"], "slot").select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard"
    )


def write_shards(documents: DataFrame, folder: str, shards: int = SHARDS) -> str:
    """All columns of the documents as one Parquet folder per shard; gives the folders' name.

    Folders are named `shard`, with as many underscores before it as it takes to differ from
    all columns. Null texts count as empty, and repeated rows are all written. A shard has as
    many files as its bytes need; one that gets no rows has no folder.
    """
    name = "shard"
    while name in (column.lower() for column in documents.columns):
        name = f"_{name}"
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    key = F.when(F.col("doc_id").isNotNull(), F.xxhash64(F.col("doc_id").cast("long"))).otherwise(
        F.xxhash64(F.crc32(text.cast("binary")), F.octet_length(text).cast("long") + ROW_BYTES)
    )
    dealt = documents.withColumn(name, shard_of(key, shards))
    dealt.hint("rebalance", name).write.partitionBy(name).parquet(folder)
    return name
