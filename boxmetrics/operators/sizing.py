"""Measured sizes, the condition for every broadcast."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BROADCAST_LIMIT_BYTES = 64 * 1024 * 1024

# What a row costs in a hash table beside its text: a word per column, and its pointers.
_WORD = 8
_ROW_OVERHEAD = 32


def row_bytes(columns: int) -> int:
    """What a row takes beside its text."""
    return _ROW_OVERHEAD + 2 * _WORD * columns


def measured_bytes(frame: DataFrame) -> int:
    """Size of the frame in memory, from one distributed aggregate over all of it."""
    texts = [
        F.coalesce(F.octet_length(F.col(field.name)), F.lit(0))
        for field in frame.schema.fields
        if isinstance(field.dataType, T.StringType)
    ]
    fixed = F.lit(row_bytes(len(frame.schema.fields)))
    total = frame.agg(F.sum(reduce(add, texts, fixed).cast("bigint")).alias("bytes"))
    return total.first()["bytes"] or 0


def fits(frame: DataFrame, limit: int = BROADCAST_LIMIT_BYTES) -> bool:
    return measured_bytes(frame) <= limit
