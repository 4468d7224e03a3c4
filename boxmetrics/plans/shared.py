"""Frames that several reports start from."""

from __future__ import annotations

from pyspark.sql import DataFrame

from boxmetrics.operators.grain import rated_counts, weighted
from boxmetrics.operators.lookups import with_box, with_rate, with_recommendation
from boxmetrics.tables import Tables

_COMBINATION = ("market", "pkg_id", "meals_count")


def priced_rows(usage: DataFrame, tables: Tables) -> DataFrame:
    """Usage rows with box, recommendation (if any) and rate."""
    return with_rate(
        with_recommendation(with_box(usage, tables), tables, keep_unmatched=True), tables
    )


def counted(usage: DataFrame, tables: Tables, *more_keys: str) -> DataFrame:
    """Usage counted per market, box, meals and rate, with the facts about the box."""
    counts = rated_counts(weighted(usage, tables), tables, *_COMBINATION, *more_keys)
    return with_box(counts, tables)


def counted_with_standards(
    usage: DataFrame, tables: Tables, *more_keys: str, keep_unmatched: bool = True
) -> DataFrame:
    """The same, with the recommended box."""
    return with_recommendation(
        counted(usage, tables, *more_keys), tables, keep_unmatched=keep_unmatched
    )
