"""Data quality of usage: repeated ids, missing, discontinued and unstandardised boxes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxmetrics.operators.filters import boxed
from boxmetrics.operators.grain import usage_counts
from boxmetrics.operators.lookups import with_box, with_standard
from boxmetrics.operators.ordering import down, sorted_rows, up
from boxmetrics.tables import Tables

# Fixed values.
DISCONTINUED = "Discontinued"
DUPLICATES = "Duplicate order IDs"
NULL_BOXES = "Null pkg_id orders"
DISCONTINUED_BOXES = "Discontinued box in active use"
UNKNOWN_MEALS = "Meal count not in standards table"


def duplicate_orders(tables: Tables) -> DataFrame:
    """Order ids on more than one row (rows equal in every column are already gone)."""
    return (
        tables.usage.groupBy("order_id")
        .agg(
            F.count("*").alias("occurrence_count"),
            F.min("order_date").alias("order_date"),
            F.max("market").alias("market"),
            F.max("pkg_id").alias("pkg_id"),
        )
        .filter(F.col("occurrence_count") > 1)
        .orderBy(down("occurrence_count"), up("order_id"))
    )


def null_boxes(tables: Tables) -> DataFrame:
    rows = tables.usage.filter(F.col("pkg_id").isNull())
    return sorted_rows(rows, up("order_date")).select(
        "order_id", "market", "meals_count", "order_date", "is_damaged"
    )


def discontinued_in_use(tables: Tables) -> DataFrame:
    rows = with_box(boxed(tables.usage), tables).filter(F.col("pkg_status") == DISCONTINUED)
    return sorted_rows(rows, up("order_date")).select(
        "order_id",
        "market",
        "pkg_id",
        "pkg_name",
        F.col("pkg_status").alias("status"),
        "meals_count",
        "order_date",
    )


def meals_without_standard(tables: Tables) -> DataFrame:
    rows = with_standard(boxed(tables.usage), tables).filter(F.col("recommended_pkg_id").isNull())
    return sorted_rows(rows, up("meals_count"), up("order_date")).select(
        "order_id", "market", "pkg_id", "meals_count", "order_date", "recommended_pkg_id"
    )


def audit_summary(tables: Tables) -> DataFrame:
    """Number of findings of each kind.

    Three of the four are conditional sums over usage counted per box and meal count, so
    they share one pass. The dimensions are reduced to the number of matches per key, so
    that a repeated key counts as often as a join would return it.
    """
    repeated_ids = tables.usage.groupBy("order_id").count().filter(F.col("count") > 1)
    discontinued = (
        tables.packaging.filter(F.col("status") == DISCONTINUED)
        .groupBy("pkg_id")
        .agg(F.count("*").alias("discontinued_matches"))
    )
    empty_standards = tables.standards.groupBy("meals_count").agg(
        F.count_if(F.col("recommended_pkg_id").isNull()).alias("empty_matches")
    )
    counts = (
        usage_counts(tables.usage, tables, "pkg_id", "meals_count")
        .join(discontinued, "pkg_id", "left")
        .join(empty_standards, "meals_count", "left")
    )
    rows, is_boxed = F.col("usage_rows"), F.col("pkg_id").isNotNull()
    without_standard = rows * F.coalesce(F.col("empty_matches"), F.lit(1))
    zero = F.lit(0).cast("bigint")
    totals = counts.agg(
        F.coalesce(F.sum(F.when(~is_boxed, rows)), zero).alias("null_boxes"),
        F.coalesce(F.sum(rows * F.col("discontinued_matches")), zero).alias("discontinued"),
        F.coalesce(F.sum(F.when(is_boxed, without_standard)), zero).alias("unknown_meals"),
    )
    findings = F.array(
        *[
            F.struct(F.lit(label).alias("issue_type"), F.col(name).alias("affected_records"))
            for label, name in (
                (NULL_BOXES, "null_boxes"),
                (DISCONTINUED_BOXES, "discontinued"),
                (UNKNOWN_MEALS, "unknown_meals"),
            )
        ]
    )
    duplicates = repeated_ids.agg(F.count("*").alias("affected_records")).select(
        F.lit(DUPLICATES).alias("issue_type"), "affected_records"
    )
    return duplicates.unionByName(totals.select(F.inline(findings)))
