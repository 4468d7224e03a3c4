"""Staging to transform: the four cleaned tables."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxmetrics.functions.convert import EUR_PER_GBP, area_in_m2, rate_in_eur
from boxmetrics.schemas import TRANSFORM_SCHEMAS
from boxmetrics.tables import Staging, Tables


def _columns(table: str) -> list[str]:
    return TRANSFORM_SCHEMAS[table].fieldNames()


def packaging_master(staged: DataFrame) -> DataFrame:
    """Add the area in square metres. Repeated rows stay."""
    area = area_in_m2(F.col("surface_area"), F.col("unit_of_measure"))
    return staged.withColumn("surface_area_m2_normalised", area).select(
        *_columns("dim_packaging_master")
    )


def packaging_standards(staged: DataFrame) -> DataFrame:
    return staged.select(*_columns("dim_packaging_standards")).distinct()


def procurement_cost(staged: DataFrame, eur_per_gbp: Decimal = EUR_PER_GBP) -> DataFrame:
    """Remove exact repeats and add the rate in euros."""
    rate = rate_in_eur(F.col("cost_per_m2"), F.col("currency"), eur_per_gbp)
    return (
        staged.distinct()
        .withColumn("cost_per_m2_eur", rate)
        .select(*_columns("dim_procurement_cost"))
    )


def box_usage(staged: DataFrame) -> DataFrame:
    """Remove exact repeats of usage rows.

    The one shuffle of the whole fact. It hashes all six columns, so neither a frequent
    order id nor a frequent market makes a partition large, and copies of a row are
    already merged before the shuffle.
    """
    return staged.select(*_columns("fact_box_usage")).distinct()


def build_transform(staging: Staging) -> Tables:
    return Tables(
        packaging=packaging_master(staging.packaging),
        standards=packaging_standards(staging.standards),
        rates=procurement_cost(staging.rates),
        usage=box_usage(staging.usage),
    )
