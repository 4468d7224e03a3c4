"""Normalisation of units, currencies and result types."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from boxmetrics.schemas import AREA_M2, RATE_EUR

CM2_PER_M2 = Decimal("10000")
EUR_PER_GBP = Decimal("1.17")


def area_in_m2(area: Column, unit: Column) -> Column:
    """Square centimetres become square metres, any other unit passes through."""
    return F.when(unit == "cm2", area.cast(AREA_M2) / F.lit(CM2_PER_M2)).otherwise(area).cast(AREA_M2)


def rate_in_eur(rate: Column, currency: Column, eur_per_gbp: Decimal = EUR_PER_GBP) -> Column:
    """Pounds become euros, any other currency passes through."""
    return F.when(currency == "GBP", rate * F.lit(eur_per_gbp)).otherwise(rate).cast(RATE_EUR)


def as_double(column: Column | str) -> Column:
    return (F.col(column) if isinstance(column, str) else column).cast("double")


def decimals_as_doubles(frame: DataFrame) -> DataFrame:
    """Results are doubles; decimals are only how they are computed."""
    return frame.select(
        *[
            as_double(field.name).alias(field.name)
            if isinstance(field.dataType, T.DecimalType)
            else F.col(field.name)
            for field in frame.schema.fields
        ]
    )
