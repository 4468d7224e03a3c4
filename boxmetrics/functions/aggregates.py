"""Aggregates over rows that stand for many usage rows each (see `operators.grain`).

Sums are taken in decimals or whole numbers and cast to double at the end, so they are the
same for any partitioning. Every function gives what the plain aggregate over single rows gives: nulls
are left out, sums over nothing are null and counts over nothing are 0.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from boxmetrics.functions.convert import as_double
from boxmetrics.schemas import COST, ROWS, WHOLE

_HUNDRED = 100.0


def rows() -> Column:
    return F.coalesce(F.sum("usage_rows"), F.lit(0).cast("bigint"))


def orders() -> Column:
    return F.coalesce(F.sum("order_count"), F.lit(0).cast("bigint"))


def damaged() -> Column:
    return F.sum("damaged_orders")


def meals() -> Column:
    return F.sum(F.col("meals_count") * F.col("usage_rows"))


def total(value: Column) -> Column:
    """Sum of an area, rate or cost."""
    return as_double(F.sum(value.cast(COST) * F.col("usage_rows").cast(ROWS)))


def mean(value: Column) -> Column:
    """Average of an area, rate or cost."""
    return total(value) / F.sum(F.when(value.isNotNull(), F.col("usage_rows")))


#: Binary places of the two parts in which quotients are added up, together more than a double has.
_HIGH_PLACES, _LOW_PLACES = 2.0**26, 2.0**40


def mean_ratio(value: Column) -> Column:
    """Average of a quotient of doubles.

    A sum of doubles depends on the order of its rows. So each is split, without an error, into
    a whole number of 2**-26 and a rest, of which 40 more places are kept. Both parts are
    added up as whole numbers.
    """
    scaled = value * _HIGH_PLACES
    rest = F.pmod(scaled, F.lit(1.0))
    high, low = (scaled - rest).cast(WHOLE), F.floor(rest * _LOW_PLACES).cast(WHOLE)
    count = F.col("usage_rows").cast(ROWS)
    sums = as_double(F.sum(high * count)) + as_double(F.sum(low * count)) / _LOW_PLACES
    return sums / _HIGH_PLACES / F.sum(F.when(value.isNotNull(), F.col("usage_rows")))


def rows_where(condition: Column) -> Column:
    return F.sum(F.when(condition, F.col("usage_rows")).otherwise(F.lit(0)))


def share_pct(part: Column, whole: Column) -> Column:
    """Percentage of two sums, null where the whole is 0."""
    return part / F.nullif(whole, F.lit(0.0)) * _HUNDRED


def damage_pct() -> Column:
    return as_double(damaged()) * _HUNDRED / orders()


def damage_pct_one_place() -> Column:
    """Damage rate rounded half up to one place, in whole numbers so that it is exact."""
    tenths = F.call_function("div", F.lit(2000) * damaged() + orders(), F.lit(2) * orders())
    return as_double(tenths) / 10.0


def overboxed_pct(overboxed: Column) -> Column:
    return as_double(rows_where(overboxed)) / orders() * _HUNDRED
