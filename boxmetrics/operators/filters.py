"""Row selections on usage."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Window:
    """A range of dates with both ends included."""

    start: date
    end: date


#: Usage in a layer is kept by this column, the first day of the order's month.
MONTH = "order_month"

Q1_2026 = Window(date(2026, 1, 1), date(2026, 3, 31))


def boxed(usage: DataFrame) -> DataFrame:
    """Usage rows that name a box."""
    return usage.filter(F.col("pkg_id").isNotNull())


def ordered_within(usage: DataFrame, window: Window) -> DataFrame:
    """Orders of a range of dates. Of usage kept by month, only the months in it are opened."""
    if MONTH in usage.columns:
        months = (F.lit(day.replace(day=1)) for day in (window.start, window.end))
        usage = usage.filter(F.col(MONTH).between(*months))
    return usage.filter(F.col("order_date").between(F.lit(window.start), F.lit(window.end)))


def selected(
    usage: DataFrame,
    *,
    window: Window | None = None,
    market: str | None = None,
    pkg_id: str | None = None,
    meals_count: int | None = None,
) -> DataFrame:
    """Boxed usage rows that match every condition given."""
    rows = boxed(usage)
    if window is not None:
        rows = ordered_within(rows, window)
    for column, wanted in (("market", market), ("pkg_id", pkg_id), ("meals_count", meals_count)):
        if wanted is not None:
            rows = rows.filter(F.col(column) == F.lit(wanted))
    return rows


def in_force(rates: DataFrame, on: date) -> DataFrame:
    """Rates valid on one day."""
    return rates.filter(F.lit(on).between(F.col("valid_from"), F.col("valid_to")))
