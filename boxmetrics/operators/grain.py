"""Pre-aggregation of usage before anything is computed from it.

A measure of an order depends only on a few columns with few values: market, box, number
of meals, rate. So the reports count usage per combination first and do their arithmetic
on the counts. The large table then needs one pass with integer additions, the shuffle
carries one row per combination and task, and a combination that holds a third of all
rows collapses before it is shuffled.

A frame at this grain carries three weights per row: `usage_rows` (rows), `order_count`
(rows with an order id) and `damaged_orders` (sum of the damage flag).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxmetrics.operators.lookups import with_rate
from boxmetrics.tables import Tables

WEIGHTS = ("usage_rows", "order_count", "damaged_orders")


def weighted(usage: DataFrame, tables: Tables, copies: str | None = None) -> DataFrame:
    """Add the weights of a single row, or of `copies` equal rows.

    Order ids take most of the space of usage. They are read only if some are missing.
    """
    times = F.lit(1).cast("bigint") if copies is None else F.col(copies)
    counted = F.when(F.col("order_id").isNotNull(), times).otherwise(F.lit(0))
    return usage.withColumns(
        {
            "usage_rows": times,
            "order_count": times if tables.order_ids_complete else counted,
            "damaged_orders": F.col("is_damaged") * times,
        }
    )


def folded(frame: DataFrame, *keys: str) -> DataFrame:
    """Add up the weights per combination of `keys`."""
    return frame.groupBy(*keys).agg(*[F.sum(name).alias(name) for name in WEIGHTS])


def usage_counts(usage: DataFrame, tables: Tables, *keys: str) -> DataFrame:
    return folded(weighted(usage, tables), *keys)


def rated_counts(weighted_usage: DataFrame, tables: Tables, *keys: str) -> DataFrame:
    """Weights per combination of `keys` and rate in force.

    The rate is looked up before counting, so that dates need not be kept apart. With
    rates too many to broadcast it is the other way round: counting per date first makes
    the table small, and the join shuffles only the counts.
    """
    if not tables.calendar_fits:
        weighted_usage = folded(weighted_usage, *keys, "order_date")
    return folded(with_rate(weighted_usage, tables), *keys, "cost_per_m2_eur")
