"""Total orders with nulls placed explicitly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A usage row is unique over these columns. Used as tie-breakers they make the order
# complete, and let the range shuffle split a sort key that many rows share.
ROW_IDENTITY = ("order_id", "market", "pkg_id", "meals_count", "order_date", "is_damaged")


def up(column: str) -> Column:
    return F.col(column).asc_nulls_last()


def down(column: str) -> Column:
    return F.col(column).desc_nulls_first()


def sorted_rows(frame: DataFrame, *keys: Column, last: tuple[str, ...] = ()) -> DataFrame:
    """Sort row-level results; `frame` still has all columns of a usage row.

    `last` names what tells apart several rows made of one usage row.
    """
    return frame.orderBy(*keys, *[up(name) for name in (*ROW_IDENTITY, *last)])
