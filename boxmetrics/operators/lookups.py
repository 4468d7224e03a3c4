"""Joins of usage to the dimensions.

Usage is never shuffled on a dimension key while the lookup is within the broadcast
limit: markets, boxes and meal counts have few values, so such a shuffle would put most
rows into a handful of tasks. A lookup beyond the limit is joined by sorting and merging,
and adaptive execution splits the hot partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxmetrics.tables import Tables


def with_box(frame: DataFrame, tables: Tables) -> DataFrame:
    """Add the box that was used. Rows with a box the master does not know drop out."""
    return frame.join(tables.box_lookup, "pkg_id")


def with_recommendation(frame: DataFrame, tables: Tables, *, keep_unmatched: bool) -> DataFrame:
    """Add the box recommended for the number of meals.

    With `keep_unmatched` orders without a standard stay, with nulls; otherwise they
    drop out.
    """
    if keep_unmatched:
        return frame.join(tables.recommendation_lookup, "meals_count", "left")
    return frame.join(tables.known_recommendation_lookup, "meals_count")


def with_standard(frame: DataFrame, tables: Tables) -> DataFrame:
    """Add only the id of the recommended box, null where there is no standard."""
    return frame.join(tables.standard_lookup, "meals_count", "left")


#: Copies of each rate in a shuffled lookup, among which the rows of a market and month are dealt.
RATE_COPIES = 32


def with_rate(frame: DataFrame, tables: Tables) -> DataFrame:
    """Add the rate in force in the market on the order date.

    Rows without such a rate drop out; two rates in force at once give two rows. Rates are
    looked up by day. If a row per rate and day is too much to broadcast, they are matched
    by month in a shuffle join, and their first and last day is compared. There are few
    markets and months, and one may have most of the rows. So the rows of each are dealt over
    RATE_COPIES copies of its rates, by a hash of all that a row has.
    """
    if tables.calendar_fits:
        calendar = F.broadcast(tables.rate_calendar)
        same_day = F.col("order_date") == F.col("rate_date")
        joined = frame.join(calendar, _same_market() & same_day).drop("rate_date")
    else:
        joined = _by_month(frame, tables.rates_in_use)
    return joined.drop("rate_market")


def _by_month(frame: DataFrame, rates: DataFrame, copies: int = RATE_COPIES) -> DataFrame:
    """The interval join as an equality join on market, month and number of the copy."""
    dealt = F.pmod(F.xxhash64(*frame.columns), F.lit(copies)).cast("int")
    every = F.sequence(F.lit(0), F.lit(copies - 1))
    by_month = (
        rates.withColumn("rate_month", F.explode(_months()))
        .withColumn("rate_copy", F.explode(every))
        .hint("merge")
    )
    valid = F.col("order_date").between(F.col("first_day"), F.col("last_day"))
    same = (F.col("order_month_of_rate") == F.col("rate_month")) & (F.col("order_copy") == F.col("rate_copy"))
    return (
        frame.withColumns({"order_month_of_rate": F.trunc("order_date", "month"), "order_copy": dealt})
        .join(by_month, _same_market() & same & valid)
        .drop("order_month_of_rate", "order_copy", "rate_month", "rate_copy", "first_day", "last_day")
    )


def _same_market() -> Column:
    return F.col("market") == F.col("rate_market")


def _months() -> Column:
    first, last = F.trunc("first_day", "month"), F.trunc("last_day", "month")
    return F.sequence(first, last, F.expr("interval 1 month"))
