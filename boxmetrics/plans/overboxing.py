"""Over-boxing per order and per market, and the split of overspend into its causes."""

from __future__ import annotations

from collections.abc import Mapping
from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxmetrics.functions import aggregates as agg
from boxmetrics.functions.convert import as_double, decimals_as_doubles
from boxmetrics.functions.cost import actual_cost, ideal_cost, overspend_parts, waste_cost
from boxmetrics.functions.fit import (
    BOX_LEVELS,
    box_level,
    fit_ratio,
    graded_fit,
    is_overboxed,
    waste_m2,
)
from boxmetrics.operators.filters import Q1_2026, Window, boxed, selected
from boxmetrics.operators.grain import folded, usage_counts, weighted
from boxmetrics.operators.lookups import with_box, with_rate, with_recommendation
from boxmetrics.operators.ordering import down, sorted_rows, up
from boxmetrics.operators.scenarios import in_copies
from boxmetrics.tables import Tables

# The two contract rates the decomposition compares.
NEW_RATE = Decimal("1.75")
OLD_RATE = Decimal("1.15")


def _rated(usage: DataFrame, tables: Tables) -> DataFrame:
    """Boxed usage with a known box, a known recommendation and a rate."""
    return with_rate(_standard_rows(boxed(usage), tables), tables)


def _boxes_of_orders(usage: DataFrame, levels: Mapping[str, int]) -> DataFrame:
    """Boxed rows counted per order and box level, as `copies`."""
    return (
        boxed(usage)
        .select("order_id", box_level(F.col("pkg_id"), levels).alias("paired_level"))
        .groupBy("order_id", "paired_level")
        .agg(F.count("*").alias("copies"))
    )


def _paired_on_order(tables: Tables, levels: Mapping[str, int]) -> DataFrame:
    """Rated rows paired with the boxes of all boxed rows of the same order.

    A row is paired with every boxed row of its order, itself included, of which only the
    box level is wanted. So the second side is counted per order and level; `copies` says how
    many pairs a row of the result stands for. Each order has at most one row per level on
    that side.

    Usage that is kept in buckets by order is joined without a shuffle. The counts of hot
    orders, which are few, are broadcast to their rows. Otherwise both sides are shuffled
    and merged, and adaptive execution splits an order id that many rows share. For that
    both sides must come straight from a shuffle on the order id: counting by it alone would
    save the second side one, but a hot order id would then stay in one task.
    """
    if tables.by_order is None:
        return _rated(tables.usage, tables).join(
            _boxes_of_orders(tables.usage, levels).hint("merge"), "order_id"
        )
    kept, hot = tables.by_order.usage, tables.by_order.of_hot_orders
    in_buckets = _rated(kept, tables).join(_boxes_of_orders(kept, levels).hint("merge"), "order_id")
    beside = F.broadcast(_boxes_of_orders(hot, levels))
    return in_buckets.unionByName(_rated(hot, tables).join(beside, "order_id"))


def overboxing_detail(tables: Tables, levels: Mapping[str, int] = BOX_LEVELS) -> DataFrame:
    """Fit, waste and cost of every order with a standard.

    An order id on several rows gives every pair of its rows, with the areas of one and
    the box level of the other. Rows without a box, standard or rate drop out before the
    pairing. All pairs are made before the sort. It cuts its ranges by the number of rows it
    is given, so only single pairs make ranges of equal weight; what it moves is what the
    report returns.
    """
    # Doubles sort much faster than decimals of this width.
    paired = _paired_on_order(tables, levels).withColumn("cost_inefficiency_eur", as_double(waste_cost()))
    pairs = in_copies(paired, "copies")
    skipped = F.col("paired_level") - box_level(F.col("recommended_pkg_id"), levels)
    in_order = sorted_rows(
        pairs, down("cost_inefficiency_eur"), up("order_date"), last=("paired_level", "copy")
    )
    result = in_order.select(
        "order_id",
        "market",
        F.col("pkg_id").alias("actual_pkg"),
        F.col("pkg_name").alias("actual_pkg_name"),
        "recommended_pkg_id",
        "recommended_pkg_name",
        "meals_count",
        "order_date",
        "actual_area_m2",
        "recommended_area_m2",
        waste_m2().alias("waste_m2"),
        fit_ratio().alias("fit_ratio"),
        skipped.alias("overbox_levels"),
        graded_fit().alias("fit_category"),
        "cost_per_m2_eur",
        actual_cost().alias("actual_cost_eur"),
        ideal_cost().alias("ideal_cost_eur"),
        "cost_inefficiency_eur",
        "is_damaged",
    )
    return decimals_as_doubles(result)


def overboxing_by_market(tables: Tables) -> DataFrame:
    """The same pairs summed up per market, without making the copies."""
    pairs = _paired_on_order(tables, BOX_LEVELS)
    counts = folded(
        weighted(pairs, tables, copies="copies"),
        "market",
        "actual_area_m2",
        "recommended_area_m2",
        "cost_per_m2_eur",
    )
    wasted, paid = agg.total(waste_cost()), agg.total(actual_cost())
    return (
        counts.groupBy("market")
        .agg(
            agg.rows().alias("total_orders"),
            agg.rows_where(is_overboxed()).alias("overboxed_orders"),
            agg.total(waste_m2()).alias("total_paper_waste_m2"),
            wasted.alias("total_cost_inefficiency_eur"),
            agg.mean_ratio(fit_ratio()).alias("avg_fit_ratio"),
            F.round(agg.share_pct(wasted, paid), 1).alias("pct_spend_wasted"),
        )
        .orderBy(down("total_cost_inefficiency_eur"), up("market"))
    )


def _standard_rows(frame: DataFrame, tables: Tables) -> DataFrame:
    return with_recommendation(with_box(frame, tables), tables, keep_unmatched=False)


def cost_decomposition(
    tables: Tables,
    market: str = "DE",
    window: Window = Q1_2026,
    new_rate: Decimal = NEW_RATE,
    old_rate: Decimal = OLD_RATE,
) -> DataFrame:
    """Price and size effects on every order of a market."""
    rows = _standard_rows(selected(tables.usage, market=market, window=window), tables)
    parts = overspend_parts(new_rate, old_rate)
    return sorted_rows(rows, up("order_date")).select(
        "order_id",
        "pkg_id",
        "recommended_pkg_id",
        "meals_count",
        "order_date",
        as_double("actual_area_m2").alias("actual_area_m2"),
        as_double("recommended_area_m2").alias("recommended_area_m2"),
        *[as_double(value).alias(name) for name, value in parts.items()],
    )


def attribution_totals(
    tables: Tables,
    market: str = "DE",
    window: Window = Q1_2026,
    new_rate: Decimal = NEW_RATE,
    old_rate: Decimal = OLD_RATE,
) -> DataFrame:
    """Totals of the effects, and the share each has in their sum."""
    counts = usage_counts(
        selected(tables.usage, market=market, window=window), tables, "pkg_id", "meals_count"
    )
    parts = overspend_parts(new_rate, old_rate)
    price, size = F.col("total_price_hike_impact_eur"), F.col("total_overboxing_impact_eur")
    both = price + size
    return (
        _standard_rows(counts, tables)
        .agg(
            agg.total(parts["actual_cost_eur"]).alias("total_actual_eur"),
            agg.total(parts["ideal_cost_eur"]).alias("total_ideal_eur"),
            agg.total(parts["counterfactual_cost_eur"]).alias("total_counterfactual_eur"),
            agg.total(parts["price_hike_impact_eur"]).alias("total_price_hike_impact_eur"),
            agg.total(parts["overboxing_impact_eur"]).alias("total_overboxing_impact_eur"),
        )
        .withColumn("pct_price_hike", agg.share_pct(price, both))
        .withColumn("pct_overboxing", agg.share_pct(size, both))
    )
