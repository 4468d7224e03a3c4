"""Cost, waste and quality per market."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxmetrics.functions import aggregates as agg
from boxmetrics.functions.cost import actual_cost, ideal_cost, waste_cost
from boxmetrics.functions.fit import is_overboxed, waste_m2
from boxmetrics.operators.filters import Q1_2026, Window, boxed, selected
from boxmetrics.operators.ordering import down, up
from boxmetrics.plans.shared import counted, counted_with_standards
from boxmetrics.tables import Tables


def total_cost_per_market(tables: Tables, window: Window = Q1_2026) -> DataFrame:
    cost, rate = actual_cost(), F.col("cost_per_m2_eur")
    return (
        counted(selected(tables.usage, window=window), tables)
        .groupBy("market")
        .agg(
            agg.orders().alias("order_count"),
            agg.total(F.col("actual_area_m2")).alias("total_surface_m2"),
            agg.mean(rate).alias("avg_rate_eur_per_m2"),
            agg.total(cost).alias("total_cost_eur"),
            agg.mean(cost).alias("avg_order_cost_eur"),
            agg.damaged().alias("damaged_orders"),
            agg.damage_pct_one_place().alias("damage_rate_pct"),
        )
        .orderBy(down("total_cost_eur"), up("market"))
    )


def financial_variance(tables: Tables, window: Window = Q1_2026) -> DataFrame:
    return (
        counted(selected(tables.usage, window=window), tables)
        .groupBy("market")
        .agg(
            agg.orders().alias("order_count"),
            agg.total(F.col("actual_area_m2")).alias("total_surface_m2"),
            agg.total(actual_cost()).alias("total_cost_eur"),
        )
        .orderBy(down("total_cost_eur"), up("market"))
    )


def overboxing_gap(tables: Tables, window: Window = Q1_2026) -> DataFrame:
    """Waste of the over-boxed orders only."""
    counts = counted_with_standards(
        selected(tables.usage, window=window), tables, keep_unmatched=False
    )
    return (
        counts.filter(F.col("actual_area_m2") > F.col("recommended_area_m2"))
        .groupBy("market")
        .agg(
            agg.rows().alias("overboxed_orders"),
            agg.total(waste_m2()).alias("total_paper_waste_m2"),
            agg.total(waste_cost()).alias("total_cost_inefficiency_eur"),
        )
        .orderBy(down("total_cost_inefficiency_eur"), up("market"))
    )


def market_scorecard(tables: Tables) -> DataFrame:
    """Volume, cost, waste and damage, and the mean of three of them as a health index."""
    actual, ideal = agg.total(actual_cost()), agg.total(ideal_cost("actual"))
    return (
        counted_with_standards(boxed(tables.usage), tables)
        .groupBy("market")
        .agg(
            agg.orders().alias("total_orders"),
            agg.meals().alias("total_meals"),
            actual.alias("total_actual_cost_eur"),
            ideal.alias("total_ideal_cost_eur"),
            agg.share_pct(ideal, actual).alias("cost_efficiency_pct"),
            agg.total(waste_m2()).alias("total_paper_waste_m2"),
            agg.mean(waste_m2()).alias("avg_waste_per_order_m2"),
            agg.rows_where(is_overboxed()).alias("overboxed_orders"),
            agg.overboxed_pct(is_overboxed()).alias("overboxing_rate_pct"),
            agg.damaged().alias("damaged_orders"),
            agg.damage_pct().alias("damage_rate_pct"),
        )
        .withColumn(
            "overall_health_index_pct",
            (
                F.col("cost_efficiency_pct")
                + (100.0 - F.col("damage_rate_pct"))
                + (100.0 - F.col("overboxing_rate_pct"))
            )
            / 3.0,
        )
        .orderBy(down("overall_health_index_pct"), up("market"))
    )


def boxes_by_market(tables: Tables) -> DataFrame:
    actual, ideal = agg.total(actual_cost()), agg.total(ideal_cost("actual"))
    return (
        counted_with_standards(boxed(tables.usage), tables)
        .groupBy("market", "pkg_id")
        .agg(
            agg.orders().alias("orders"),
            actual.alias("total_cost_eur"),
            agg.mean(actual_cost()).alias("avg_cost_eur"),
            agg.total(waste_m2()).alias("total_waste_m2"),
            agg.damaged().alias("damaged"),
            agg.share_pct(ideal, actual).alias("efficiency_pct"),
        )
        .orderBy(up("market"), up("efficiency_pct"), up("pkg_id"))
    )
