"""Cost per meal."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxmetrics.functions import aggregates as agg
from boxmetrics.functions.convert import decimals_as_doubles
from boxmetrics.functions.cost import (
    actual_cost,
    actual_cost_per_meal,
    ideal_cost,
    ideal_cost_per_meal,
    premium_per_meal,
)
from boxmetrics.functions.fit import efficiency_pct
from boxmetrics.operators.filters import boxed, selected
from boxmetrics.operators.ordering import down, sorted_rows, up
from boxmetrics.operators.scenarios import over_grid
from boxmetrics.plans.shared import counted_with_standards, priced_rows
from boxmetrics.tables import Tables

# Fixed values.
MONTHLY_ORDERS = (100, 500, 1000, 5000, 10000)


def cost_per_meal(tables: Tables) -> DataFrame:
    rows = priced_rows(boxed(tables.usage), tables).withColumn(
        "actual_cpm_eur", actual_cost_per_meal()
    )
    return decimals_as_doubles(
        sorted_rows(rows, down("actual_cpm_eur")).select(
            "order_id",
            "market",
            "pkg_id",
            "pkg_name",
            "recommended_pkg_id",
            "meals_count",
            "order_date",
            "actual_area_m2",
            "recommended_area_m2",
            "cost_per_m2_eur",
            actual_cost().alias("actual_cost_eur"),
            ideal_cost().alias("ideal_cost_eur"),
            "actual_cpm_eur",
            ideal_cost_per_meal().alias("ideal_cpm_eur"),
            premium_per_meal().alias("cpm_premium_eur"),
            efficiency_pct().alias("efficiency_pct"),
            "is_damaged",
        )
    )


def overall_cost_per_meal(tables: Tables) -> DataFrame:
    """Over the orders that have a standard."""
    counts = counted_with_standards(boxed(tables.usage), tables)
    return counts.filter(F.col("recommended_area_m2").isNotNull()).agg(
        (agg.total(actual_cost()) / agg.meals()).alias("overall_actual_cpm_eur"),
        (agg.total(ideal_cost()) / agg.meals()).alias("overall_ideal_cpm_eur"),
    )


def cost_per_meal_by_market(tables: Tables) -> DataFrame:
    """The ideal cost per meal counts the meals of all orders, with a standard or without."""
    paid, ideal, meals = agg.total(actual_cost()), agg.total(ideal_cost()), agg.meals()
    return (
        counted_with_standards(boxed(tables.usage), tables)
        .groupBy("market")
        .agg(
            agg.orders().alias("orders"),
            meals.alias("total_meals"),
            paid.alias("total_actual_cost_eur"),
            (paid / meals).alias("actual_cpm_eur"),
            (ideal / F.nullif(meals, F.lit(0).cast("bigint"))).alias("ideal_cpm_eur"),
            agg.mean_ratio(efficiency_pct()).alias("avg_efficiency_pct"),
        )
        .orderBy(down("actual_cpm_eur"), up("market"))
    )


def waste_at_volume(
    tables: Tables,
    market: str = "DE",
    pkg_id: str = "P-L",
    meals_count: int = 2,
    monthly_orders: Sequence[int] = MONTHLY_ORDERS,
) -> DataFrame:
    """What a pattern of box and meals costs per month, at the mean cost of its orders."""
    usage = selected(tables.usage, market=market, pkg_id=pkg_id, meals_count=meals_count)
    pattern = counted_with_standards(usage, tables).agg(
        agg.mean(actual_cost()).alias("actual"), agg.mean(ideal_cost()).alias("ideal")
    )
    orders = F.col("scenario_orders_per_month")
    grid = [{"scenario_orders_per_month": volume} for volume in monthly_orders]
    return (
        over_grid(pattern, grid)
        .select(
            orders,
            (orders * F.col("actual")).alias("actual_monthly_cost_eur"),
            (orders * F.col("ideal")).alias("ideal_monthly_cost_eur"),
            (orders * (F.col("actual") - F.col("ideal"))).alias("monthly_waste_eur"),
        )
        .orderBy("scenario_orders_per_month")
    )
