"""Cost, waste and damage per material and per box type."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxmetrics.functions import aggregates as agg
from boxmetrics.functions.convert import as_double
from boxmetrics.functions.cost import actual_cost, ideal_cost
from boxmetrics.functions.fit import efficiency_pct, waste_m2
from boxmetrics.operators.filters import boxed, selected
from boxmetrics.operators.lookups import with_box, with_rate
from boxmetrics.operators.ordering import down, sorted_rows, up
from boxmetrics.plans.shared import counted_with_standards
from boxmetrics.tables import Tables


def material_summary(tables: Tables) -> DataFrame:
    """Per material of the box. Inefficiency is the actual cost here, as established."""
    cost = actual_cost()
    return (
        counted_with_standards(boxed(tables.usage), tables)
        .groupBy("material_type")
        .agg(
            agg.orders().alias("total_orders"),
            agg.total(cost).alias("total_actual_cost_eur"),
            agg.mean(cost).alias("avg_order_cost_eur"),
            agg.total(waste_m2()).alias("total_paper_waste_m2"),
            agg.mean(waste_m2()).alias("avg_waste_per_order_m2"),
            agg.damaged().alias("damaged_orders"),
            agg.damage_pct().alias("damage_rate_pct"),
            agg.mean_ratio(efficiency_pct()).alias("avg_efficiency_pct"),
            agg.total(cost).alias("total_cost_inefficiency_eur"),
        )
        .orderBy(down("total_actual_cost_eur"), up("material_type"))
    )


def material_by_market(tables: Tables) -> DataFrame:
    return (
        counted_with_standards(boxed(tables.usage), tables)
        .groupBy("material_type", "market")
        .agg(
            agg.orders().alias("orders"),
            agg.total(actual_cost()).alias("total_cost_eur"),
            agg.total(waste_m2()).alias("total_waste_m2"),
            agg.damaged().alias("damaged"),
            agg.mean_ratio(efficiency_pct()).alias("avg_efficiency_pct"),
        )
        .orderBy(up("material_type"), up("market"))
    )


def same_box_price(tables: Tables, market: str = "DE", pkg_id: str = "P-S") -> DataFrame:
    """Rate and cost of every order of one box. `year` is the order date, `rate_local` the
    rate in euros, as established."""
    rows = with_rate(
        with_box(selected(tables.usage, market=market, pkg_id=pkg_id), tables), tables
    )
    return sorted_rows(rows, up("order_date")).select(
        F.col("order_date").alias("year"),
        "market",
        "pkg_id",
        "material_type",
        as_double("cost_per_m2_eur").alias("rate_local"),
        "currency",
        as_double("cost_per_m2_eur").alias("rate_eur_per_m2"),
        as_double(actual_cost()).alias("cost_per_order_eur"),
    )


def box_type_economics(tables: Tables) -> DataFrame:
    cost, ideal = agg.total(actual_cost()), agg.total(ideal_cost("actual"))
    return (
        counted_with_standards(boxed(tables.usage), tables)
        .groupBy("pkg_id", "pkg_name", "material_type", "pkg_status")
        .agg(
            agg.orders().alias("total_orders"),
            cost.alias("total_cost_eur"),
            agg.mean(actual_cost()).alias("avg_cost_per_order_eur"),
            agg.total(waste_m2()).alias("total_paper_waste_m2"),
            agg.mean(waste_m2()).alias("avg_waste_per_order_m2"),
            agg.damaged().alias("damaged_orders"),
            agg.damage_pct().alias("damage_rate_pct"),
            agg.mean_ratio(efficiency_pct()).alias("avg_efficiency_pct"),
            agg.share_pct(ideal, cost).alias("cost_efficiency_pct"),
        )
        .orderBy(down("avg_efficiency_pct"), up("pkg_id"), up("pkg_name"))
    )
