"""Company-wide figures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxmetrics.functions import aggregates as agg
from boxmetrics.functions.cost import actual_cost, ideal_cost
from boxmetrics.functions.fit import is_overboxed, waste_m2
from boxmetrics.operators.filters import boxed
from boxmetrics.plans.shared import counted_with_standards
from boxmetrics.tables import Tables


def master_metrics(tables: Tables) -> DataFrame:
    actual, ideal = agg.total(actual_cost()), agg.total(ideal_cost("actual"))
    meals = F.nullif(agg.meals(), F.lit(0).cast("bigint"))
    figures = counted_with_standards(boxed(tables.usage), tables).agg(
        agg.orders().alias("total_clean_orders"),
        agg.meals().alias("total_meals"),
        actual.alias("total_actual_cost_eur"),
        ideal.alias("total_ideal_cost_eur"),
        (actual - ideal).alias("total_cost_inefficiency_eur"),
        agg.share_pct(actual - ideal, actual).alias("pct_spend_wasted"),
        agg.share_pct(ideal, actual).alias("overall_cost_efficiency_pct"),
        (actual / meals).alias("overall_actual_cpm_eur"),
        (ideal / meals).alias("overall_ideal_cpm_eur"),
        agg.total(waste_m2()).alias("total_paper_waste_m2"),
        agg.mean(waste_m2()).alias("avg_waste_per_order_m2"),
        agg.rows_where(is_overboxed()).alias("overboxed_orders"),
        agg.overboxed_pct(is_overboxed()).alias("overboxing_rate_pct"),
        agg.damaged().alias("damaged_orders"),
        agg.damage_pct().alias("overall_damage_rate_pct"),
    )
    return figures.withColumn("quality", _quality(tables).scalar()).select(
        *figures.columns, "quality.null_pkg_id_orders", "quality.duplicate_order_rows"
    )


def _quality(tables: Tables) -> DataFrame:
    """Rows without a box, and boxed rows beyond the first of their order id.

    Rows are counted per order id first: a frequent id is merged before the shuffle.
    """
    is_boxed = F.col("pkg_id").isNotNull()
    per_order = tables.usage.groupBy("order_id").agg(
        F.count_if(~is_boxed).alias("without_box"), F.count_if(is_boxed).alias("with_box")
    )
    named = F.col("order_id").isNotNull() & (F.col("with_box") > 0)
    zero = F.lit(0).cast("bigint")
    return per_order.agg(
        F.struct(
            F.coalesce(F.sum("without_box"), zero).alias("null_pkg_id_orders"),
            (F.coalesce(F.sum("with_box"), zero) - F.count_if(named)).alias(
                "duplicate_order_rows"
            ),
        )
    )
