"""What boxes cost.

The expressions read `actual_area_m2`, `recommended_area_m2` and `cost_per_m2_eur`.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from boxmetrics.functions.convert import as_double
from boxmetrics.functions.fit import waste_m2


def _rate() -> Column:
    return F.col("cost_per_m2_eur")


def actual_cost() -> Column:
    return F.col("actual_area_m2") * _rate()


def ideal_cost(without_standard: str = "null") -> Column:
    """Cost of the recommended box.

    `without_standard` says what an order without a standard costs: "null", "zero", or
    "actual" for the cost of the box it got. Reports differ in this on purpose.
    """
    recommended = F.col("recommended_area_m2")
    stand_in = {
        "null": recommended,
        "zero": F.coalesce(recommended, F.lit(Decimal(0))),
        "actual": F.coalesce(recommended, F.col("actual_area_m2")),
    }
    return stand_in[without_standard] * _rate()


def waste_cost() -> Column:
    return waste_m2() * _rate()


def actual_cost_per_meal() -> Column:
    return as_double(actual_cost()) / F.col("meals_count")


def ideal_cost_per_meal() -> Column:
    return as_double(ideal_cost()) / F.col("meals_count")


def premium_per_meal() -> Column:
    """Cost per meal of the area beyond the recommended one; negative if under-boxed."""
    actual = F.col("actual_area_m2")
    excess = actual - F.coalesce(F.col("recommended_area_m2"), actual)
    return as_double(excess * _rate()) / F.col("meals_count")


def overspend_parts(new_rate: Decimal, old_rate: Decimal) -> dict[str, Column]:
    """Split of what is paid at the new rate into price and size effects.

    The total is not the sum of the two effects: it takes the price effect on the
    recommended area and lets smaller boxes count as savings.
    """
    actual, recommended = F.col("actual_area_m2"), F.col("recommended_area_m2")
    new, old, rise = F.lit(new_rate), F.lit(old_rate), F.lit(new_rate - old_rate)
    return {
        "actual_cost_eur": actual * new,
        "ideal_cost_eur": recommended * new,
        "counterfactual_cost_eur": actual * old,
        "price_hike_impact_eur": rise * actual,
        "overboxing_impact_eur": F.greatest(actual - recommended, F.lit(Decimal(0))) * new,
        "total_overspend_vs_ideal_eur": (actual - recommended) * new + rise * recommended,
    }
