"""Orders without a box standard: one case, ways to pack it, and how many there are."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxmetrics.functions.convert import as_double
from boxmetrics.functions.cost import actual_cost
from boxmetrics.operators.filters import in_force
from boxmetrics.operators.grain import usage_counts
from boxmetrics.operators.lookups import with_box, with_rate, with_standard
from boxmetrics.operators.ordering import sorted_rows, up
from boxmetrics.operators.scenarios import over_grid
from boxmetrics.plans.rates import RATE_DAY
from boxmetrics.tables import Tables


@dataclass(frozen=True)
class Packing:
    """A way to pack an order: how many of which boxes."""

    scenario: str
    box_config: str
    food_risk: str
    boxes: Mapping[str, int]


# Fixed values.
ANOMALOUS_ORDER = 9005
GAP_NOTE = "No standard defined for 12 meals"
NO_STANDARD = "NO STANDARD — box assignment undefined"
HAS_STANDARD = "Standard defined"
PACKINGS = (
    Packing("Actual #9005", "1× P-S", "Critical — severe under-boxing", {"P-S": 1}),
    Packing("1× P-L (6 meals max)", "1× P-L", " Moderate — still insufficient", {"P-L": 1}),
    Packing("Correct: 2× P-L", "2× P-L", " Acceptable — two 6-meal boxes", {"P-L": 2}),
    Packing(
        "Alt: P-XL + P-M", "1× P-XL + 1× P-M", " Uses discontinued P-XL stock", {"P-XL": 1, "P-M": 1}
    ),
)


def order_anomaly(
    tables: Tables, order_id: int | None = ANOMALOUS_ORDER, meals_count: int | None = None
) -> DataFrame:
    """Cost of one order, or of all orders with a number of meals.

    `apparent_cpm_eur` is the cost of the whole order, rounded half to even.
    """
    usage = tables.usage
    if order_id is not None:
        usage = usage.filter(F.col("order_id") == order_id)
    if meals_count is not None:
        usage = usage.filter(F.col("meals_count") == meals_count)
    rows = with_rate(with_box(usage, tables), tables)
    cost = as_double(actual_cost())
    return sorted_rows(rows).select(
        "order_id",
        "market",
        "pkg_id",
        "pkg_name",
        "pkg_status",
        "meals_count",
        "order_date",
        "is_damaged",
        as_double("actual_area_m2").alias("actual_area_m2"),
        as_double("cost_per_m2_eur").alias("cost_per_m2_eur"),
        cost.alias("actual_cost_eur"),
        F.rint(cost).alias("apparent_cpm_eur"),
        F.lit(GAP_NOTE).alias("standards_gap"),
    )


def box_scenarios(
    tables: Tables,
    market: str = "UK",
    on: date = RATE_DAY,
    meals: int = 12,
    packings: Sequence[Packing] = PACKINGS,
) -> DataFrame:
    """Cost of packing the meals in other ways, at a market's rate on a day.

    Areas come from the box master; a packing with a box it does not know drops out.
    """
    grid = [
        {
            "scenario": packing.scenario,
            "box_config": packing.box_config,
            "food_risk": packing.food_risk,
            "box_kinds": len(packing.boxes),
            "pkg_id": pkg_id,
            "pieces": pieces,
        }
        for packing in packings
        for pkg_id, pieces in packing.boxes.items()
    ]
    one_row = tables.packaging.sparkSession.range(1).select()
    areas = tables.packaging.select("pkg_id", "surface_area_m2_normalised")
    rate = (
        in_force(tables.rates, on)
        .filter(F.col("market") == market)
        .agg(F.max("cost_per_m2_eur"))
        .scalar()
    )
    # The grid is a short list given by the caller, so it is the side to broadcast.
    sized = areas.join(F.broadcast(over_grid(one_row, grid)), "pkg_id")
    cost = F.col("area_m2") * F.col("rate")
    return (
        sized.groupBy("scenario", "box_config", "food_risk", "box_kinds")
        .agg(
            F.sum(F.col("surface_area_m2_normalised") * F.col("pieces")).alias("area_m2"),
            F.count_distinct("pkg_id").alias("known_kinds"),
        )
        .filter(F.col("known_kinds") == F.col("box_kinds"))
        .withColumn("rate", rate)
        .select(
            "scenario",
            "box_config",
            as_double("area_m2").alias("surface_area_m2"),
            as_double(F.round(cost, 4)).alias("cost_eur"),
            as_double(F.round(cost / F.lit(meals), 4)).alias("cost_per_meal_eur"),
            "food_risk",
        )
        .orderBy(up("cost_eur"), up("scenario"))
    )


def standards_gap(tables: Tables) -> DataFrame:
    """Orders per number of meals, with or without a box, and whether a standard exists."""
    counts = with_standard(usage_counts(tables.usage, tables, "meals_count"), tables)
    status = F.when(F.col("recommended_pkg_id").isNull(), NO_STANDARD).otherwise(HAS_STANDARD)
    return (
        counts.groupBy("meals_count", "recommended_pkg_id")
        .agg(F.sum("order_count").alias("affected_orders"))
        .select("meals_count", "recommended_pkg_id", status.alias("standards_status"), "affected_orders")
        .orderBy(up("meals_count"), up("recommended_pkg_id"))
    )
