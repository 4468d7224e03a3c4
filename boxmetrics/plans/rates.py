"""Rates over time and between markets, and what other rates or boxes would save."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxmetrics.functions import aggregates as agg
from boxmetrics.functions.convert import as_double
from boxmetrics.functions.cost import actual_cost
from boxmetrics.operators.filters import Q1_2026, Window, boxed, in_force, selected
from boxmetrics.operators.grain import usage_counts
from boxmetrics.operators.lookups import with_box, with_rate
from boxmetrics.operators.ordering import down, sorted_rows, up
from boxmetrics.operators.scenarios import over_grid
from boxmetrics.plans.shared import counted
from boxmetrics.tables import Tables

# Fixed values.
RATE_DAY = date(2026, 1, 1)
CURRENT_RATE = Decimal("1.75")
TARGET_RATES = tuple(Decimal(rate) for rate in ("1.65", "1.55", "1.45", "1.35", "1.25"))
MONTHLY_BOXES = (500, 1000, 5000, 10000)
MIGRATION_PCTS = (10, 20, 30)


def _in_year(usage: DataFrame) -> DataFrame:
    return usage.withColumn("yr", F.year("order_date"))


def yearly_cost(tables: Tables) -> DataFrame:
    cost = actual_cost()
    return (
        counted(_in_year(boxed(tables.usage)), tables, "yr")
        .groupBy("market", "yr")
        .agg(
            agg.orders().alias("orders"),
            agg.mean(F.col("cost_per_m2_eur")).alias("avg_rate_eur_per_m2"),
            agg.mean(cost).alias("avg_order_cost_eur"),
            agg.total(cost).alias("total_cost_eur"),
        )
        .orderBy(up("market"), up("yr"))
    )


def same_box_by_year(tables: Tables, market: str = "DE", pkg_id: str = "P-S") -> DataFrame:
    usage = _in_year(selected(tables.usage, market=market, pkg_id=pkg_id))
    rows = with_rate(with_box(usage, tables), tables)
    cost = as_double(actual_cost())
    return sorted_rows(rows, up("yr"), up("order_date")).select(
        "yr",
        "market",
        "pkg_id",
        "material_type",
        as_double("cost_per_m2_eur").alias("rate_eur_per_m2"),
        as_double("actual_area_m2").alias("surface_area_m2_normalised"),
        cost.alias("order_cost_eur"),
        (cost / F.col("meals_count")).alias("cost_per_meal_eur"),
    )


def rate_change(tables: Tables, before: int = 2025, after: int = 2026) -> DataFrame:
    """Lowest rate paid in two years, for markets with orders in both."""
    paid = counted(_in_year(boxed(tables.usage)), tables, "yr")

    def lowest(year: int) -> Column:
        return F.min(F.when(F.col("yr") == year, F.col("cost_per_m2_eur")))

    old, new = F.col("old_rate"), F.col("new_rate")
    change = as_double(new - old) / as_double(F.nullif(old, F.lit(Decimal(0)))) * 100.0
    return (
        paid.groupBy("market")
        .agg(lowest(before).alias("old_rate"), lowest(after).alias("new_rate"))
        .filter(old.isNotNull() & new.isNotNull())
        .select(
            "market",
            as_double(old).alias(f"rate_{before}_eur"),
            as_double(new).alias(f"rate_{after}_eur"),
            change.alias("yoy_rate_change_pct"),
        )
    )


def rate_benchmark(tables: Tables) -> DataFrame:
    return tables.rates.select(
        "market",
        "material_type",
        as_double("cost_per_m2_eur").alias("rate_eur_per_m2"),
        "valid_from",
        "valid_to",
    ).orderBy(down("valid_from"), up("market"), up("material_type"), up("valid_to"))


def market_premium(tables: Tables, base: str = "DE", on: date = RATE_DAY) -> DataFrame:
    """How much more one market pays than each of the others on a day."""
    valid = in_force(tables.rates, on)
    base_rate = valid.filter(F.col("market") == base).agg(F.max("cost_per_m2_eur")).scalar()
    converted = F.when(F.col("currency") == "GBP", F.lit(" (GBP converted)"))
    gap = F.col("base_rate") - F.col("cost_per_m2_eur")
    return (
        valid.filter(F.col("market") != base)
        .withColumn("base_rate", base_rate)
        .select(
            F.concat_ws("", F.lit(f"{base} vs "), "market", converted).alias("comparison"),
            as_double(gap).alias("rate_difference_eur"),
            (as_double(gap) / as_double("cost_per_m2_eur") * 100.0).alias("de_premium_pct"),
        )
    )


def rate_negotiation(
    tables: Tables,
    market: str = "DE",
    window: Window = Q1_2026,
    current_rate: Decimal = CURRENT_RATE,
    target_rates: Sequence[Decimal] = TARGET_RATES,
) -> DataFrame:
    """Savings on the volume of a quarter, and on four of them, at lower rates."""
    counts = usage_counts(
        selected(tables.usage, market=market, window=window), tables, "pkg_id"
    )
    volume = with_box(counts, tables).agg(
        agg.total(F.col("actual_area_m2")).alias("total_area_m2")
    )
    grid = [{"target_rate": target, "saving": current_rate - target} for target in target_rates]
    saving = as_double("saving")
    on_quarter = F.col("total_area_m2") * saving
    return (
        over_grid(volume, grid)
        .select(
            as_double("target_rate").alias("target_rate_eur_per_m2"),
            saving.alias("saving_per_m2"),
            on_quarter.alias("saving_on_q1_volume_eur"),
            (on_quarter * 4.0).alias("annualised_saving_eur"),
        )
        .orderBy("target_rate_eur_per_m2")
    )


def box_migration(
    tables: Tables,
    market: str = "DE",
    large: str = "P-L",
    smaller: str = "P-M",
    on: date = RATE_DAY,
    monthly_boxes: Sequence[int] = MONTHLY_BOXES,
    migration_pcts: Sequence[int] = MIGRATION_PCTS,
) -> DataFrame:
    """Savings if a share of the large boxes were smaller ones.

    The rate is the one in the contract's own currency, as established.
    """
    areas = tables.packaging.filter(F.col("pkg_id").isin(large, smaller)).agg(
        *[
            F.max(F.when(F.col("pkg_id") == box, F.col("surface_area_m2_normalised"))).alias(name)
            for box, name in ((large, "large"), (smaller, "smaller"))
        ]
    )
    saved = areas.select((F.col("large") - F.col("smaller")).alias("saved")).scalar()
    per_box = (
        in_force(tables.rates, on)
        .filter(F.col("market") == market)
        .withColumn("saved_m2", saved)
        .select(
            as_double("saved_m2").alias("saved_m2"),
            as_double(F.col("saved_m2") * F.col("cost_per_m2")).alias("saving_per_box_eur"),
        )
    )
    grid = [
        {"monthly_pl_boxes": boxes, "migration_pct": share}
        for boxes in monthly_boxes
        for share in migration_pcts
    ]
    moved = F.col("monthly_pl_boxes") * F.col("migration_pct") / 100.0
    monthly = moved * F.col("saving_per_box_eur")
    return (
        over_grid(per_box, grid)
        .select(
            "monthly_pl_boxes",
            "migration_pct",
            moved.alias("boxes_migrated"),
            "saving_per_box_eur",
            monthly.alias("monthly_saving_eur"),
            (monthly * 12.0).alias("annual_saving_eur"),
            (moved * F.col("saved_m2")).alias("monthly_paper_saved_m2"),
        )
        .orderBy("monthly_pl_boxes", "migration_pct")
    )
