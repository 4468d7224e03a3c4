"""Reports and transforms by name, as functions of the tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame

from boxmetrics.plans import (
    audit,
    boxes,
    damage,
    markets,
    master,
    meals,
    overboxing,
    rates,
    standards_gap,
)
from boxmetrics.tables import Tables

FLAGSHIP = "q02_total_cost_per_market"

REPORTS: dict[str, Callable[[Tables], DataFrame]] = {
    "q01a_duplicate_orders": audit.duplicate_orders,
    "q01b_null_pkg": audit.null_boxes,
    "q01c_discontinued_in_use": audit.discontinued_in_use,
    "q01d_meals_without_standard": audit.meals_without_standard,
    "q01e_audit_summary": audit.audit_summary,
    "q02_total_cost_per_market": markets.total_cost_per_market,
    "q03a_overboxing_detail": overboxing.overboxing_detail,
    "q03b_overboxing_by_market": overboxing.overboxing_by_market,
    "q04a_cost_decomposition": overboxing.cost_decomposition,
    "q04b_attribution_totals": overboxing.attribution_totals,
    "q05a_cost_per_meal": meals.cost_per_meal,
    "q05b_overall_cpm": meals.overall_cost_per_meal,
    "q05c_cpm_by_market": meals.cost_per_meal_by_market,
    "q05d_cpm_waste_scenario": meals.waste_at_volume,
    "q06a_material_summary": boxes.material_summary,
    "q06b_material_by_market": boxes.material_by_market,
    "q06c_same_box_price": boxes.same_box_price,
    "q07a_market_scorecard": markets.market_scorecard,
    "q07b_box_by_market": markets.boxes_by_market,
    "q08a_damage_rate": damage.damage_rate,
    "q08e_damage_detail": damage.damage_detail,
    "q09a_yoy_cost": rates.yearly_cost,
    "q09b_same_box_yoy": rates.same_box_by_year,
    "q09c_rate_change": rates.rate_change,
    "q10a_rate_benchmark": rates.rate_benchmark,
    "q10b_market_premium": rates.market_premium,
    "q10c_rate_negotiation": rates.rate_negotiation,
    "q10d_box_migration": rates.box_migration,
    "q11_box_type_economics": boxes.box_type_economics,
    # All orders of the kind the report is about; the single order is its default.
    "q12a_order_anomaly": partial(standards_gap.order_anomaly, order_id=None, meals_count=12),
    "q12b_box_scenarios": standards_gap.box_scenarios,
    "q12c_standards_gap": standards_gap.standards_gap,
    "q13_master_metrics": master.master_metrics,
    "qf1_financial_variance": markets.financial_variance,
    "qf2_overboxing_gap": markets.overboxing_gap,
}
