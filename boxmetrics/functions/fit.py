"""How well a box fits: ratios, waste and labels.

The expressions read `actual_area_m2` and `recommended_area_m2`.
"""

from __future__ import annotations

from collections.abc import Mapping
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from boxmetrics.functions.convert import as_double

# Box sizes from small to large, the ratios that end a fit category, and the
# names of the categories.
BOX_LEVELS = {"P-S": 1, "P-M": 2, "P-L": 3, "P-XL": 4}
SLIGHT_RATIO = Decimal("1.2")
MODERATE_RATIO = Decimal("1.5")
PERFECT = "Perfect Fit"
UNDER = "Under-boxed"
OVER = "Over-boxed"
SLIGHT = "Slight Over-box"
MODERATE = "Moderate Over-box"
SEVERE = "Severe Over-box"
UNKNOWN = "Unknown (no standard)"


def _actual() -> Column:
    return F.col("actual_area_m2")


def _recommended() -> Column:
    return F.col("recommended_area_m2")


def fit_ratio() -> Column:
    return as_double(_actual()) / as_double(_recommended())


def efficiency_pct() -> Column:
    """Recommended as a percentage of actual area, null without a recommendation."""
    return as_double(_recommended()) / as_double(_actual()) * 100.0


def waste_m2() -> Column:
    """Area beyond the recommended one; 0 if the box is smaller or has no standard."""
    excess = _actual() - F.coalesce(_recommended(), _actual())
    return F.greatest(excess, F.lit(Decimal(0)))


def is_overboxed() -> Column:
    return waste_m2() > F.lit(0)


def graded_fit(slight: Decimal = SLIGHT_RATIO, moderate: Decimal = MODERATE_RATIO) -> Column:
    """Five grades by area ratio. Limits are multiplied out, so they are exact."""
    actual, recommended = _actual(), _recommended()
    return (
        F.when(actual == recommended, PERFECT)
        .when(actual < recommended, UNDER)
        .when(actual <= recommended * F.lit(slight), SLIGHT)
        .when(actual <= recommended * F.lit(moderate), MODERATE)
        .otherwise(SEVERE)
    )


def plain_fit(*, normalised: bool = False) -> Column:
    """Four labels, with one for orders without a standard.

    Equality is tested on the area in its own unit, so a box measured in cm2 is never a
    perfect fit. That is the established result; `normalised` compares square metres.
    """
    compared = _actual() if normalised else F.col("surface_area")
    return (
        F.when(F.col("recommended_pkg_id").isNull(), UNKNOWN)
        .when(compared == F.coalesce(_recommended(), _actual()), PERFECT)
        .when(_actual() > _recommended(), OVER)
        .otherwise(UNDER)
    )


def box_level(pkg_id: Column, levels: Mapping[str, int] = BOX_LEVELS) -> Column:
    """Position of a box in the size order, null for a box outside of it.

    A variant, named after its box and a slash, is as large as the box. The name is cut out of
    the id once, for all levels.
    """
    if not levels:
        return F.lit(None).cast("int")
    positions = F.create_map(*[F.lit(part) for level in levels.items() for part in level])
    return F.element_at(positions, F.substring_index(pkg_id, "/", 1))
