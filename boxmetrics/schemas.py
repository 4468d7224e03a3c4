"""Column types of every table, fixed in one place.

Areas and rates are decimals so that sums do not depend on the order in which rows
arrive. Input values keep four decimal places. The two derived columns have room for
every digit their conversion can add: dividing by 10,000 adds four places, multiplying by
an exchange rate with two places adds two.
"""

from __future__ import annotations

from pyspark.sql import types as T

INPUT_NUMBER = T.DecimalType(12, 4)
AREA_M2 = T.DecimalType(16, 8)
RATE_EUR = T.DecimalType(14, 6)

# Types of the intermediate values that are summed. A cost is held to ten places: exact
# for four-place areas and six-place rates. Quotients are added up in whole numbers.
# Either times a number of rows just fits the 38 digits a decimal can have.
COST = T.DecimalType(19, 10)
WHOLE = T.DecimalType(19, 0)
ROWS = T.DecimalType(18, 0)


def _table(*columns: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in columns])


STAGING_PACKAGING = _table(
    ("pkg_id", T.StringType()),
    ("pkg_name", T.StringType()),
    ("material_type", T.StringType()),
    ("surface_area", INPUT_NUMBER),
    ("unit_of_measure", T.StringType()),
    ("status", T.StringType()),
)

STAGING_STANDARDS = _table(
    ("meals_count", T.IntegerType()),
    ("recommended_pkg_id", T.StringType()),
)

STAGING_RATES = _table(
    ("market", T.StringType()),
    ("material_type", T.StringType()),
    ("cost_per_m2", INPUT_NUMBER),
    ("currency", T.StringType()),
    ("valid_from", T.DateType()),
    ("valid_to", T.DateType()),
)

STAGING_USAGE = _table(
    ("order_id", T.LongType()),
    ("market", T.StringType()),
    ("pkg_id", T.StringType()),
    ("meals_count", T.IntegerType()),
    ("order_date", T.DateType()),
    ("is_damaged", T.IntegerType()),
)

TRANSFORM_PACKAGING = _table(
    ("pkg_id", T.StringType()),
    ("pkg_name", T.StringType()),
    ("material_type", T.StringType()),
    ("surface_area", INPUT_NUMBER),
    ("unit_of_measure", T.StringType()),
    ("surface_area_m2_normalised", AREA_M2),
    ("status", T.StringType()),
)

TRANSFORM_RATES = _table(
    ("market", T.StringType()),
    ("material_type", T.StringType()),
    ("cost_per_m2", INPUT_NUMBER),
    ("currency", T.StringType()),
    ("cost_per_m2_eur", RATE_EUR),
    ("valid_from", T.DateType()),
    ("valid_to", T.DateType()),
)

# Table names of the two layers and the schema each has there.
STAGING_SCHEMAS = {
    "dim_packaging_master": STAGING_PACKAGING,
    "dim_packaging_standards": STAGING_STANDARDS,
    "dim_procurement_cost": STAGING_RATES,
    "fact_box_usage": STAGING_USAGE,
}

TRANSFORM_SCHEMAS = {
    "dim_packaging_master": TRANSFORM_PACKAGING,
    "dim_packaging_standards": STAGING_STANDARDS,
    "dim_procurement_cost": TRANSFORM_RATES,
    "fact_box_usage": STAGING_USAGE,
}
