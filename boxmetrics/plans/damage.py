"""Damage rates. No rates are involved, so markets without a contract count too."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxmetrics.functions import aggregates as agg
from boxmetrics.functions.convert import as_double
from boxmetrics.functions.fit import plain_fit
from boxmetrics.operators.filters import boxed
from boxmetrics.operators.grain import usage_counts
from boxmetrics.operators.lookups import with_box, with_recommendation
from boxmetrics.operators.ordering import sorted_rows, up
from boxmetrics.tables import Tables


def _with_fit(frame: DataFrame, tables: Tables, normalised: bool) -> DataFrame:
    sized = with_recommendation(with_box(frame, tables), tables, keep_unmatched=True)
    return sized.withColumn("fit_category", plain_fit(normalised=normalised))


# Groupings of the report, with the texts around their one or two keys.
_GROUPINGS = (
    ("Overall", "", "", (None, None)),
    ("Market: ", "", "", ("market", None)),
    ("Box: ", " (", ")", ("pkg_id", "pkg_name")),
    ("Fit: ", "", "", ("fit_category", None)),
)


def damage_rate(tables: Tables, *, normalised: bool = False) -> DataFrame:
    """Damage overall, by market, by box and by fit.

    Each counted combination is sent to its four groups in one aggregation. A row of
    zeros keeps the overall line for an empty input.
    """
    counts = usage_counts(boxed(tables.usage), tables, "market", "pkg_id", "meals_count")
    groups = F.array(
        *[
            F.struct(
                F.lit(number).alias("grouping"),
                *[
                    (F.col(key) if key else F.lit(None).cast("string")).alias(f"key_{place}")
                    for place, key in enumerate(keys)
                ],
            )
            for number, (_, _, _, keys) in enumerate(_GROUPINGS)
        ]
    )
    grouped = _with_fit(counts, tables, normalised).select(
        F.inline(groups), "order_count", "damaged_orders"
    )
    nothing = tables.usage.sparkSession.range(1).select(
        F.lit(0).alias("grouping"),
        F.lit(None).cast("string").alias("key_0"),
        F.lit(None).cast("string").alias("key_1"),
        F.lit(0).cast("bigint").alias("order_count"),
        F.lit(None).cast("bigint").alias("damaged_orders"),
    )
    label = F.lit(None).cast("string")
    for number, (before, between, after, _) in enumerate(_GROUPINGS):
        # Joining text this way leaves nulls out instead of making the whole label null.
        text = F.concat_ws(
            "", F.lit(before), F.col("key_0"), F.lit(between), F.col("key_1"), F.lit(after)
        )
        label = F.when(F.col("grouping") == number, text).otherwise(label)
    return (
        grouped.unionByName(nothing)
        .groupBy("grouping", "key_0", "key_1")
        .agg(
            agg.orders().alias("total_orders"),
            agg.damaged().alias("damaged_orders"),
            agg.damage_pct().alias("damage_rate_pct"),
        )
        .select(label.alias("dimension"), "total_orders", "damaged_orders", "damage_rate_pct")
        .orderBy(up("dimension"))
    )


def damage_detail(tables: Tables, *, normalised: bool = False) -> DataFrame:
    rows = _with_fit(boxed(tables.usage).filter(F.col("is_damaged") == 1), tables, normalised)
    return sorted_rows(rows, up("order_date")).select(
        "order_id",
        "market",
        "pkg_id",
        "pkg_name",
        "material_type",
        "meals_count",
        "order_date",
        "fit_category",
        as_double("actual_area_m2").alias("actual_area_m2"),
        as_double("recommended_area_m2").alias("recommended_area_m2"),
        "is_damaged",
    )
