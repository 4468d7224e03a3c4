"""Facts about a layer from the statistics its catalog keeps.

`ANALYZE TABLE` counted the rows of each table when it was written, and for each column its
nulls, least and greatest value and longest text. From these follow bounds of what a lookup
takes in memory, which decide about broadcasts, without a job.
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from datetime import date

from pyspark.sql import SparkSession

from boxmetrics.operators.sizing import row_bytes

#: Bytes of a character at most.
_CHARACTER = 4


def _described(spark: SparkSession, what: str) -> dict[str, str]:
    rows = spark.sql(f"DESCRIBE EXTENDED {what}").collect()
    return {row[0]: row[1] for row in rows}


def row_count(spark: SparkSession, table: str) -> int | None:
    """Rows of a table, if they were counted."""
    found = re.search(r"([0-9]+) rows", _described(spark, table).get("Statistics", ""))
    return int(found[1]) if found else None


def column_facts(spark: SparkSession, table: str, column: str) -> dict[str, str | None]:
    facts = _described(spark, f"{table} `{column}`")
    return {name: None if value == "NULL" else value for name, value in facts.items()}


def _longest(spark: SparkSession, table: str, *columns: str) -> int:
    """Greatest number of bytes of the texts of a row."""
    return sum(_CHARACTER * int(column_facts(spark, table, column)["max_col_len"] or 0) for column in columns)


def catalog_facts(spark: SparkSession, tables: Mapping[str, str], layer: str) -> dict[str, object] | None:
    """What `Tables.measured` finds from rows, with bounds instead of sizes.

    `tables` has the full name of each table. Null if some statistics are missing. The joined
    lookups are bounded by all pairs of their rows, and the calendar by all days of all rates.
    """
    counts = {name: row_count(spark, table) for name, table in tables.items()}
    if None in counts.values():
        return None
    packaging, standards, rates, usage = (
        tables[name]
        for name in ("dim_packaging_master", "dim_packaging_standards", "dim_procurement_cost", "fact_box_usage")
    )
    dates = column_facts(spark, usage, "order_date")
    order_ids = column_facts(spark, usage, "order_id")
    if "min" not in dates or order_ids.get("num_nulls") is None:
        return None
    first, last = (None if dates[end] is None else date.fromisoformat(dates[end]) for end in ("min", "max"))
    days = (last - first).days + 1 if first else 0
    boxes, pairs = counts["dim_packaging_master"], counts["dim_packaging_standards"]
    named = _longest(spark, standards, "recommended_pkg_id")
    recommended = row_bytes(4) + named + _longest(spark, packaging, "pkg_name")
    rate = row_bytes(6) + _longest(spark, rates, "market", "currency")
    every = pairs * max(boxes, 1) * recommended
    return {
        "layer": layer,
        "first_day": first,
        "last_day": last,
        "order_ids_complete": int(order_ids["num_nulls"]) == 0,
        "box": boxes * (row_bytes(6) + _longest(spark, packaging, "pkg_id", "pkg_name", "material_type", "status")),
        "standard": pairs * (row_bytes(2) + named),
        "recommendation": every,
        "known_recommendation": every,
        "rates": counts["dim_procurement_cost"] * rate,
        "calendar": counts["dim_procurement_cost"] * days * rate,
    }
