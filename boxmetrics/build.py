"""The whole way from CSV files to cleaned tables in the catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxmetrics.schemas import STAGING_SCHEMAS, TRANSFORM_SCHEMAS
from boxmetrics.sources.csv_files import read_staging
from boxmetrics.sources.generations import (
    current_generation,
    hold_generation,
    table_of,
    write_generation,
)
from boxmetrics.sources.layers import (
    STAGING,
    TRANSFORM,
    load_tables,
    merged_by_month,
    require_shared_warehouse,
    save_by_order,
    save_table,
    save_tables,
)
from boxmetrics.sources.statistics import catalog_facts, row_count
from boxmetrics.tables import ByOrder, Staging, Tables
from boxmetrics.transforms import build_transform

_USAGE, _HOT, _BY_ORDER, _OF_HOT = "fact_box_usage", "hot_orders", "usage_by_order", "usage_of_hot_orders"

#: An order with more than one in so many rows is hot: there are fewer hot orders than this.
HOT_SHARE = 1000
#: An order of fewer rows is never hot.
LEAST_HOT = 100_000


def build_layers(spark: SparkSession, folder: str) -> Tables:
    """Load the CSV files of a folder into `staging`, and rebuild `transform` from there.

    The rebuild is a new generation of tables that replaces the one before in one step.
    """
    save_tables(spark, read_staging(spark, folder).frames(), STAGING)
    rebuild_transform(spark, Staging.from_frames(load_tables(spark, STAGING_SCHEMAS, STAGING)))
    return open_layers(spark)


def rebuild_transform(spark: SparkSession, staging: Staging, least_hot: int = LEAST_HOT) -> str:
    """Write the cleaned tables as a new generation, and usage once more by order."""
    require_shared_warehouse(spark)
    built = build_transform(staging).frames()
    built[_USAGE] = merged_by_month(staging.usage, staging.usage.count())
    columns = TRANSFORM_SCHEMAS[_USAGE].fieldNames()
    makers = {name: (lambda read, rows=rows: rows) for name, rows in built.items()}

    def of_orders(how: str):
        def make(read):
            usage = read(_USAGE).select(*columns).filter(F.col("order_id").isNotNull())
            return usage.join(F.broadcast(read(_HOT)), "order_id", how)

        return make

    makers[_HOT] = lambda read: hot_orders(read(_USAGE), least_hot)
    makers[_BY_ORDER] = of_orders("left_anti")
    makers[_OF_HOT] = of_orders("left_semi")
    counted: dict[str, int] = {}

    def save(frame: DataFrame, name: str, table: str) -> None:
        if name == _BY_ORDER:
            save_by_order(frame, counted[_USAGE], table)
        else:
            save_table(frame, name, table)
            counted[name] = row_count(spark, table)

    return write_generation(
        spark, TRANSFORM, makers, save, {name: schema.fieldNames() for name, schema in TRANSFORM_SCHEMAS.items()}
    )


def hot_orders(usage: DataFrame, least: int = LEAST_HOT) -> DataFrame:
    """Ids of the orders that one task of a join by order should not get whole."""
    rows = usage.count()
    counts = usage.groupBy("order_id").agg(F.count("*").alias("n"))
    return counts.filter((F.col("n") > max(least, rows // HOT_SHARE)) & F.col("order_id").isNotNull()).select("order_id")


def open_layers(spark: SparkSession) -> Tables:
    """The cleaned tables of the last build, kept from removal for a day.

    Sizes and facts come from the catalog's statistics, so planning starts no job.
    """
    while True:
        generation = current_generation(spark, TRANSFORM)
        if generation is None:
            raise RuntimeError(f"the database {TRANSFORM} has no finished build")
        hold_generation(spark, TRANSFORM, generation)
        # Another rebuild may have replaced it before it was held.
        if current_generation(spark, TRANSFORM) == generation:
            break
    names = {name: table_of(TRANSFORM, name, generation) for name in (*TRANSFORM_SCHEMAS, _BY_ORDER, _OF_HOT)}
    facts = catalog_facts(spark, {name: names[name] for name in TRANSFORM_SCHEMAS}, generation)
    by_order = ByOrder(spark.table(names[_BY_ORDER]), spark.table(names[_OF_HOT]))
    return Tables.from_frames({name: spark.table(names[name]) for name in TRANSFORM_SCHEMAS}, facts=facts, by_order=by_order)
