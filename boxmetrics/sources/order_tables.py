"""Staging tables derived from a parts-and-orders star schema.

Spark computes all four tables from the Parquet files, so each grows with them:

- usage: one row per order line. The market follows from the customer's region, the box
  from size and type of the part, the number of meals from the quantity. Lines of some
  parts arrive twice, as a replayed load would deliver them.
- boxes: one per size class and part type that occurs, as large as the mean part in it.
- standards: one raw row per part, naming the box of its size class.
- rates: one per market and quarter, from the mean order value, delivered twice.

A table is broadcast only if its measured size allows it, as rows or with its keys packed into
words (`operators/packed.py`). Otherwise both sides are shuffled,
and adaptive execution splits the partitions of hot keys. If a partition of the lookup is small
enough, it is hashed and the many rows of the other side need no sort; if not, both are sorted
and merged.
"""

from __future__ import annotations

import hashlib
import threading
import time
from collections.abc import Callable
from datetime import date
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from boxmetrics.operators.packed import names_to_pack, packed, with_packed
from boxmetrics.operators.sizing import BROADCAST_LIMIT_BYTES, measured_bytes
from boxmetrics.schemas import INPUT_NUMBER, STAGING_SCHEMAS, TRANSFORM_SCHEMAS
from boxmetrics.sources.generations import HELD_SECONDS, build_folder, current_folder, hold_folder
from boxmetrics.sources.layers import (
    files_identity,
    load_files,
    merged_by_month,
    require_shared,
    save_files,
    shared_folder,
)
from boxmetrics.tables import FACTS, Staging, Tables
from boxmetrics.transforms import build_transform

SOURCE_TABLES = ("region", "nation", "customer", "part", "orders", "lineitem")
# To be raised when the mapping or a transform changes, so that no older layer is reused.
LAYOUT = 2

# Fixed values of the mapping.
FIRST_DAY = date(2025, 1, 1)
SOURCE_FIRST_DAY = date(1995, 1, 1)
DAYS = 730
LAST_QUARTER = date(2026, 10, 1)
OPEN_END = date(9999, 12, 31)
STANDARD_TYPE = "STANDARD"
MARKETS = {"AFRICA": "DE", "EUROPE": "DE", "AMERICA": "UK", "ASIA": "NL"}
OTHER_MARKET = "FR"
SIZE_CLASSES = ((12, "P-S", "Small Box"), (25, "P-M", "Medium Box"), (40, "P-L", "Large Box"))
LARGEST_CLASS = ("P-XL", "Extra Large")
# Meals of each size class. No standard has 12, which some quantities give.
MEALS_OF_CLASS = {"P-S": 2, "P-M": 4, "P-L": 6, "P-XL": 8}
MEALS_OF_QUANTITY = {0: 2, 1: 4, 2: 6, 3: 12, 4: 8}


def _chosen(column: Column, values: dict, otherwise: object = None) -> Column:
    result = F.lit(otherwise)
    for key, value in values.items():
        result = F.when(column == key, F.lit(value)).otherwise(result)
    return result


def _by_size(position: int) -> Column:
    result = F.lit(LARGEST_CLASS[position])
    for upper, *names in reversed(SIZE_CLASSES):
        result = F.when(F.col("p_size") <= upper, F.lit(names[position])).otherwise(result)
    return result


def _variant(of: Column, separator: str) -> Column:
    plain = F.col("p_type") == STANDARD_TYPE
    return F.when(plain, of).otherwise(F.concat(of, F.lit(separator), F.col("p_type")))


def _shifted_date(timestamp: str) -> Column:
    """Dates of the source folded onto the two years the reports are about."""
    days = F.date_diff(F.col(timestamp).cast("date"), F.lit(SOURCE_FIRST_DAY))
    return F.date_add(F.lit(FIRST_DAY), F.pmod(days, F.lit(DAYS)))


def _repeated(copies: Column) -> Column:
    return F.explode(F.array_repeat(F.lit(True), copies))


class OrderTables:
    """The Parquet files of one folder. Files are opened, and sizes measured, once."""

    def __init__(
        self, spark: SparkSession, folder: str, broadcast_limit: int = BROADCAST_LIMIT_BYTES
    ) -> None:
        self._spark = spark
        self._folder = folder.rstrip("/")
        self._broadcast_limit = broadcast_limit
        self._opened: dict[str, DataFrame] = {}
        self._sizes: dict[str, int] = {}
        self._names: dict[str, list[str | None]] = {}

    def _read(self, name: str, *columns: str) -> DataFrame:
        if name not in self._opened:
            self._opened[name] = self._spark.read.parquet(f"{self._folder}/{name}.parquet")
        return self._opened[name].select(*columns)

    def _looked_up(
        self, frame: DataFrame, lookup: DataFrame, on: Column, table: str, *columns: str
    ) -> DataFrame:
        """Join a lookup that has the given columns of a table, or as much, under unique keys.

        It is broadcast if these columns are small. If not, both sides are shuffled by key, and a
        partition of the lookup is hashed if it is as small as that.
        """
        size = self._size_of(table, *columns)
        partitions = int(self._spark.conf.get("spark.sql.shuffle.partitions"))
        if size <= self._broadcast_limit:
            lookup = F.broadcast(lookup)
        elif size <= self._broadcast_limit * partitions:
            lookup = lookup.hint("shuffle_hash")
        else:
            lookup = lookup.hint("merge")
        return frame.join(lookup, on)

    def _named(self, frame: DataFrame, lookup: DataFrame, key: Column, table: str, *columns: str) -> DataFrame:
        """Join a lookup of two columns, a unique whole number and one of a few names.

        It is broadcast as it is if that is small. If not, it is packed, some bits for each
        number, and broadcast if that is small; the numbers must lie close to each other for
        that. Otherwise both sides are shuffled by the number. Numbers that come twice are not
        packed, so their rows are all found.
        """
        number, name = lookup.columns
        if self._size_of(table, *columns) > self._broadcast_limit > 0:
            if table not in self._names:
                self._names[table] = names_to_pack(lookup, number, name, self._broadcast_limit)
            if self._names[table]:
                return with_packed(frame, packed(lookup, number, name, self._names[table]), key, name, self._names[table])
        return self._looked_up(frame, lookup, key == F.col(number), table, *columns).drop(number)

    def _size_of(self, table: str, *columns: str) -> int:
        if table not in self._sizes:
            self._sizes[table] = measured_bytes(self._read(table, *columns))
        return self._sizes[table]

    def _orders_with_market(self, *columns: str) -> DataFrame:
        regions = self._read("region", "r_regionkey", "r_name")
        nations = self._read("nation", "n_nationkey", "n_regionkey")
        customers = self._read("customer", "c_custkey", "c_nationkey")
        orders = self._read("orders", "o_orderkey", "o_custkey", *columns)
        in_region = F.col("n_regionkey") == F.col("r_regionkey")
        in_nation = F.col("c_nationkey") == F.col("n_nationkey")
        nations = self._looked_up(nations, regions, in_region, "region", *regions.columns)
        customers = self._looked_up(
            customers, nations, in_nation, "nation", "n_nationkey", "n_regionkey"
        ).select(
            "c_custkey", _chosen(F.col("r_name"), MARKETS, OTHER_MARKET).alias("market")
        )
        return self._named(
            orders, customers, F.col("o_custkey"), "customer", "c_custkey", "c_nationkey"
        )

    def usage_lines(self) -> int:
        """Number of order lines, as the files state it."""
        return self._read("lineitem").count()

    def usage(self) -> DataFrame:
        """Rows of usage. What can be derived from a line, or from its part, is derived before
        the next shuffle, which then moves a few small values a row."""
        lines = self._read(
            "lineitem",
            "l_orderkey",
            "l_partkey",
            "l_linenumber",
            "l_quantity",
            "l_returnflag",
            "l_shipdate",
        ).select(
            "l_orderkey",
            "l_partkey",
            "l_linenumber",
            "l_quantity",
            (F.col("l_returnflag") == "R").cast("int").alias("is_damaged"),
            _shifted_date("l_shipdate").alias("order_date"),
        )
        parts = self._read("part", "p_partkey", "p_type", "p_size")
        boxes = parts.select("p_partkey", _variant(_by_size(0), "/").alias("named_box"))
        markets = self._orders_with_market().select("o_orderkey", "market")
        lines = self._named(lines, boxes, F.col("l_partkey"), "part", *parts.columns).select(
            "l_orderkey",
            "l_linenumber",
            "l_quantity",
            "is_damaged",
            "order_date",
            F.when(F.col("l_partkey") % 37 != 0, F.col("named_box")).alias("pkg_id"),
            F.when(F.col("l_partkey") % 50 == 0, 2).otherwise(1).alias("copies"),
        )
        lines = self._named(lines, markets, F.col("l_orderkey"), "orders", "o_orderkey", "o_custkey")
        rows = lines.select(
            (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("order_id"),
            "market",
            "pkg_id",
            _chosen(F.col("l_quantity").cast("int") % 5, MEALS_OF_QUANTITY)
            .cast("int")
            .alias("meals_count"),
            "order_date",
            "is_damaged",
            "copies",
        )
        return rows.withColumn("copy", _repeated(F.col("copies"))).select(
            *STAGING_SCHEMAS["fact_box_usage"].fieldNames()
        )

    def packaging(self) -> DataFrame:
        parts = self._read("part", "p_type", "p_size").withColumns(
            {"size_class": _by_size(0), "class_name": _by_size(1)}
        )
        in_cm2 = F.col("size_class") == "P-M"
        cm2 = F.col("area_cm2").cast(INPUT_NUMBER)
        return (
            parts.groupBy("size_class", "class_name", "p_type")
            .agg(F.expr("sum(p_size) * 500 div count(p_size)").alias("area_cm2"))
            .select(
                _variant(F.col("size_class"), "/").alias("pkg_id"),
                _variant(F.col("class_name"), " ").alias("pkg_name"),
                F.col("p_type").alias("material_type"),
                F.when(in_cm2, cm2)
                .otherwise((cm2 / F.lit(Decimal(10000))).cast(INPUT_NUMBER))
                .alias("surface_area"),
                F.when(in_cm2, "cm2").otherwise("m2").alias("unit_of_measure"),
                F.when(F.col("size_class") == LARGEST_CLASS[0], "Discontinued")
                .otherwise("Active")
                .alias("status"),
            )
        )

    def standards(self) -> DataFrame:
        sized = self._read("part", "p_size").withColumn("recommended_pkg_id", _by_size(0))
        return sized.select(
            _chosen(F.col("recommended_pkg_id"), MEALS_OF_CLASS).cast("int").alias("meals_count"),
            "recommended_pkg_id",
        )

    def rates(self) -> DataFrame:
        cents = F.round(F.col("o_totalprice") * 100).cast("bigint")
        quarters = (
            self._orders_with_market("o_orderdate", "o_totalprice")
            .groupBy(
                "market",
                F.trunc(_shifted_date("o_orderdate"), "quarter").alias("valid_from"),
            )
            .agg(F.sum(cents).alias("cents"), F.count("*").alias("n"))
        )
        in_pounds = F.col("market") == "UK"
        rates = quarters.select(
            "market",
            F.when(F.col("market") == "DE", "Recycled Paper")
            .otherwise("Corrugated")
            .alias("material_type"),
            (F.expr("cents div (n * 200000)").cast(INPUT_NUMBER) / F.lit(Decimal(100)))
            .cast(INPUT_NUMBER)
            .alias("cost_per_m2"),
            F.when(in_pounds, "GBP").otherwise("EUR").alias("currency"),
            "valid_from",
            F.when(F.col("valid_from") == F.lit(LAST_QUARTER), F.lit(OPEN_END))
            .otherwise(F.last_day(F.add_months("valid_from", 2)))
            .alias("valid_to"),
        )
        return rates.withColumn("copy", _repeated(F.lit(2))).drop("copy")

    def staging(self) -> Staging:
        return Staging(
            packaging=self.packaging(),
            standards=self.standards(),
            rates=self.rates(),
            usage=self.usage(),
        )


_building = threading.Lock()


def order_tables(spark: SparkSession, folder: str) -> OrderTables:
    """The files of a folder as they are now."""
    return OrderTables(spark, folder)


#: The generation that an application has opened of a layer, and until when it may be used.
_opened: dict[tuple[str, str], tuple[dict, float]] = {}


def _opened_layer(spark: SparkSession, kept: str, identity: str, build: Callable[[str], dict]) -> dict:
    """Facts about the current generation, built if the source has changed, and held."""
    application = (spark.sparkContext.applicationId, kept)
    facts, until = _opened.get(application, (None, 0.0))
    if facts and facts["identity"] == identity and time.time() < until:
        return facts
    while True:
        facts = current_folder(spark, kept, FACTS)
        if facts is None or facts["identity"] != identity:
            require_shared(spark, kept, "spark.checkpoint.dir")
            facts = build_folder(spark, kept, FACTS, identity, build)
        hold_folder(spark, facts["layer"])
        # Another rebuild may have replaced it before it was held.
        if current_folder(spark, kept, FACTS)["layer"] == facts["layer"]:
            _opened[application] = (facts, time.time() + HELD_SECONDS / 2)
            return facts


def transform_tables(spark: SparkSession, folder: str) -> Tables:
    """Cleaned tables for a folder.

    They are kept in the session's shared folder, as a generation with the identity of the
    source files: any session reuses it while these are the same, and holds it as long as it
    may read. Changed files lead to a new one, which replaces it. Without a shared folder
    the tables are computed from the source by every report.
    """
    shared = shared_folder(spark)
    if shared is None:
        return Tables.from_frames(build_transform(order_tables(spark, folder).staging()).frames())
    path = folder.rstrip("/")
    identity = files_identity(spark, [f"{path}/{name}.parquet" for name in SOURCE_TABLES])
    kept = f"{shared}/boxmetrics/{hashlib.sha256(f'{LAYOUT} {path}'.encode()).hexdigest()[:16]}"

    def build(layer: str) -> dict[str, object]:
        source = order_tables(spark, path)
        staging = source.staging()
        frames = build_transform(staging).frames()
        frames["fact_box_usage"] = merged_by_month(staging.usage, source.usage_lines())
        save_files(frames, layer)
        return Tables.from_frames(load_files(spark, TRANSFORM_SCHEMAS, layer)).measured()

    with _building:
        facts = _opened_layer(spark, kept, identity, build)
    return Tables.from_frames(load_files(spark, TRANSFORM_SCHEMAS, facts["layer"]), facts=facts)
