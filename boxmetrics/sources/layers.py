"""Layers: the raw and the cleaned tables, kept as catalog tables or as Parquet folders.

Writing a layer replaces it whole. Readers get the files, so that a lost executor costs a
re-read and nothing else.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from boxmetrics.operators.filters import MONTH
from boxmetrics.schemas import TRANSFORM_SCHEMAS
from boxmetrics.sources.generations import remove_folder

STAGING = "staging"
TRANSFORM = "transform"

# Usage is kept by month, and in date order within each file. Reports on a quarter then open
# only that quarter's files. The further columns make long runs of equal values in every
# column the summary reports read.
_PARTED_BY = {"fact_box_usage": (MONTH, "order_date")}
_FILE_ORDER = {
    "fact_box_usage": (MONTH, "order_date", "market", "pkg_id", "meals_count", "is_damaged")
}
_COMPRESSION = "zstd"


def layer_name(layer: str | None, default: str) -> str:
    """The layer as named, or the default one if none is named."""
    return default if layer is None else layer


def laid_out(name: str, frame: DataFrame) -> DataFrame:
    """Rows in the order of their files, those of a month side by side.

    Adaptive execution deals the months to tasks of about the advised size: a month has as
    many files as its bytes need, and a task may write several small months. Rows that have
    their month already are laid out.
    """
    if name not in _PARTED_BY or _PARTED_BY[name][0] in frame.columns:
        return frame
    month, date = _PARTED_BY[name]
    rows = frame.withColumn(month, F.trunc(date, "month")).hint("rebalance", F.col(month))
    return rows.sortWithinPartitions(*_FILE_ORDER[name])


#: Rows of a slice of a month, at most, if all usage is in one month.
ROWS_PER_SLICE = 8_000_000


def merged_by_month(staged: DataFrame, rows: int) -> DataFrame:
    """Usage without exact repeats, laid out for its files, by one shuffle and one sort.

    Equal rows have the same month and the same slice of it, so the shuffle to the files brings
    them together, and the sort of the files puts them side by side. `rows` is about how many
    there are: slices bound what a task gets of a hot month, and what files a month has.
    """
    month, date = _PARTED_BY["fact_box_usage"]
    columns = TRANSFORM_SCHEMAS["fact_box_usage"].fieldNames()
    slices = F.lit(max(1, -(-rows // ROWS_PER_SLICE)))
    # The shuffle moves the columns of usage alone; both are worked out again behind it.
    of_month, of_slice = F.trunc(date, "month"), F.pmod(F.xxhash64(*columns), slices)
    dealt = staged.select(*columns).repartition(of_month, of_slice)
    placed = dealt.withColumns({month: of_month, "slice": of_slice})
    equal = Window.partitionBy(*_FILE_ORDER["fact_box_usage"], "order_id", "slice").orderBy("slice")
    first = placed.withColumn("nth", F.row_number().over(equal)).filter(F.col("nth") == 1)
    return first.select(*columns, month)


def parting(name: str) -> list[str]:
    return [_PARTED_BY[name][0]] if name in _PARTED_BY else []


def save_tables(
    spark: SparkSession,
    frames: Mapping[str, DataFrame],
    layer: str | None = None,
    default: str = "default",
) -> None:
    """Write the frames as tables of a database named after the layer."""
    require_shared_warehouse(spark)
    database = layer_name(layer, default)
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{database}`")
    for name, frame in frames.items():
        writer = frame.write.mode("overwrite").option("compression", _COMPRESSION)
        writer.saveAsTable(f"`{database}`.`{name}`")


def load_tables(
    spark: SparkSession,
    names: Mapping[str, T.StructType],
    layer: str | None = None,
    default: str = "default",
) -> dict[str, DataFrame]:
    database = layer_name(layer, default)
    return {name: spark.table(f"`{database}`.`{name}`") for name in names}


def save_files(frames: Mapping[str, DataFrame], folder: str) -> None:
    """Write the frames as Parquet below one folder."""
    for name, frame in frames.items():
        writer = laid_out(name, frame).write.mode("overwrite").option("compression", _COMPRESSION)
        writer.partitionBy(*parting(name)).parquet(f"{folder}/{name}")


def save_table(frame: DataFrame, name: str, table: str) -> None:
    """Write one table of a generation in its layout, with statistics of all its columns."""
    writer = laid_out(name, frame).write.option("compression", _COMPRESSION)
    writer.partitionBy(*parting(name)).saveAsTable(table)
    frame.sparkSession.sql(f"ANALYZE TABLE {table} COMPUTE STATISTICS FOR ALL COLUMNS")


#: Rows of a bucket, beyond the number of buckets that the session has shuffle partitions.
ROWS_PER_BUCKET = 4_000_000
_MOST_BUCKETS = 100_000


def save_by_order(frame: DataFrame, rows: int, table: str) -> None:
    """Write rows in buckets by order id, a file each, so that joins on it need no shuffle."""
    spark = frame.sparkSession
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = min(max(least, -(-rows // ROWS_PER_BUCKET)), _MOST_BUCKETS)
    writer = frame.repartition(buckets, "order_id").write.option("compression", _COMPRESSION)
    writer.bucketBy(buckets, "order_id").sortBy("order_id").saveAsTable(table)


def load_files(
    spark: SparkSession, schemas: Mapping[str, T.StructType], folder: str
) -> dict[str, DataFrame]:
    """The tables below a folder; usage has its month as well."""

    def stored(name: str, schema: T.StructType) -> T.StructType:
        return T.StructType([*schema.fields, *[T.StructField(month, T.DateType()) for month in parting(name)]])

    return {
        name: spark.read.schema(stored(name, schema)).parquet(f"{folder}/{name}")
        for name, schema in schemas.items()
    }


def require_shared_warehouse(spark: SparkSession) -> None:
    """Without a setting Spark puts tables into a folder beside the driver's program."""
    warehouse = spark.conf.get("spark.sql.warehouse.dir", "")
    if warehouse.endswith(f"{os.getcwd()}/spark-warehouse"):
        raise RuntimeError("set spark.sql.warehouse.dir to a folder all executors can reach")
    require_shared(spark, warehouse, "spark.sql.warehouse.dir")


#: Folders that were found to be shared, by application.
_probed: set[tuple[str, str]] = set()
PROBE_TASKS = 8


def _write_probe(spark: SparkSession, folder: str) -> None:
    spark.range(PROBE_TASKS, numPartitions=PROBE_TASKS).write.parquet(folder)


def require_shared(spark: SparkSession, folder: str, setting: str) -> None:
    """Stop unless the driver finds what the executors write below a folder.

    A folder that each machine has for itself takes all files and shows none of them. One
    machine alone needs no probe.
    """
    if not folder or spark.conf.get("spark.master", "").startswith("local["):
        return
    asked = (spark.sparkContext.applicationId, folder)
    if asked in _probed:
        return
    probe = f"{folder.rstrip('/')}/probe-{uuid.uuid4().hex}"
    _write_probe(spark, probe)
    found = spark.read.schema("id long").parquet(probe).count()
    remove_folder(spark, probe)
    if found != PROBE_TASKS:
        raise RuntimeError(
            f"{setting} names {folder}, where executors wrote {PROBE_TASKS} rows and the driver finds {found}: "
            "set it to a folder that all machines share"
        )
    _probed.add(asked)


def shared_folder(spark: SparkSession) -> str | None:
    """Folder that all executors see, as the session names it in `spark.checkpoint.dir`.

    Without one nothing is stored between queries; there is no other folder to fall back to.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    return named.rstrip("/") if named else None


def files_identity(spark: SparkSession, paths: Sequence[str]) -> str:
    """A digest of names, sizes and times of all files below the paths.

    Only the file listing is read, by Spark, so this holds for every store Spark can reach.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(list(paths))
    file = F.xxhash64("path", "length", "modificationTime").cast("decimal(20,0)")
    [found] = listed.agg(F.sum(file).alias("files"), F.count("*").alias("n")).collect()
    return f"{found['n']}_{found['files'] or 0}".replace("-", "m")


