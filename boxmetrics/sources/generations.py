"""Whole rebuilds of a layer as generations, one of which is current.

A rebuild writes a generation beside the one in use. A single step then makes it the current
one, so a crash before it leaves everything as it was, and a reader sees the tables of one
rebuild only. Who reads a generation holds it for a time; generations that are neither current
nor held are removed by the next rebuild.

In a catalog a generation is a set of tables, and the database's properties say which set is
current and who holds which. In a shared folder it is a folder, the manifest (a small Parquet
table that rows are only added to) says which is current, and holders are listed within it.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: How long a reader holds a generation, unless it lets go of it earlier.
HELD_SECONDS = 24 * 3600
_CURRENT = "generation"
_HOLDER = "holder."

_HOLDERS = "holder string, until double, written double"


def _now() -> float:
    return time.time()


def _reader(spark: SparkSession) -> str:
    return spark.sparkContext.applicationId


# In a catalog.


def _properties(spark: SparkSession, database: str) -> dict[str, str]:
    rows = spark.sql(f"DESCRIBE DATABASE EXTENDED `{database}`").collect()
    [listed] = [row["info_value"] for row in rows if row["info_name"] == "Properties"]
    pairs = listed.strip("()").split("), (") if listed else []
    return dict(pair.strip("()").split(",", 1) for pair in pairs)


def _set_property(spark: SparkSession, database: str, name: str, value: str) -> None:
    spark.sql(f"ALTER DATABASE `{database}` SET DBPROPERTIES ('{name}' = '{value}')")


def table_of(database: str, name: str, generation: str) -> str:
    return f"`{database}`.`{name}__{generation}`"


def current_generation(spark: SparkSession, database: str) -> str | None:
    if not spark.catalog.databaseExists(database):
        return None
    return _properties(spark, database).get(_CURRENT) or None


def hold_generation(spark: SparkSession, database: str, generation: str, seconds: float = HELD_SECONDS) -> None:
    """Keep the tables of a generation from removal for a time; with 0 seconds, let go of them."""
    _set_property(spark, database, f"{_HOLDER}{generation}.{_reader(spark)}", str(_now() + seconds))


def write_generation(
    spark: SparkSession,
    database: str,
    makers: Mapping[str, Callable[[Callable[[str], DataFrame]], DataFrame]],
    save: Callable[[DataFrame, str, str], None],
    views: Mapping[str, list[str]],
) -> str:
    """Write tables as a new generation and make it the current one.

    Each maker gets a reader of the generation's tables before it and returns the rows of
    its own; `save(frame, name, table)` writes them. Views with plain names, of the given
    columns, follow the switch.
    """
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{database}`")
    generation = uuid.uuid4().hex[:12]
    hold_generation(spark, database, generation)
    for name, make in makers.items():
        rows = make(lambda other: spark.table(table_of(database, other, generation)))
        save(rows, name, table_of(database, name, generation))
    _set_property(spark, database, _CURRENT, generation)
    for name, wanted in views.items():
        plain = f"`{database}`.`{name}`"
        if spark.catalog.tableExists(plain) and spark.catalog.getTable(plain).tableType != "VIEW":
            spark.sql(f"DROP TABLE {plain}")
        listed = ", ".join(f"`{column}`" for column in wanted)
        spark.sql(f"CREATE OR REPLACE VIEW {plain} AS SELECT {listed} FROM {table_of(database, name, generation)}")
    # The current generation needs nobody to hold it.
    hold_generation(spark, database, generation, 0)
    remove_generations(spark, database)
    return generation


def remove_generations(spark: SparkSession, database: str) -> list[str]:
    """Drop the tables of all generations that are neither current nor held."""
    known = _properties(spark, database)
    held = {
        name.removeprefix(_HOLDER).split(".")[0]
        for name, until in known.items()
        if name.startswith(_HOLDER) and float(until) > _now()
    }
    removed = set()
    for row in spark.sql(f"SHOW TABLES IN `{database}`").collect():
        generation = row["tableName"].rpartition("__")[2] if "__" in row["tableName"] else None
        if generation and generation != known.get(_CURRENT) and generation not in held:
            spark.sql(f"DROP TABLE IF EXISTS `{database}`.`{row['tableName']}`")
            removed.add(generation)
    return sorted(removed)


# In a shared folder.


def _file_system(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def remove_folder(spark: SparkSession, folder: str) -> None:
    files, path = _file_system(spark, folder)
    files.delete(path, True)


def _rows(spark: SparkSession, schema: T.StructType | str, folder: str) -> list:
    try:
        return spark.read.schema(schema).parquet(folder).collect()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return []


def _add_row(spark: SparkSession, schema: T.StructType | str, row: tuple, folder: str) -> None:
    spark.createDataFrame([row], schema).coalesce(1).write.mode("append").parquet(folder)


def _manifest(schema: T.StructType) -> T.StructType:
    number, identity = T.StructField("number", T.LongType()), T.StructField("identity", T.StringType())
    return T.StructType([number, identity, *schema.fields])


def current_folder(spark: SparkSession, folder: str, schema: T.StructType) -> dict | None:
    """The manifest's last row: number, identity of the source, and the facts of `schema`,
    among them `layer`, the generation's folder."""
    rows = _rows(spark, _manifest(schema), f"{folder}/manifest")
    return max(rows, key=lambda row: (row["number"], row["layer"])).asDict() if rows else None


def hold_folder(spark: SparkSession, layer: str, seconds: float = HELD_SECONDS) -> None:
    """Keep a generation from removal for a time; with 0 seconds, let go of it."""
    now = _now()
    _add_row(spark, _HOLDERS, (_reader(spark), now + seconds, now), f"{layer}/holders")


def _is_held(spark: SparkSession, layer: str) -> bool:
    last = {}
    for row in sorted(_rows(spark, _HOLDERS, f"{layer}/holders"), key=lambda row: row["written"]):
        last[row["holder"]] = row["until"]
    return any(until > _now() for until in last.values())


def build_folder(
    spark: SparkSession,
    folder: str,
    schema: T.StructType,
    identity: str,
    build: Callable[[str], Mapping[str, object]],
) -> dict:
    """Build a generation, make it the current one, and remove those that nobody needs.

    `build` writes the tables into the folder it gets and returns the facts about them. Of two
    generations built at the same time one is used.
    """
    before = current_folder(spark, folder, schema)
    number = before["number"] + 1 if before else 1
    layer = f"{folder}/generation-{number}-{uuid.uuid4().hex[:12]}"
    hold_folder(spark, layer)
    facts = {"number": number, "identity": identity, "layer": layer, **build(layer)}
    names = _manifest(schema).fieldNames()
    _add_row(spark, _manifest(schema), tuple(facts[name] for name in names), f"{folder}/manifest")
    remove_folders(spark, folder, schema)
    return current_folder(spark, folder, schema)


def remove_folders(spark: SparkSession, folder: str, schema: T.StructType) -> list[str]:
    """Remove all generations that are neither current nor held, finished or not."""
    current = current_folder(spark, folder, schema)
    files, path = _file_system(spark, folder)
    removed = []
    for status in files.listStatus(path):
        name = status.getPath().getName()
        layer = f"{folder}/{name}"
        if not name.startswith("generation-") or (current and layer == current["layer"]) or _is_held(spark, layer):
            continue
        files.delete(status.getPath(), True)
        removed.append(layer)
    return sorted(removed)
