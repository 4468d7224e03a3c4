"""Raw tables from CSV files.

Columns are found by their names in the header, in any order; a missing, unknown or repeated
name stops the job. Values are read as text and cast to the fixed schema. Empty fields and
the word NULL, in any case, are nulls. Anything else that does not fit its type stops the
job, with and without ANSI mode: a field is never turned into a null or rounded on the way in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from boxmetrics.schemas import STAGING_SCHEMAS
from boxmetrics.tables import Staging

_WIDE = T.DecimalType(38, 18)
_WHOLE_NUMBER = r"^\s*[+-]?[0-9]+\s*$"
_DAY = r"^\s*[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}\s*$"


def _value(field: T.StructField) -> Column:
    text = F.col(field.name)
    given = F.when(F.upper(F.trim(text)) != "NULL", text)
    if isinstance(field.dataType, T.StringType):
        return given.alias(field.name)
    kept = given.try_cast(field.dataType)
    fitting = kept.isNotNull()
    problem = F.lit(f"{field.name} is no {field.dataType.simpleString()}: ")
    if isinstance(field.dataType, T.DecimalType):
        exact = given.try_cast(_WIDE)
        too_fine = F.lit(f"{field.name} has too many decimal places: ")
        problem = F.when(exact.isNotNull() & (exact != kept), too_fine).otherwise(problem)
        fitting = fitting & (exact == kept)
    elif isinstance(field.dataType, T.DateType):
        fitting = fitting & given.rlike(_DAY)
    else:
        fitting = fitting & given.rlike(_WHOLE_NUMBER)
    unfit = F.raise_error(F.concat(problem, text))
    return F.when(fitting, kept).when(given.isNotNull(), unfit).alias(field.name)


def _header(spark: SparkSession, path: str, wanted: list[str]) -> list[str]:
    """The names in the header, all of those wanted and no others."""
    given = spark.read.csv(path, header=True, encoding="UTF-8").columns
    if sorted(given) != sorted(wanted):
        raise ValueError(f"{path} has the columns {given}; wanted are {wanted}")
    return given


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Read CSV files with header lines; a byte-order mark before one is ignored.

    With several files below the path, the header of each is compared with the first one's.
    """
    names = _header(spark, path, schema.names)
    as_text = T.StructType([T.StructField(name, T.StringType()) for name in names])
    raw = spark.read.csv(
        path, schema=as_text, header=True, enforceSchema=False, mode="FAILFAST", encoding="UTF-8"
    )
    return raw.select(*[_value(field) for field in schema.fields])


def read_staging(spark: SparkSession, folder: str) -> Staging:
    """Read `<folder>/<table>.csv` for the four raw tables."""
    return Staging.from_frames(
        {name: read_csv(spark, f"{folder}/{name}.csv", schema) for name, schema in STAGING_SCHEMAS.items()}
    )
