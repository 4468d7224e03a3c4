"""Comparison of results, and frames built from rows."""

from __future__ import annotations

from boxmetrics import schemas
from boxmetrics.tables import Staging

TOLERANCE = 1e-6


def _key(row):
    """Place of a row in the comparison, not affected by the last digits of a number."""
    return [str(round(value, 3) + 0.0 if isinstance(value, float) else value) for value in row]


def same(left, right) -> bool:
    if isinstance(left, float) and isinstance(right, (int, float)):
        return abs(left - right) <= TOLERANCE * max(1.0, abs(right))
    return left == right


def assert_rows(frame, columns, expected):
    """Rows equal in any order, numbers within the tolerance."""
    actual = [tuple(row) for row in frame.select(*columns).collect()]
    assert len(actual) == len(expected), actual
    for got, wanted in zip(sorted(actual, key=_key), sorted(expected, key=_key)):
        assert all(same(a, b) for a, b in zip(got, wanted)), (got, wanted)


def assert_sorted(rows, keys: str):
    """Rows in the order of the keys; a null counts as greater than any value."""

    def place(row):
        return [(row[key[1:]] is None, row[key[1:]]) for key in keys.split()]

    for above, below in zip(rows, rows[1:]):
        for key, one, other in zip(keys.split(), place(above), place(below)):
            if one == other:
                continue
            greater = one[0] if one[0] != other[0] else one[1] > other[1]
            assert greater == (key[0] == "-"), (key, above, below)
            break


def staging_of(spark, packaging=(), standards=(), rates=(), usage=()) -> Staging:
    def frame(rows, schema):
        return spark.createDataFrame(list(rows), schema)

    return Staging(
        packaging=frame(packaging, schemas.STAGING_PACKAGING),
        standards=frame(standards, schemas.STAGING_STANDARDS),
        rates=frame(rates, schemas.STAGING_RATES),
        usage=frame(usage, schemas.STAGING_USAGE),
    )


def plan_of(frame) -> str:
    """The physical plan as `explain("formatted")` prints it."""
    modes = frame.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode
    return frame._jdf.queryExecution().explainString(modes.fromString("formatted"))
