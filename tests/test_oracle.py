"""Every registered query against its SQL counterpart, exactly, on whole tables."""

from __future__ import annotations

import os
import re
from pathlib import Path

import pytest

import __spark_entry__ as registered
from tests.expected import SORT_KEYS
from tests.helpers import assert_sorted

duckdb = pytest.importorskip("duckdb")

FOLDER = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.01")
SOURCES = ("region", "nation", "customer", "part", "orders", "lineitem")

pytestmark = pytest.mark.skipif(not Path(FOLDER).is_dir(), reason="no test data")


@pytest.fixture(scope="module")
def database():
    connection = duckdb.connect()
    for name in SOURCES:
        connection.execute(
            f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{FOLDER}/{name}.parquet')"
        )
    return connection


def _sorted(rows):
    return sorted(rows, key=lambda row: [(value is None, str(value)) for value in row])


# The queries of the text operators have tests of their own.
NAMES = sorted(name for name in registered.queries() if not re.match(r"op\d+_|pipeline$", name))


def test_every_query_has_sql():
    assert set(NAMES) <= set(registered.oracle_sql())


@pytest.mark.parametrize("name", NAMES)
def test_same_as_sql(spark, database, name):
    frame = registered.queries()[name](spark, FOLDER)
    names = sorted(frame.columns)
    cursor = database.execute(registered.oracle_sql()[name])
    columns = [column[0] for column in cursor.description]
    types = {column[0]: str(column[1]) for column in cursor.description}
    assert sorted(columns) == names
    places = [columns.index(column) for column in names]
    wanted = _sorted(tuple(row[place] for place in places) for row in cursor.fetchall())
    rows = frame.collect()
    assert_sorted(rows, SORT_KEYS.get(name, ""))
    got = _sorted(tuple(row[name] for name in names) for row in rows)
    assert wanted, "the query finds nothing to compare"
    assert len(got) == len(wanted)
    differing = [pair for pair in zip(got, wanted) if pair[0] != pair[1]]
    assert not differing, (len(differing), differing[:3])
    kinds = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE"}
    assert {column: kinds[kind] for column, kind in frame.dtypes} == types
