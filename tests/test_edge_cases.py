"""Reports on unusual rows, against the row-by-row SQL, on every way a join can run."""

from __future__ import annotations

import pytest

from boxmetrics import oracle
from boxmetrics.build import open_layers, rebuild_transform
from boxmetrics.plans import audit, damage, markets, master, overboxing
from boxmetrics.plans.registry import REPORTS
from boxmetrics.schemas import TRANSFORM_SCHEMAS
from boxmetrics.sources.layers import load_files, save_files
from boxmetrics.tables import Tables
from boxmetrics.transforms import build_transform
from tests import edge_cases
from tests.expected import SORT_KEYS
from tests.helpers import assert_rows, assert_sorted, staging_of

duckdb = pytest.importorskip("duckdb")

_RELATIONS = """
    box AS (SELECT pkg_id, pkg_name, material_type, raw_area, unit, area, status FROM boxes),
    std AS (SELECT * FROM standards), rate AS (SELECT * FROM rates), usage AS (SELECT * FROM orders)
"""


@pytest.fixture(scope="module")
def frames(spark, tmp_path_factory):
    staging = staging_of(
        spark,
        edge_cases.PACKAGING,
        edge_cases.STANDARDS,
        edge_cases.RATES,
        edge_cases.usage(),
    )
    folder = str(tmp_path_factory.mktemp("edges"))
    save_files(build_transform(staging).frames(), folder)
    return load_files(spark, TRANSFORM_SCHEMAS, folder)


@pytest.fixture(scope="module", params=["broadcast", "shuffled", "catalog"])
def tables(request, spark, frames):
    """The tables with lookups within the broadcast limit, with none within it, and as tables of
    a catalog, with usage in buckets by order and some orders hot."""
    if request.param == "broadcast":
        yield Tables.from_frames(frames)
        return
    if request.param == "catalog":
        staging = staging_of(spark, edge_cases.PACKAGING, edge_cases.STANDARDS, edge_cases.RATES, edge_cases.usage())
        rebuild_transform(spark, staging, least_hot=20)
        yield open_layers(spark)
        return
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield Tables.from_frames(frames, broadcast_limit=0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.fixture(scope="module")
def database(frames):
    """The cleaned tables, made by hand rather than by the transforms."""
    connection = duckdb.connect()
    connection.execute(
        "CREATE TABLE boxes (pkg_id TEXT, pkg_name TEXT, material_type TEXT, "
        "raw_area DECIMAL(12,4), unit TEXT, area DECIMAL(12,4), status TEXT)"
    )
    for pkg_id, name, material, area, unit, status in edge_cases.PACKAGING:
        m2 = area / 10000 if unit == "cm2" else area
        connection.execute(
            "INSERT INTO boxes VALUES (?, ?, ?, ?, ?, ?, ?)",
            [pkg_id, name, material, area, unit, m2, status],
        )
    connection.execute("CREATE TABLE standards (meals_count INTEGER, recommended_pkg_id TEXT)")
    connection.executemany("INSERT INTO standards VALUES (?, ?)", edge_cases.STANDARDS)
    connection.execute(
        "CREATE TABLE rates (market TEXT, material_type TEXT, local_rate DECIMAL(12,4), "
        "currency TEXT, eur DECIMAL(12,4), valid_from DATE, valid_to DATE)"
    )
    for market, material, local, currency, start, end in edge_cases.RATES:
        eur = local * edge_cases.D("1.17") if currency == "GBP" else local
        connection.execute(
            "INSERT INTO rates VALUES (?, ?, ?, ?, ?, ?, ?)",
            [market, material, local, currency, eur, start, end],
        )
    connection.execute(
        "CREATE TABLE orders (order_id BIGINT, market TEXT, pkg_id TEXT, meals_count INTEGER, "
        "order_date DATE, is_damaged INTEGER)"
    )
    connection.executemany(
        "INSERT INTO orders VALUES (?, ?, ?, ?, ?, ?)", list(dict.fromkeys(edge_cases.usage()))
    )
    return connection


@pytest.mark.parametrize("name", sorted(REPORTS))
def test_same_as_sql(tables, database, name):
    frame = REPORTS[name](tables)
    cursor = database.execute(f"WITH {_RELATIONS} {oracle.reports()[name]}")
    columns = [column[0] for column in cursor.description]
    rows = cursor.fetchall()
    assert rows
    assert_rows(frame, columns, rows)


@pytest.mark.parametrize("name", sorted(SORT_KEYS))
def test_order_with_nulls(tables, name):
    rows = REPORTS[name](tables).collect()
    assert len(rows) > 1
    assert_sorted(rows, SORT_KEYS[name])


def test_every_grade_of_fit_occurs(tables):
    grades = overboxing.overboxing_detail(tables).select("fit_category").distinct()
    assert {row[0] for row in grades.collect()} == {
        "Perfect Fit",
        "Under-boxed",
        "Slight Over-box",
        "Moderate Over-box",
        "Severe Over-box",
    }


def test_fit_limits_are_inclusive(tables):
    rows = overboxing.overboxing_detail(tables).filter("recommended_pkg_id = 'P-S'")
    grades = dict(rows.select("actual_pkg", "fit_category").distinct().collect())
    assert (grades["P-S+"], grades["P-S++"]) == ("Slight Over-box", "Moderate Over-box")


def test_normalised_fit(tables):
    """With equal units a cm2 box of the recommended size is a perfect fit."""
    fits = damage.damage_detail(tables, normalised=True).filter(
        "pkg_id = 'P-M' and recommended_area_m2 = 0.85"
    )
    assert {row["fit_category"] for row in fits.collect()} == {"Perfect Fit"}


def test_null_market_label(tables):
    labels = {row["dimension"] for row in damage.damage_rate(tables).collect()}
    assert "Market: " in labels and "Box: P-NN ()" in labels


def test_window_includes_both_ends(spark, tables):
    days = markets.total_cost_per_market(tables)
    assert days.count() == 3
    detail = overboxing.cost_decomposition(tables).agg({"order_date": "max"}).first()[0]
    assert str(detail) == "2026-03-31"


@pytest.fixture(scope="module")
def empty(spark):
    staging = staging_of(
        spark, edge_cases.PACKAGING, edge_cases.STANDARDS, edge_cases.RATES, []
    )
    return build_transform(staging)


@pytest.mark.parametrize("name", sorted(REPORTS))
def test_empty_usage_is_no_error(empty, name):
    REPORTS[name](empty).collect()


def test_empty_master_metrics(empty):
    [row] = master.master_metrics(empty).collect()
    counts = {"total_clean_orders": 0, "null_pkg_id_orders": 0, "duplicate_order_rows": 0}
    assert {name: row[name] for name in counts} == counts
    others = set(row.asDict()) - set(counts)
    assert {name for name in others if row[name] is not None} == set()


def test_empty_totals(empty):
    assert_rows(
        damage.damage_rate(empty),
        ["dimension", "total_orders", "damaged_orders", "damage_rate_pct"],
        [("Overall", 0, None, None)],
    )
    assert {row["affected_records"] for row in audit.audit_summary(empty).collect()} == {0}


def test_missing_order_ids(spark):
    """Rows without an id count as rows, not as orders."""
    day = edge_cases.date(2026, 1, 5)
    usage = [(1, "DE", "P-S", 2, day, 0), (None, "DE", "P-L", 2, day, 1)]
    staging = staging_of(
        spark, edge_cases.PACKAGING, edge_cases.STANDARDS, edge_cases.RATES, usage
    )
    built = build_transform(staging)
    assert not built.order_ids_complete
    [row] = markets.market_scorecard(built).collect()
    assert (row["total_orders"], row["total_meals"], row["overboxed_orders"]) == (1, 4, 1)
    assert row["damage_rate_pct"] == 100.0
    [gap] = markets.overboxing_gap(built).collect()
    assert gap["overboxed_orders"] == 1
