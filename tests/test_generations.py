"""Rebuilds of the cleaned layer: the switch, readers of older ones, crashes, statistics, buckets."""

from __future__ import annotations

import time
from datetime import date, timedelta
from itertools import count
from pathlib import Path

import pytest
from pyspark.sql import types as T

from boxmetrics import build
from boxmetrics.build import open_layers, rebuild_transform
from boxmetrics.plans import overboxing
from boxmetrics.plans.registry import REPORTS
from boxmetrics.sources import generations
from boxmetrics.sources.layers import TRANSFORM
from boxmetrics.tables import Tables
from boxmetrics.transforms import build_transform
from tests import edge_cases
from tests.helpers import plan_of, staging_of

QUARTERLY = [
    "q02_total_cost_per_market",
    "q04a_cost_decomposition",
    "q04b_attribution_totals",
    "q10c_rate_negotiation",
    "qf1_financial_variance",
    "qf2_overboxing_gap",
]


def staging(spark, rows):
    return staging_of(spark, edge_cases.PACKAGING, edge_cases.STANDARDS, edge_cases.RATES, rows)


def rows_of(number: int) -> list[tuple]:
    return [(n, "DE", "P-M", 2, date(2026, 1, 1) + timedelta(n % 300), 0) for n in range(number)]


def generations_of(spark) -> set[str]:
    names = [row["tableName"] for row in spark.sql(f"SHOW TABLES IN {TRANSFORM}").collect()]
    return {name.rpartition("__")[2] for name in names if "__" in name}


_days = count(2, 2)


def pass_time(monkeypatch) -> None:
    """Two days later, and later than any time before: what is held has run out."""
    later = time.time() + next(_days) * generations.HELD_SECONDS
    monkeypatch.setattr(generations, "_now", lambda: later)


@pytest.fixture
def no_reader(spark, monkeypatch):
    """Nothing that earlier tests hold is left."""
    rebuild_transform(spark, staging(spark, rows_of(1)))
    pass_time(monkeypatch)
    generations.remove_generations(spark, TRANSFORM)


def test_two_rebuilds_leave_one_generation(spark, no_reader):
    for number in (10, 20):
        rebuild_transform(spark, staging(spark, rows_of(number)))
    assert generations_of(spark) == {generations.current_generation(spark, TRANSFORM)}
    assert spark.table("transform.fact_box_usage").count() == 20
    assert open_layers(spark).usage.count() == 20


def test_a_reader_of_an_older_generation_finishes(spark, no_reader):
    rebuild_transform(spark, staging(spark, rows_of(10)))
    older = open_layers(spark)
    old = generations.current_generation(spark, TRANSFORM)
    rebuild_transform(spark, staging(spark, rows_of(20)))
    assert older.usage.count() == 10 and open_layers(spark).usage.count() == 20
    assert old in generations_of(spark)
    # Once it has let go, the next rebuild removes what it read.
    generations.hold_generation(spark, TRANSFORM, old, 0)
    rebuild_transform(spark, staging(spark, rows_of(30)))
    assert old not in generations_of(spark)


def test_a_crash_before_the_switch_leaves_the_old_generation(spark, no_reader, monkeypatch):
    rebuild_transform(spark, staging(spark, rows_of(10)))
    with monkeypatch.context() as patch:
        patch.setattr(build, "save_by_order", lambda *args: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            rebuild_transform(spark, staging(spark, rows_of(20)))
    assert open_layers(spark).usage.count() == spark.table("transform.fact_box_usage").count() == 10
    # The unfinished one is held for its builder, until that time is over.
    assert len(generations_of(spark)) == 2
    pass_time(monkeypatch)
    assert len(generations.remove_generations(spark, TRANSFORM)) == 1
    assert open_layers(spark).usage.count() == 10


SCHEMA = T.StructType([T.StructField("layer", T.StringType()), T.StructField("rows", T.LongType())])


def test_generations_in_a_folder(spark, tmp_path, monkeypatch):
    folder = str(tmp_path)

    def make(rows):
        def written(layer):
            spark.range(rows).write.parquet(f"{layer}/numbers")
            return {"rows": rows}

        return written

    def here():
        return sorted(path.name for path in tmp_path.glob("generation-*"))

    assert generations.current_folder(spark, folder, SCHEMA) is None
    first = generations.build_folder(spark, folder, SCHEMA, "a", make(3))
    assert (first["number"], first["identity"], first["rows"]) == (1, "a", 3)
    reader = spark.read.parquet(f"{first['layer']}/numbers")
    second = generations.build_folder(spark, folder, SCHEMA, "b", make(4))
    # The builder holds the first one still, so that its own reader finishes.
    assert reader.count() == 3 and len(here()) == 2
    with pytest.raises(ZeroDivisionError):
        generations.build_folder(spark, folder, SCHEMA, "c", lambda layer: 1 / 0)
    assert generations.current_folder(spark, folder, SCHEMA) == second
    generations.hold_folder(spark, first["layer"], 0)
    assert generations.remove_folders(spark, folder, SCHEMA) == [first["layer"]]
    # What a crashed builder left goes when its time is over; the current one stays.
    pass_time(monkeypatch)
    generations.remove_folders(spark, folder, SCHEMA)
    assert here() == [Path(second["layer"]).name]
    assert spark.read.parquet(f"{second['layer']}/numbers").count() == 4


def test_statistics_decide_about_broadcasts_without_a_job(spark):
    rebuild_transform(spark, staging(spark, edge_cases.usage()))
    spark.sparkContext.setJobGroup("opening", "opening")
    tables = open_layers(spark)
    for report in REPORTS.values():
        report(tables)
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("opening")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert list(jobs) == []
    found = Tables.from_frames(tables.frames()).measured()
    for name, value in found.items():
        if isinstance(value, int) and not isinstance(value, bool):
            assert value <= tables.facts[name], name
        else:
            assert value == tables.facts[name]


def test_statistics_of_an_empty_layer(spark):
    rebuild_transform(spark, staging(spark, []))
    tables = open_layers(spark)
    assert tables.facts["first_day"] is None and tables.facts["calendar"] == 0
    assert REPORTS["q02_total_cost_per_market"](tables).collect() == []


@pytest.mark.parametrize("name", QUARTERLY)
def test_quarter_reports_open_only_their_months(spark, seed_tables, name):
    [filters] = {line for line in plan_of(REPORTS[name](seed_tables)).splitlines() if "order_month" in line and "PartitionFilters" in line}
    assert ">= 2026-01-01" in filters and "<= 2026-03-01" in filters


def test_orders_in_buckets_are_paired_without_a_shuffle(spark):
    """A third of the rows have one order id; that one is not in the buckets."""
    rows = [(1 if n % 3 == 0 else 10 + n // 2, "DE", ("P-S", "P-M", "P-L")[n % 3 and n % 2], 2, date(2025, 1, 1) + timedelta(n % 700), n // 700 % 2) for n in range(6000)]
    rebuild_transform(spark, staging(spark, rows), least_hot=100)
    tables = open_layers(spark)
    assert tables.by_order.of_hot_orders.select("order_id").distinct().collect() == [(1,)]
    hot = tables.by_order.of_hot_orders.count()
    assert hot > 1000 and tables.by_order.usage.count() == tables.usage.count() - hot
    frame = overboxing.overboxing_by_market(tables)
    exchanges = [line for line in plan_of(frame).splitlines() if line.startswith("Arguments: hashpartitioning(order_id")]
    # The one that is left moves the counts of the hot orders.
    assert len(exchanges) == 1
    tree = plan_of(frame).split("\n\n")[0]
    assert "SortMergeJoin" in tree and tree.count("usage_by_order") == 2
    plain = Tables.from_frames(build_transform(staging(spark, rows)).frames())
    assert frame.collect() == overboxing.overboxing_by_market(plain).collect()
    detail, wanted = overboxing.overboxing_detail(tables), overboxing.overboxing_detail(plain)
    counts = detail.groupBy(*detail.columns).count()
    assert counts.exceptAll(wanted.groupBy(*wanted.columns).count()).isEmpty()
    assert detail.count() == wanted.count()
