"""Reading raw files, and keeping the layers."""

from __future__ import annotations

import os
import shutil
from datetime import date
from decimal import Decimal
from pathlib import Path

import pyarrow.parquet as parquet
import pytest
from pyspark.sql import functions as F

from boxmetrics import schemas
from boxmetrics.build import build_layers, open_layers
from boxmetrics.operators.packed import names_to_pack, packed, with_packed
from boxmetrics.plans.registry import REPORTS
from boxmetrics.sources import layers
from boxmetrics.sources import order_tables as order_source
from boxmetrics.sources.csv_files import read_csv
from boxmetrics.sources.order_tables import OrderTables
from boxmetrics.tables import Tables
from tests.expected import CHECKS
from tests.helpers import assert_rows, plan_of

SMALL = "/root/testdata/sf0.001"


def written(tmp_path, text: str) -> str:
    path = tmp_path / "rows.csv"
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_row_counts(seed_staging, seed_tables):
    staged = {name: frame.count() for name, frame in seed_staging.frames().items()}
    cleaned = {name: frame.count() for name, frame in seed_tables.frames().items()}
    names = sorted(schemas.STAGING_SCHEMAS)
    assert [staged[name] for name in names] == [4, 3, 4, 9]
    assert [cleaned[name] for name in names] == [4, 3, 4, 8]


def test_schemas_are_the_fixed_ones(seed_staging, seed_tables):
    for name, frame in seed_staging.frames().items():
        assert frame.dtypes == [(f.name, f.dataType.simpleString()) for f in schemas.STAGING_SCHEMAS[name]]
    for name, frame in seed_tables.frames().items():
        wanted = [(f.name, f.dataType.simpleString()) for f in schemas.TRANSFORM_SCHEMAS[name]]
        # Stored usage also has the month it is kept by.
        assert frame.dtypes == wanted + [("order_month", "date")] * (name == "fact_box_usage")


def test_byte_order_mark_is_no_part_of_the_first_value(seed_staging):
    assert {row["pkg_id"] for row in seed_staging.packaging.collect()} == {"P-S", "P-M", "P-L", "P-XL"}


@pytest.mark.parametrize("word", ["NULL", "null", "Null", ""])
def test_null_words(spark, tmp_path, word):
    text = f"order_id,market,pkg_id,meals_count,order_date,is_damaged\n1,DE,{word},{word},{word},0\n"
    [row] = read_csv(spark, written(tmp_path, text), schemas.STAGING_USAGE).collect()
    assert tuple(row) == (1, "DE", None, None, None, 0)


def test_quoted_values(spark, tmp_path):
    text = 'pkg_id,pkg_name,material_type,surface_area,unit_of_measure,status\nA,"Box, big",M,1.2345,m2,Active\n'
    [row] = read_csv(spark, written(tmp_path, text), schemas.STAGING_PACKAGING).collect()
    assert (row["pkg_name"], row["surface_area"]) == ("Box, big", Decimal("1.2345"))


@pytest.fixture(params=["true", "false"], ids=["ansi", "not_ansi"])
def mode(spark, request):
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", request.param)
    yield
    spark.conf.set("spark.sql.ansi.enabled", before)


USAGE_HEADER = "order_id,market,pkg_id,meals_count,order_date,is_damaged"


@pytest.mark.parametrize(
    "values",
    [
        "1,DE,P-S,2,2026-02-30,0",
        "1,DE,P-S,2,soon,0",
        "1,DE,P-S,2,2026-02-03T10:00:00,0",
        "9001.5,DE,P-S,2,2026-02-03,0",
        "1,DE,P-S,two,2026-02-03,0",
        "1,DE,P-S,99999999999,2026-02-03,0",
    ],
)
def test_bad_values_stop_the_job(spark, mode, tmp_path, values):
    path = written(tmp_path, f"{USAGE_HEADER}\n{values}\n")
    with pytest.raises(Exception, match=r" is no (bigint|int|date): "):
        read_csv(spark, path, schemas.STAGING_USAGE).collect()


@pytest.mark.parametrize("mark", ["", "\ufeff"])
def test_columns_go_by_name(spark, mode, tmp_path, mark):
    text = f"{mark}is_damaged,pkg_id,market,order_date,meals_count,order_id\n0,P-S,DE,2026-02-03,12,7\n"
    [row] = read_csv(spark, written(tmp_path, text), schemas.STAGING_USAGE).collect()
    assert tuple(row) == (7, "DE", "P-S", 12, date(2026, 2, 3), 0)


@pytest.mark.parametrize("mark", ["", "\ufeff"])
@pytest.mark.parametrize(
    "header",
    [
        "order_id,market,pkg_id,meals_count,order_date",
        f"{USAGE_HEADER},note",
        "order_id,market,pkg_id,meals_count,order_date,order_id",
    ],
)
def test_other_columns_stop_the_job(spark, mode, tmp_path, header, mark):
    values = ",".join("1" for _ in header.split(","))
    with pytest.raises(ValueError, match="wanted are"):
        read_csv(spark, written(tmp_path, f"{mark}{header}\n{values}\n"), schemas.STAGING_USAGE)


def test_files_with_different_headers_stop_the_job(spark, tmp_path):
    (tmp_path / "a.csv").write_text("meals_count,recommended_pkg_id\n2,P-S\n")
    (tmp_path / "b.csv").write_text("recommended_pkg_id,meals_count\nP-M,4\n")
    with pytest.raises(Exception, match="(?i)header"):
        read_csv(spark, str(tmp_path), schemas.STAGING_STANDARDS).collect()


def test_values_are_not_rounded_in(spark, tmp_path):
    text = "pkg_id,pkg_name,material_type,surface_area,unit_of_measure,status\nA,B,M,1.23456,m2,Active\n"
    with pytest.raises(Exception, match="too many decimal places"):
        read_csv(spark, written(tmp_path, text), schemas.STAGING_PACKAGING).collect()


def test_layer_name():
    assert layers.layer_name("staging", "public") == "staging"
    assert layers.layer_name(None, "public") == "public"


def test_build_of_both_layers(spark, seed_folder):
    for _ in range(2):  # a second build replaces the first
        tables = build_layers(spark, seed_folder)
    assert spark.table("staging.fact_box_usage").count() == 9
    assert spark.table("transform.fact_box_usage").count() == 8
    columns, rows = CHECKS["q02_total_cost_per_market"]
    for opened in (tables, open_layers(spark)):
        assert_rows(REPORTS["q02_total_cost_per_market"](opened), columns, rows)


def test_default_layer(spark, seed_tables):
    layers.save_tables(spark, {"fact_box_usage": seed_tables.usage}, None, default="plain")
    frames = layers.load_tables(
        spark, {"fact_box_usage": schemas.STAGING_USAGE}, None, default="plain"
    )
    assert frames["fact_box_usage"].count() == 8


def test_files_hold_dates_in_order(spark, tmp_path):
    rows = [(n, "DE", "P-S", 2, date(2026, 1, 1 + n * 7 % 28), 0) for n in range(100)]
    usage = spark.createDataFrame(rows, schemas.STAGING_USAGE)
    layers.save_files({"fact_box_usage": usage}, str(tmp_path))
    frames = layers.load_files(spark, {"fact_box_usage": schemas.STAGING_USAGE}, str(tmp_path))
    days = [row["order_date"] for row in frames["fact_box_usage"].collect()]
    assert len(days) == 100 and days == sorted(days)


def test_a_month_has_as_many_files_as_its_bytes_need(spark, tmp_path):
    """One month has nearly all rows: it is cut to files of the advised size. Another is only cut
    if it is in the same partition, and then as often."""
    hot = [(n, "DE", f"box {n * 7919 % 10007}", 2, date(2026, 1, 1 + n % 28), 0) for n in range(40_000)]
    rows = hot + [(n, "DE", "P-S", 2, date(2025, 1 + n % 12, 1), 0) for n in range(600)] + [(1, "DE", "P-S", 2, None, 0)]
    usage = spark.createDataFrame(rows, schemas.STAGING_USAGE).repartition(8)
    name = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(name)
    spark.conf.set(name, "100k")
    try:
        layers.save_files({"fact_box_usage": usage}, str(tmp_path))
    finally:
        spark.conf.set(name, before)
    files = {folder.name: len(list(folder.glob("*.parquet"))) for folder in (tmp_path / "fact_box_usage").iterdir() if folder.is_dir()}
    pieces = files.pop("order_month=2026-01-01")
    assert 3 <= pieces < 40
    assert len(files) == 13 and set(files.values()) <= {1, pieces}
    assert list(files.values()).count(1) >= 7
    frames = layers.load_files(spark, {"fact_box_usage": schemas.STAGING_USAGE}, str(tmp_path))
    read = frames["fact_box_usage"]
    assert read.count() == len(rows)
    assert read.filter("order_month is null").count() == 1


def test_shared_folder_is_the_one_the_session_names(spark):
    assert layers.shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")


@pytest.mark.skipif(not Path(SMALL).is_dir(), reason="no test data")
def test_shuffled_joins_of_the_sources_give_the_same_rows(spark):
    """With no table within the broadcast limit, every join sorts and merges."""
    broadcast = OrderTables(spark, SMALL)
    merged = OrderTables(spark, SMALL, broadcast_limit=0)
    assert "SortMergeJoin" not in plan_of(broadcast.usage())
    assert "BroadcastHashJoin" not in plan_of(merged.usage())
    for make in (OrderTables.usage, OrderTables.rates):
        wanted, got = make(broadcast), make(merged)
        assert got.count() == wanted.count() > 0
        assert got.exceptAll(wanted).isEmpty()


@pytest.mark.skipif(not Path(SMALL).is_dir(), reason="no test data")
def test_lookups_with_small_partitions_are_hashed_not_sorted(spark, monkeypatch):
    """Lookups beyond a broadcast, that cannot be packed, but whose partitions are small."""
    monkeypatch.setattr(order_source, "names_to_pack", lambda *args: [])
    wanted = OrderTables(spark, SMALL).usage()
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "100")
    try:
        got = OrderTables(spark, SMALL, broadcast_limit=2_000).usage()
        plan = plan_of(got)
        assert plan.split("\n\n")[0].count("ShuffledHashJoin") == 3 and "SortMergeJoin" not in plan
        assert got.count() == wanted.count() > 0
        assert got.exceptAll(wanted).isEmpty()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.skipif(not Path(SMALL).is_dir(), reason="no test data")
def test_lookups_beyond_a_broadcast_are_packed(spark):
    """Customers, parts and orders are: the lines are not shuffled, and the rows are the same."""
    plain, tight = OrderTables(spark, SMALL), OrderTables(spark, SMALL, broadcast_limit=2_000)
    for make in (OrderTables.usage, OrderTables.rates):
        wanted, got = make(plain), make(tight)
        assert got.count() == wanted.count() > 0
        assert got.exceptAll(wanted).isEmpty()
    assert all(tight._sizes[table] > 2_000 for table in ("customer", "part", "orders"))
    assert "SortMergeJoin" not in plan_of(tight.usage()) and "ShuffledHashJoin" not in plan_of(tight.usage())


def _joined_both_ways(spark, pairs, keys, limit=10_000_000):
    lookup = spark.createDataFrame(pairs, "number bigint, name string")
    frame = spark.createDataFrame([(at, key) for at, key in enumerate(keys)], "at int, key bigint")
    wanted = frame.join(lookup, F.col("key") == F.col("number")).select("at", "key", "name")
    names = names_to_pack(lookup, "number", "name", limit)
    if not names:
        return names, None, None
    got = with_packed(frame, packed(lookup, "number", "name", names), F.col("key"), "name", names)
    return names, sorted(map(str, got.select("at", "key", "name").collect())), sorted(map(str, wanted.collect()))


@pytest.mark.parametrize("kinds", [3, 15, 16, 250])
def test_packed_names_are_those_of_a_plain_join(spark, kinds):
    """Negative and huge numbers, gaps, nulls on both sides, a null name, blocks without words."""
    numbers = [*range(-2100, 2100, 3), 2**62, -(2**62), 2**63 - 1, -(2**63), 1023, 1024, 5_000_000]
    numbers = list(dict.fromkeys(numbers))
    pairs = [(n, None if at % kinds == 1 else f"name {at % kinds}") for at, n in enumerate(numbers)] + [(None, "name 0")]
    names, got, wanted = _joined_both_ways(spark, pairs, [*numbers, *range(-2200, 2200), 7_000_000, None, 1, 1])
    assert len(names) == kinds and got == wanted and len(got) > len(numbers)


def test_lookups_that_cannot_be_packed_are_told(spark):
    some = [(n, "a") for n in range(3000)]
    assert names_of(spark, some) == ["a"]
    assert names_of(spark, [*some, (7, "b")]) == []
    assert names_of(spark, [(n, f"name {n}") for n in range(256)]) == []
    assert names_of(spark, [(n * 1_000_003, "a") for n in range(3000)], limit=100_000) == []
    assert names_of(spark, []) == []


def names_of(spark, pairs, limit=10_000_000):
    return names_to_pack(spark.createDataFrame(pairs, "number bigint, name string"), "number", "name", limit)


def test_usage_is_merged_and_laid_out_by_one_shuffle(spark, tmp_path, monkeypatch):
    """Repeats in several files, rows with nulls, a month in slices and an order id of many rows."""
    rows = [(n % 900 or None, "DE", f"box {n % 7}" if n % 5 else None, n % 3, date(2026, 1, 1 + n % 28), 0) for n in range(4_000)]
    rows += [(1, None, "P-S", 2, None, None), (1, None, "P-S", 2, None, 1), (2, "UK", "P-S", None, date(2025, 3, 1), 1)]
    usage = spark.createDataFrame(rows * 2 + rows[:50], schemas.STAGING_USAGE)
    monkeypatch.setattr(layers, "ROWS_PER_SLICE", 3_000)
    merged = layers.merged_by_month(usage, len(rows) * 2)
    tree = plan_of(layers.laid_out("fact_box_usage", merged)).split("\n\n")[0].splitlines()
    assert sum("Exchange" in line for line in tree) == sum(" Sort" in line for line in tree) == 1
    layers.save_files({"fact_box_usage": merged}, str(tmp_path))
    read = layers.load_files(spark, {"fact_box_usage": schemas.STAGING_USAGE}, str(tmp_path))["fact_box_usage"]
    wanted = usage.distinct()
    assert read.count() == wanted.count() and read.drop("order_month").exceptAll(wanted).isEmpty()
    folders = {folder.name: len(list(folder.glob("*.parquet"))) for folder in (tmp_path / "fact_box_usage").iterdir() if folder.is_dir()}
    assert len(folders) == 3 and max(folders.values()) <= 3


class _Session:
    """A session that names no folder."""

    class conf:
        @staticmethod
        def get(name, default):
            return default


def test_no_folder_of_one_machine():
    assert layers.shared_folder(_Session()) is None


class _Cluster:
    """A session of several machines, in all that is asked here."""

    def __init__(self, spark):
        self._spark = spark
        self.read, self.sparkContext, self._jvm, self._jsc = spark.read, spark.sparkContext, spark._jvm, spark._jsc

    class conf:
        @staticmethod
        def get(name, default=None):
            return "spark://somewhere:7077" if name == "spark.master" else default


def test_folders_are_probed_before_a_build(spark, tmp_path, monkeypatch):
    cluster = _Cluster(spark)
    written = []

    def write(session, folder):
        written.append(folder)
        spark.range(layers.PROBE_TASKS, numPartitions=layers.PROBE_TASKS).write.parquet(folder)

    monkeypatch.setattr(layers, "_write_probe", write)
    for _ in range(2):  # once for each application and folder
        layers.require_shared(cluster, f"{tmp_path}/shared", "spark.checkpoint.dir")
    assert len(written) == 1 and not Path(written[0]).exists()
    # What other machines wrote into folders of their own is not found here.
    monkeypatch.setattr(layers, "_write_probe", lambda session, folder: spark.range(3).coalesce(1).write.parquet(folder))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir names .* all machines share"):
        layers.require_shared(cluster, f"file:{tmp_path}/own", "spark.checkpoint.dir")
    # One machine alone needs no probe.
    layers.require_shared(spark, f"{tmp_path}/alone", "spark.checkpoint.dir")


def test_no_tables_beside_the_program():
    session = _Session()
    session.conf.get = lambda name, default: f"file:{os.getcwd()}/spark-warehouse"
    with pytest.raises(RuntimeError, match="spark.sql.warehouse.dir"):
        layers.save_tables(session, {})


@pytest.fixture
def own_source(tmp_path):
    """A copy of the small source, whose files a test may change."""
    folder = tmp_path / "source"
    folder.mkdir()
    for name in order_source.SOURCE_TABLES:
        # Without the mode of the original, which may be read-only.
        shutil.copyfile(f"{SMALL}/{name}.parquet", folder / f"{name}.parquet")
    return folder


@pytest.mark.skipif(not Path(SMALL).is_dir(), reason="no test data")
def test_layer_is_reused_until_the_source_changes(spark, own_source, monkeypatch):
    builds = []
    save = order_source.save_files
    monkeypatch.setattr(order_source, "save_files", lambda *args: (builds.append(args[1]), save(*args)))
    first = order_source.transform_tables(spark, str(own_source))
    again = order_source.transform_tables(spark.newSession(), str(own_source))
    assert len(builds) == 1 and first.facts == again.facts
    lines = parquet.read_table(own_source / "lineitem.parquet")
    parquet.write_table(lines.slice(0, len(lines) // 2), own_source / "lineitem.parquet")
    changed = order_source.transform_tables(spark, str(own_source))
    assert len(builds) == 2
    assert changed.usage.count() < first.usage.count()


@pytest.mark.skipif(not Path(SMALL).is_dir(), reason="no test data")
def test_unfinished_layer_is_not_used(spark, own_source, monkeypatch):
    def fails(frames, folder):
        raise OSError("lost")

    with monkeypatch.context() as patch:
        patch.setattr(order_source, "save_files", fails)
        with pytest.raises(OSError):
            order_source.transform_tables(spark, str(own_source))
    assert order_source.transform_tables(spark, str(own_source)).usage.count() > 0


@pytest.mark.skipif(not Path(SMALL).is_dir(), reason="no test data")
def test_facts_of_a_layer_are_what_its_rows_say(spark):
    stored = order_source.transform_tables(spark, SMALL)
    found = Tables.from_frames(stored.frames()).measured()
    assert found == {name: stored.facts[name] for name in found}
    assert set(stored.facts) - set(found) == {"layer", "number", "identity"}


@pytest.mark.skipif(not Path(SMALL).is_dir(), reason="no test data")
def test_planning_a_report_starts_no_job(spark):
    tables = order_source.transform_tables(spark, SMALL)
    spark.sparkContext.setJobGroup("planning", "planning")
    for report in REPORTS.values():
        report(tables)
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("planning")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert list(jobs) == []


@pytest.mark.skipif(not Path(SMALL).is_dir(), reason="no test data")
@pytest.mark.parametrize("name", ["q02_total_cost_per_market", "q03b_overboxing_by_market"])
def test_without_a_folder_reports_compute_from_the_source(spark, name, monkeypatch):
    wanted = REPORTS[name](order_source.transform_tables(spark, SMALL)).collect()
    monkeypatch.setattr(order_source, "shared_folder", lambda session: None)
    assert REPORTS[name](order_source.transform_tables(spark, SMALL)).collect() == wanted
