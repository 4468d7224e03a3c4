"""Column expressions by themselves."""

from __future__ import annotations

import math
import random
from decimal import Decimal
from fractions import Fraction

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from boxmetrics.functions import aggregates as agg
from boxmetrics.functions.cost import ideal_cost
from boxmetrics.functions.fit import BOX_LEVELS, box_level
from boxmetrics.operators.scenarios import in_copies


@pytest.mark.parametrize("scale", [1e-6, 1.0, 100.0, 1e8])
def test_average_of_quotients_is_exact_in_any_order(spark, scale):
    chance = random.Random(int(scale * 1e6))
    rows = [(chance.random() * scale, chance.random() + 0.01, chance.randrange(1, 10**9)) for _ in range(4000)]
    rows += [(None, 1.0, 5), (0.0, 1.0, 7)]
    exact = sum(Fraction(a / b) * n for a, b, n in rows if a is not None)
    wanted = float(exact / sum(n for a, _, n in rows if a is not None))
    found = set()
    for parts in (1, 3, 16):
        chance.shuffle(rows)
        frame = spark.createDataFrame(rows, "a double, b double, usage_rows bigint").repartition(parts)
        [row] = frame.agg(agg.mean_ratio(F.col("a") / F.col("b")).alias("mean")).collect()
        found.add(row["mean"])
    [mean] = found
    assert math.isclose(mean, wanted, rel_tol=1e-14)
    # What the plain average of doubles gives.
    plain = math.fsum(a / b * n for a, b, n in rows if a is not None) / sum(n for a, _, n in rows if a is not None)
    assert math.isclose(mean, plain, rel_tol=1e-12)


def test_average_of_no_quotients_is_null(spark):
    frame = spark.createDataFrame([(None, 3)], "a double, usage_rows bigint")
    assert frame.agg(agg.mean_ratio(F.col("a")).alias("mean")).first()["mean"] is None


def test_ideal_cost_without_a_standard(spark):
    frame = spark.createDataFrame(
        [(Decimal("2.00000000"), None, Decimal("1.500000")), (Decimal("2.00000000"), Decimal("1.00000000"), Decimal("1.500000"))],
        "actual_area_m2 decimal(16,8), recommended_area_m2 decimal(16,8), cost_per_m2_eur decimal(14,6)",
    )
    for policy, wanted in (("null", None), ("zero", Decimal(0)), ("actual", Decimal(3))):
        costs = [row["c"] for row in frame.select(ideal_cost(policy).alias("c")).collect()]
        assert costs == [wanted, Decimal("1.5")]


def test_box_level_cuts_the_name_out_once(spark):
    ids = ["P-S", "P-XL", "P-M/LARGE", "P-M/a/b", "P-S ", "", "/", "/P-S", "P-Z/P-S", "P", None]
    rows = spark.createDataFrame([(one,) for one in ids], "pkg_id string")
    leveled = rows.select("pkg_id", box_level(F.col("pkg_id")).alias("level"))
    wanted = {one: BOX_LEVELS.get(one.split("/")[0]) if one is not None else None for one in ids}
    assert dict(leveled.collect()) == wanted
    plan = leveled._jdf.queryExecution().executedPlan().toString()
    assert plan.count("substring_index(") + plan.count("stringsplitsql(") + plan.count("split_part(") == 1
    assert leveled.schema["level"].dataType == T.IntegerType()
    assert rows.select(box_level(F.col("pkg_id"), {}).alias("level")).distinct().collect() == [(None,)]


def test_copies_in_one_run_and_in_several(spark):
    rows = spark.createDataFrame([(n,) for n in (0, 1, 2, 65_535, 65_536, 65_537, 131_073)], "copies bigint")
    made = in_copies(rows.withColumn("of", F.col("copies")), "copies")
    found = made.groupBy("of").agg(F.count("*").alias("n"), F.countDistinct("copy").alias("d"), F.max("copy").alias("m"))
    assert {tuple(row) for row in found.collect()} == {(n, n, n, n - 1) for n in (1, 2, 65_535, 65_536, 65_537, 131_073)}
