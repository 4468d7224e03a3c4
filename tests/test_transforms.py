"""The four cleaning steps."""

from __future__ import annotations

from datetime import date
from decimal import Decimal

from boxmetrics import transforms
from tests.helpers import staging_of

DAY = date(2026, 1, 1)


def test_units(seed_tables):
    areas = {row["pkg_id"]: row["surface_area_m2_normalised"] for row in seed_tables.packaging.collect()}
    assert areas == {
        "P-S": Decimal("0.55"),
        "P-M": Decimal("0.85"),
        "P-L": Decimal("1.3"),
        "P-XL": Decimal("1.85"),
    }


def test_currencies(seed_tables):
    rates = {
        (row["market"], row["valid_from"].year): row["cost_per_m2_eur"]
        for row in seed_tables.rates.collect()
    }
    assert rates == {
        ("DE", 2025): Decimal("1.15"),
        ("DE", 2026): Decimal("1.75"),
        ("UK", 2025): Decimal("1.287"),
        ("NL", 2025): Decimal("1.25"),
    }


def test_every_digit_survives_conversion(spark):
    staging = staging_of(
        spark,
        packaging=[("A", "A", "M", Decimal("8512.3456"), "cm2", "Active")],
        rates=[("UK", "M", Decimal("1.2345"), "GBP", DAY, DAY)],
    )
    [box] = transforms.packaging_master(staging.packaging).collect()
    [rate] = transforms.procurement_cost(staging.rates).collect()
    assert box["surface_area_m2_normalised"] == Decimal("0.85123456")
    assert rate["cost_per_m2_eur"] == Decimal("1.444365")


def test_other_units_and_currencies_pass_through(spark):
    staging = staging_of(
        spark,
        packaging=[
            ("A", "A", "M", Decimal("3"), "sqft", "Active"),
            ("B", "B", "M", Decimal("4"), None, "Active"),
        ],
        rates=[
            ("US", "M", Decimal("2"), "USD", DAY, DAY),
            ("XX", "M", Decimal("5"), None, DAY, DAY),
        ],
    )
    boxes = transforms.packaging_master(staging.packaging).collect()
    rates = transforms.procurement_cost(staging.rates).collect()
    assert {row["surface_area_m2_normalised"] for row in boxes} == {3, 4}
    assert {row["cost_per_m2_eur"] for row in rates} == {2, 5}


def test_exchange_rate_is_a_parameter(spark):
    staging = staging_of(spark, rates=[("UK", "M", Decimal("2"), "GBP", DAY, DAY)])
    [rate] = transforms.procurement_cost(staging.rates, Decimal("1.2")).collect()
    assert rate["cost_per_m2_eur"] == Decimal("2.4")


def test_only_exact_repeats_go(spark):
    box = ("A", "A", "M", Decimal("3"), "m2", "Active")
    rate = ("UK", "M", Decimal("2"), "GBP", DAY, DAY)
    order = (1, "UK", None, 2, DAY, 0)
    staging = staging_of(
        spark,
        packaging=[box, box],
        standards=[(2, "A"), (2, "A"), (2, "B")],
        rates=[rate, rate, (*rate[:5], date(2026, 2, 1))],
        usage=[order, order, (*order[:5], 1)],
    )
    built = transforms.build_transform(staging)
    counts = {name: frame.count() for name, frame in built.frames().items()}
    assert counts == {
        "dim_packaging_master": 2,  # the box master keeps its repeats
        "dim_packaging_standards": 2,
        "dim_procurement_cost": 2,
        "fact_box_usage": 2,
    }
