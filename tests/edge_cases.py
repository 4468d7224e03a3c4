"""Rows that the sample and the test tables do not have (FIXTURES.md section 5)."""

from __future__ import annotations

import random
from datetime import date, timedelta
from decimal import Decimal

D = Decimal

PACKAGING = [
    ("P-S", "Small Box", "Recycled Paper", D("0.5"), "m2", "Active"),
    ("P-M", "Medium Box", "Corrugated", D("8500"), "cm2", "Active"),
    ("P-L", "Large Box", "Corrugated", D("1.3"), "m2", "Active"),
    ("P-XL", "Extra Large", "Cardboard", D("1.85"), "m2", "Discontinued"),
    ("P-S+", "Small Box Plus", "Cardboard", D("0.6"), "m2", "Active"),  # ratio 1.2 to P-S
    ("P-S++", "Small Box Double Plus", None, D("0.75"), "m2", "Discontinued"),  # ratio 1.5
    ("P-IN", "Odd Unit", "Corrugated", D("2"), "sqft", "Active"),
    ("P-TWO", "Listed Twice", "Corrugated", D("1.1"), "m2", "Discontinued"),
    ("P-TWO", "Listed Twice", "Corrugated", D("1.2"), "m2", "Active"),
    ("P-NN", None, "Corrugated", D("0.9"), "m2", "Active"),
]

STANDARDS = [
    (2, "P-S"),
    (4, "P-M"),
    (6, "P-L"),
    (8, "P-L"),
    (8, "P-XL"),  # two standards for one number of meals
    (10, "P-GONE"),  # a box the master does not know
    (14, None),
]

RATES = [
    ("DE", "Recycled Paper", D("1.15"), "EUR", date(2025, 1, 1), date(2025, 12, 31)),
    ("DE", "Recycled Paper", D("1.75"), "EUR", date(2026, 1, 1), date(9999, 12, 31)),
    ("UK", "Corrugated", D("1.1"), "GBP", date(2025, 1, 1), date(9999, 12, 31)),
    ("NL", "Corrugated", D("1.25"), "EUR", date(2025, 1, 1), date(2026, 2, 10)),
    ("NL", "Cardboard", D("1.4"), "EUR", date(2026, 2, 1), date(9999, 12, 31)),  # overlaps
    ("US", "Corrugated", D("2"), "USD", date(2025, 6, 1), date(2025, 6, 30)),
]

_MARKETS = ["DE", "DE", "DE", "UK", "NL", "US", "FR", None]
_BOXES = ["P-S", "P-M", "P-L", "P-XL", "P-S+", "P-S++", "P-IN", "P-TWO", "P-NN", "P-?", None]
_MEALS = [2, 2, 4, 6, 8, 10, 12, 14]
_DAYS = [date(2025, 12, 31), date(2026, 1, 1), date(2026, 3, 31), date(2026, 4, 1)]


def usage(rows: int = 600, seed: int = 7) -> list[tuple]:
    """Random rows over all the cases. A third has one order id, and many ids repeat."""
    chance = random.Random(seed)
    result = []
    for _ in range(rows):
        order_id = 9005 if chance.random() < 1 / 3 else chance.randrange(1, 250)
        day = chance.choice([*_DAYS, date(2025, 1, 1) + timedelta(chance.randrange(730))])
        result.append(
            (
                order_id,
                chance.choice(_MARKETS),
                chance.choice(_BOXES),
                chance.choice(_MEALS),
                day,
                chance.randrange(2),
            )
        )
    return result + result[:40]
