"""The two table sets every plan works on."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from datetime import date
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from boxmetrics.operators.sizing import BROADCAST_LIMIT_BYTES, fits, measured_bytes

_FIELDS = {
    "dim_packaging_master": "packaging",
    "dim_packaging_standards": "standards",
    "dim_procurement_cost": "rates",
    "fact_box_usage": "usage",
}


# What is stored beside a layer, so that planning a report reads none of its rows.
FACTS = T.StructType(
    [
        T.StructField("layer", T.StringType()),
        T.StructField("first_day", T.DateType()),
        T.StructField("last_day", T.DateType()),
        T.StructField("order_ids_complete", T.BooleanType()),
        T.StructField("box", T.LongType()),
        T.StructField("standard", T.LongType()),
        T.StructField("recommendation", T.LongType()),
        T.StructField("known_recommendation", T.LongType()),
        T.StructField("rates", T.LongType()),
        T.StructField("calendar", T.LongType()),
    ]
)


@dataclass(frozen=True)
class Staging:
    """Raw tables as they were delivered."""

    packaging: DataFrame
    standards: DataFrame
    rates: DataFrame
    usage: DataFrame

    @classmethod
    def from_frames(cls, frames: Mapping[str, DataFrame]) -> Staging:
        return cls(**{field: frames[name] for name, field in _FIELDS.items()})

    def frames(self) -> dict[str, DataFrame]:
        return {name: getattr(self, field) for name, field in _FIELDS.items()}


@dataclass(frozen=True)
class ByOrder:
    """Usage once more, without rows that have no order id: in buckets by it, but for the rows
    of hot orders, of which there are few orders and any number of rows."""

    usage: DataFrame
    of_hot_orders: DataFrame


@dataclass(frozen=True)
class Tables:
    """Cleaned tables, with the lookups derived from the three dimensions.

    A lookup is broadcast only if its measured size is within `broadcast_limit`. Sizes and
    the facts about usage come from `facts`, as `measured` gave them when the layer was
    written. Without these each is found once per `Tables`, by one aggregate. They hold for
    the tables as they are: after a rebuild of a layer, make a new `Tables`.
    """

    packaging: DataFrame
    standards: DataFrame
    rates: DataFrame
    usage: DataFrame
    broadcast_limit: int = BROADCAST_LIMIT_BYTES
    facts: Mapping[str, object] | None = None
    by_order: ByOrder | None = None

    @classmethod
    def from_frames(cls, frames: Mapping[str, DataFrame], **options: object) -> Tables:
        return cls(**{field: frames[name] for name, field in _FIELDS.items()}, **options)

    def frames(self) -> dict[str, DataFrame]:
        return {name: getattr(self, field) for name, field in _FIELDS.items()}

    def measured(self) -> dict[str, object]:
        """All facts, found from the rows; a calendar of rates that do not fit has no size."""
        first, last = self.dates_seen
        rates = measured_bytes(self.rates_in_use)
        return {
            "first_day": first,
            "last_day": last,
            "order_ids_complete": self.order_ids_complete,
            "box": measured_bytes(self._boxes()),
            "standard": measured_bytes(self._standards()),
            "recommendation": measured_bytes(self._recommended("left")),
            "known_recommendation": measured_bytes(self._recommended("inner")),
            "rates": rates,
            "calendar": measured_bytes(self.rate_calendar) if rates <= self.broadcast_limit else None,
        }

    def _fits(self, frame: DataFrame, fact: str) -> bool:
        if self.facts is None:
            return fits(frame, self.broadcast_limit)
        size = self.facts[fact]
        return size is not None and size <= self.broadcast_limit

    def _lookup(self, frame: DataFrame, fact: str) -> DataFrame:
        return F.broadcast(frame) if self._fits(frame, fact) else frame.hint("merge")

    def _boxes(self) -> DataFrame:
        return self.packaging.select(
            "pkg_id",
            "pkg_name",
            "material_type",
            F.col("status").alias("pkg_status"),
            "surface_area",
            F.col("surface_area_m2_normalised").alias("actual_area_m2"),
        )

    def _standards(self) -> DataFrame:
        return self.standards.select("meals_count", "recommended_pkg_id")

    @cached_property
    def box_lookup(self) -> DataFrame:
        """`pkg_id` to the facts about the box that was used."""
        return self._lookup(self._boxes(), "box")

    @cached_property
    def standard_lookup(self) -> DataFrame:
        """`meals_count` to the recommended box id."""
        return self._lookup(self._standards(), "standard")

    def _recommended(self, how: str) -> DataFrame:
        recommended = self.packaging.select(
            F.col("pkg_id").alias("recommended_pkg_id"),
            F.col("pkg_name").alias("recommended_pkg_name"),
            F.col("surface_area_m2_normalised").alias("recommended_area_m2"),
        )
        return self._standards().join(recommended, "recommended_pkg_id", how)

    # Standards and recommended boxes are joined to each other first, so that usage needs
    # one lookup for both. Joins are associative here, so the rows are the same.
    @cached_property
    def recommendation_lookup(self) -> DataFrame:
        """`meals_count` to the recommended box; standards without a known box stay."""
        return self._lookup(self._recommended("left"), "recommendation")

    @cached_property
    def known_recommendation_lookup(self) -> DataFrame:
        """`meals_count` to the recommended box; standards without a known box drop out."""
        return self._lookup(self._recommended("inner"), "known_recommendation")

    @cached_property
    def dates_seen(self) -> tuple[date | None, date | None]:
        """First and last order date in usage, null if it has none."""
        if self.facts is not None:
            return self.facts["first_day"], self.facts["last_day"]
        first, last = F.min("order_date"), F.max("order_date")
        return tuple(self.usage.agg(first.alias("first"), last.alias("last")).first())

    @cached_property
    def rates_in_use(self) -> DataFrame:
        """Rates with the part of their validity in which there is usage.

        An open-ended rate runs to the year 9999; the part in use is as short as usage.
        The contract's material is no part of the lookup.
        """
        first, last = (F.lit(day).cast("date") for day in self.dates_seen)
        return self.rates.select(
            F.col("market").alias("rate_market"),
            F.greatest("valid_from", first).alias("first_day"),
            F.least("valid_to", last).alias("last_day"),
            "cost_per_m2",
            "currency",
            "cost_per_m2_eur",
        ).filter(
            F.col("valid_from").isNotNull()
            & F.col("valid_to").isNotNull()
            & first.isNotNull()
            & (F.col("first_day") <= F.col("last_day"))
        )

    @cached_property
    def rate_calendar(self) -> DataFrame:
        """One row per rate and day, which makes the lookup a plain equality."""
        days = F.sequence("first_day", "last_day")
        calendar = self.rates_in_use.withColumn("rate_date", F.explode(days))
        return calendar.drop("first_day", "last_day")

    @cached_property
    def calendar_fits(self) -> bool:
        """Whether the calendar can be broadcast; `with_rate` has another way if not."""
        return self._fits(self.rates_in_use, "rates") and self._fits(self.rate_calendar, "calendar")

    @cached_property
    def order_ids_complete(self) -> bool:
        """Whether every usage row has an order id.

        On Parquet this reads statistics only: no row group without nulls is opened.
        """
        if self.facts is not None:
            return self.facts["order_ids_complete"]
        return self.usage.filter(F.col("order_id").isNull()).isEmpty()
