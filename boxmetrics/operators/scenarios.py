"""Expansion of rows: over a grid of assumptions, and into a number of copies."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def over_grid(frame: DataFrame, grid: Sequence[Mapping[str, object]]) -> DataFrame:
    """Repeat every row of a small frame for each point of the grid, without a join."""
    points = [
        F.struct(*[F.lit(value).alias(name) for name, value in point.items()]) for point in grid
    ]
    return frame.select("*", F.inline(F.array(*points)))


_COPIES_AT_ONCE = 65_536


def in_copies(frame: DataFrame, copies: str, number: str = "copy") -> DataFrame:
    """Repeat every row as often as its column `copies` says; `number` tells the copies apart.

    Copies are made in runs, so that no row needs an array as long as its number of copies.
    Nearly all rows have one run.
    """
    copy, step, zero = F.col(copies), F.lit(_COPIES_AT_ONCE), F.lit(0).cast("bigint")
    several = F.sequence(zero, F.floor((copy - 1) / step))
    runs = F.when(copy <= step, F.array(zero)).otherwise(several)
    first = F.col("run") * step
    each = F.sequence(first, F.least(first + step, copy) - 1)
    return (
        frame.filter(copy > 0)
        .withColumn("run", F.explode(runs))
        .withColumn(number, F.explode(each))
        .drop("run", copies)
    )
