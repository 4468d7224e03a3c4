"""How five text filters interact, over all orders in which they may be applied.

What a document fails does not depend on the order, so each document becomes a set of failed
filters, found in one pass over its bytes (`transducer`). Documents are counted per part, set
and label; all figures of all orders follow from these counts. In an order, a document is
removed at the first of its failed filters, so a step depends only on its filter and on which
filters stand before it: 80 cases, each of which several orders share.

A text is known by its SHA-256 in the search for earlier copies. Counts are merged before each
shuffle, so that neither a large part nor a large group of copies meets in one task.
"""

from __future__ import annotations

from itertools import combinations, permutations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxmetrics.llm.common import small_or_merged, stored
from boxmetrics.llm.transducer import counted

FILTERS = "ABCDE"
ORDERS = 120

# The limits of the filters.
LEAST_WORDS = 200
LEAST_DISTINCT_PERCENT = 50
MOST_CAPITALS_PERCENT = 2

_COUNTS = ("n_words", "n_distinct", "n_capitals", "n_points", "n_symbols")
_SUMS = ("documents", "good", "toxic")


def text_counts(text: Column) -> Column:
    """Words, distinct words, capitals, code points and symbols of each text."""

    @F.arrow_udf("struct<" + ", ".join(f"{name}: bigint" for name in _COUNTS) + ">")
    def measured(texts: pa.Array) -> pa.Array:
        columns = counted(texts).T
        return pa.StructArray.from_arrays([pa.array(column) for column in columns], names=list(_COUNTS))

    return measured(text)


def failures(counts: Column) -> Column:
    """The filters A to D that a text fails, as a set of bits."""
    failed = {
        "A": counts["n_words"] < LEAST_WORDS,
        "B": counts["n_distinct"] * 100 < counts["n_words"] * LEAST_DISTINCT_PERCENT,
        "C": counts["n_capitals"] * 100 > counts["n_points"] * MOST_CAPITALS_PERCENT,
        "D": counts["n_symbols"] > 0,
    }
    return sum((F.when(test, F.lit(_bit(name))).otherwise(0) for name, test in failed.items()), F.lit(0))


def _bit(name: str) -> int:
    return 1 << FILTERS.index(name)


def marked(documents: DataFrame) -> DataFrame:
    """Documents without their text: `doc_id`, `part`, `digest`, `failed` (A to D), and how many
    equal rows there are of each (`copies`)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(text, 256)).alias("digest"),
        text_counts(text).alias("counts"),
    )
    return (
        rows.select("doc_id", "part", "digest", failures(F.col("counts")).cast("int").alias("failed"))
        .groupBy("doc_id", "part", "digest", "failed")
        .agg(F.count("*").alias("copies"))
    )


def _flags(labels: DataFrame) -> DataFrame:
    """Ids with a label of quality 1 or toxic 1."""
    good, toxic = F.max((F.col("quality") == 1).cast("int")), F.max((F.col("toxic") == 1).cast("int"))
    return (
        labels.filter(F.col("doc_id").isNotNull())
        .groupBy(F.col("doc_id").cast("long").alias("labelled"))
        .agg(F.coalesce(good, F.lit(0)).alias("is_good"), F.coalesce(toxic, F.lit(0)).alias("is_toxic"))
        .filter("is_good + is_toxic > 0")
    )


def failure_counts(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, failed, documents, good, toxic): documents per set of failed filters A to E."""
    rows = stored(marked(documents), "marked")
    named, unnamed = rows.filter(F.col("doc_id").isNotNull()), rows.filter(F.col("doc_id").isNull())
    # Only texts that several ids share need to know which of them is the first.
    shared = stored(
        named.groupBy("digest")
        .agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"))
        .filter("first_id < last_id")
        .select(F.col("digest").alias("shared"), "first_id"),
        "shared",
    )
    later = named.join(small_or_merged(shared), F.col("digest") == F.col("shared"), "left")
    copied = F.coalesce(F.col("first_id") < F.col("doc_id"), F.lit(False))
    known = later.select(
        "doc_id",
        "part",
        "copies",
        (F.col("failed") + F.when(copied, F.lit(_bit("E"))).otherwise(0)).alias("failed"),
    )
    flagged = known.join(
        small_or_merged(stored(_flags(labels), "flags")), F.col("doc_id") == F.col("labelled"), "left"
    ).select(
        "part",
        "failed",
        "copies",
        F.coalesce("is_good", F.lit(0)).alias("is_good"),
        F.coalesce("is_toxic", F.lit(0)).alias("is_toxic"),
    )
    # A row without an id has no label, and none is smaller than it.
    others = unnamed.select("part", "failed", "copies", F.lit(0).alias("is_good"), F.lit(0).alias("is_toxic"))
    return (
        flagged.unionByName(others)
        .groupBy("part", "failed")
        .agg(
            F.sum("copies").alias("documents"),
            F.sum(F.col("copies") * F.col("is_good")).alias("good"),
            F.sum(F.col("copies") * F.col("is_toxic")).alias("toxic"),
        )
    )


def steps() -> list[tuple[int, int, list[tuple[str, int]]]]:
    """(bits of the filters before, bit of the filter, [(order, step)]) for every case."""
    cases = []
    for name in FILTERS:
        rest = [other for other in FILTERS if other != name]
        for size in range(len(FILTERS)):
            for before in combinations(rest, size):
                behind = [other for other in rest if other not in before]
                orders = [
                    ("".join((*start, name, *end)), size + 1)
                    for start in permutations(before)
                    for end in permutations(behind)
                ]
                cases.append((sum(map(_bit, before)), _bit(name), orders))
    return cases


def audit(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step of it, rows of zeros included.

    Null and empty texts have no words, no characters and fail A alone, or as copies E too. A
    null source is the part of the empty name. A row without an id has no label, is no copy
    of others and others are none of it. Rows that repeat an id count each; equal texts under
    one id are not copies of each other. Several labels of an id count as the highest. An
    empty table has no parts, so no rows. Other columns are ignored.
    """
    every = steps()
    cases = F.array(*[F.struct(F.lit(before).alias("before"), F.lit(own).alias("own")) for before, own, _ in every])
    orders = F.array(
        *[
            F.array(*[F.struct(F.lit(order).alias("filter_order"), F.lit(step).alias("step")) for order, step in of_case])
            for _, _, of_case in every
        ]
    )
    failed, own = F.col("failed"), F.col("case.own")
    fails = failed.bitwiseAND(own) != 0
    came = failed.bitwiseAND(F.col("case.before")) == 0
    removed = fails & came
    # Each of the failed filters comes first in an equal share of the orders.
    share = F.call_function("div", F.lit(ORDERS), F.bit_count(failed))

    def total(condition: Column, value: str = "documents") -> Column:
        return F.sum(F.when(condition, F.col(value)).otherwise(F.lit(0))).cast("long")

    counts = stored(failure_counts(documents, labels), "counts")
    return (
        counts.select("*", F.posexplode(cases).alias("at", "case"))
        .groupBy("part", "at")
        .agg(
            total(~fails & came).alias("kept"),
            total(removed).alias("removed"),
            total(fails & ~came).alias("redundant"),
            total(failed == own).alias("unique_fails"),
            total(removed, "good").alias("good_lost"),
            total(removed, "toxic").alias("toxic_lost"),
            F.sum(F.when(fails, F.col("documents") * share).otherwise(F.lit(0))).cast("long").alias("shapley"),
        )
        .select("*", F.inline(orders[F.col("at")]))
        .select(
            "part",
            "filter_order",
            "step",
            "kept",
            "removed",
            "redundant",
            "unique_fails",
            "good_lost",
            "toxic_lost",
            "shapley",
        )
    )
