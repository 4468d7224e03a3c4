"""Lookups of one name by a whole number, packed for a broadcast.

A row of a hash table takes some sixty bytes. Numbers that lie close to each other take a few
bits each if those of a block are kept side by side: words of 64 bits hold the places of the
names in a list of all names, 0 where there is no such number. A block is a row of the lookup.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxmetrics.operators.sizing import row_bytes

#: Numbers of a block, as a power of two.
BLOCK_BITS = 10
_WORD_BITS = 64
MOST_NAMES = 255


def _bits(names: Sequence[str | None]) -> int:
    return 4 if len(names) < 16 else 8


def _words(bits: int) -> int:
    return (bits << BLOCK_BITS) // _WORD_BITS


def _block(number: Column) -> Column:
    return F.shiftright(number.cast("bigint"), BLOCK_BITS)


def _place(number: Column, bits: int) -> tuple[Column, Column]:
    """The word within the block, from 0, and the first bit within the word."""
    within = number.cast("bigint").bitwiseAND(F.lit((1 << BLOCK_BITS) - 1)) * bits
    word = F.floor(within / _WORD_BITS)
    return word.cast("int"), (within % _WORD_BITS).cast("int")


def _in_words(lookup: DataFrame, number: str, name: str, names: Sequence[str | None]) -> DataFrame:
    """A row per block and word with some number in it, and whether no number comes twice."""
    bits = _bits(names)
    place = F.lit(None).cast("bigint")
    for at, one in enumerate(names, 1):
        place = F.when(F.col(name).eqNullSafe(F.lit(one)), F.lit(at).cast("bigint")).otherwise(place)
    word, first = _place(F.col(number), bits)
    rows = lookup.filter(F.col(number).isNotNull()).select(
        _block(F.col(number)).alias("block"),
        word.alias("word"),
        F.call_function("shiftleft", place, first).alias("bits"),
        F.call_function("shiftleft", F.lit(1).cast("bigint"), first).alias("seen"),
    )
    return (
        rows.groupBy("block", "word")
        .agg(F.bit_or("bits").alias("bits"), F.bit_or("seen").alias("seen"), F.count("*").alias("n"))
        .withColumn("unique", F.bit_count("seen") == F.col("n"))
    )


def names_to_pack(lookup: DataFrame, number: str, name: str, limit: int) -> list[str | None]:
    """All names, if the lookup can be packed within the limit, or else none."""
    found = lookup.select(name).distinct().limit(MOST_NAMES + 1).collect()
    names = sorted((row[0] for row in found), key=lambda one: (one is not None, one))
    if not names or len(names) > MOST_NAMES:
        return []
    blocks = _in_words(lookup, number, name, names).groupBy("block").agg(F.min("unique").alias("unique"))
    seen = blocks.agg(F.count("*").alias("n"), F.min("unique").alias("unique")).first()
    size = seen["n"] * (row_bytes(2) + 8 * _words(_bits(names)))
    return names if seen["unique"] and size <= limit else []


def packed(lookup: DataFrame, number: str, name: str, names: Sequence[str | None]) -> DataFrame:
    """A row per block, with all its words."""
    of_word = F.map_from_entries(F.collect_list(F.struct("word", "bits")))
    blocks = _in_words(lookup, number, name, names).groupBy("block").agg(of_word.alias("of_word"))
    every = F.sequence(F.lit(0), F.lit(_words(_bits(names)) - 1))
    words = F.transform(every, lambda word: F.coalesce(F.get(F.map_values("of_word"), F.array_position(F.map_keys("of_word"), word).cast("int") - 1), F.lit(0).cast("bigint")))
    return blocks.select("block", words.alias("words"))


def with_packed(frame: DataFrame, blocks: DataFrame, key: Column, name: str, names: Sequence[str | None]) -> DataFrame:
    """Join the names by number; rows whose number is not there drop out."""
    bits = _bits(names)
    word, first = _place(key, bits)
    found = F.get("words", word)
    place = F.call_function("shiftrightunsigned", found, first).bitwiseAND(F.lit((1 << bits) - 1))
    listed = F.array(*[F.lit(one).cast("string") for one in names])
    return (
        frame.join(F.broadcast(blocks), _block(key) == F.col("block"))
        .withColumn("place", place.cast("int"))
        .filter(F.col("place") > 0)
        .withColumn(name, F.get(listed, F.col("place") - 1))
        .drop("block", "words", "place")
    )
