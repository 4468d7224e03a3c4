"""Near duplicates by SimHash and covering locality-sensitive hashing (Pagh, 2016).

A fingerprint has a bit for each of 64 majority votes among the hashes of all shingles. Two
fingerprints are linked if at most RADIUS bits differ. Every bit has a label of RADIUS + 1
binary digits; for each non-zero pattern v a mask keeps the bits whose label has an odd inner
product with v. For any RADIUS bits some pattern masks all of them out, so every linked pair
agrees in at least one of the 2**(RADIUS + 1) - 1 tables.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxmetrics.llm.common import keyed, stored
from boxmetrics.llm.components import component_labels

SHINGLE_WORDS = 3
RADIUS = 2
BITS = 64
SEED = 42
#: A bucket with more fingerprints is divided further before it is paired.
PAIRED_BUCKET = 32

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def fingerprint(text: bytes, words: int = SHINGLE_WORDS) -> int:
    """Majority bits over the shingle hashes; 0 for a text without words."""
    tokens = text.translate(_LOWER).split()
    if not tokens:
        return 0
    digest, joined = xxhash.xxh64_intdigest, b" ".join
    if len(tokens) <= words:
        shingles = [digest(joined(tokens), SEED)]
    else:
        parts = [tokens[i:] for i in range(words)]
        shingles = [digest(joined(shingle), SEED) for shingle in zip(*parts)]
    hashes = np.array(shingles, dtype=np.uint64)
    votes = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), 8192):
        block = hashes[at : at + 8192].astype(">u8").view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(block, axis=1).sum(axis=0, dtype=np.int64)
    bits = np.packbits(votes * 2 > len(hashes))
    return int.from_bytes(bits.tobytes(), "big")


def with_fingerprint(documents: DataFrame, words: int = SHINGLE_WORDS) -> DataFrame:
    """The keyed rows without their text, with the fingerprint as a signed long."""

    @F.arrow_udf("long")
    def fingerprints(texts: pa.Array) -> pa.Array:
        values = [fingerprint(text.as_py(), words) for text in texts.cast(pa.binary())]
        return pa.array(np.array(values, dtype=np.uint64).view(np.int64))

    return documents.withColumn("fp", fingerprints("text")).drop("text")


def masks(radius: int = RADIUS) -> list[int]:
    """One mask per non-zero pattern, as signed longs. Labels go round the non-zero patterns
    first, so that each mask keeps about half of the bits or more."""
    size = 1 << (radius + 1)
    labels = [1 + bit % (size - 1) for bit in range(BITS)]
    made = [sum(1 << bit for bit in range(BITS) if (labels[bit] & v).bit_count() % 2) for v in range(1, size)]
    return [mask - (1 << BITS) if mask >> (BITS - 1) else mask for mask in made]


def linked_pairs(fingerprints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """All pairs (low, high) of distinct fingerprints that differ in 1 to `radius` bits.

    Fingerprints that agree under a mask meet in a bucket. A bucket of more than
    PAIRED_BUCKET is not paired: each member is written to the values that one flip of a
    free bit gives, as two members within two bits meet in such a value. There, at most one
    member per free bit meets, so pairs stay bounded whatever the size of a group.
    """
    if radius > 2:
        raise ValueError("large buckets are divided for a radius of at most 2")
    all_bits = (1 << BITS) - 1
    tables = [
        F.struct(F.lit(number).alias("table"), F.lit(mask).cast("long").alias("mask"))
        for number, mask in enumerate(masks(radius))
    ]
    rows = fingerprints.select("fp", F.inline(F.array(*tables))).select(
        "fp", "table", F.col("fp").bitwiseAND(F.col("mask")).alias("bucket")
    )
    sizes = rows.groupBy("table", "bucket").agg(F.count("*").alias("members")).filter("members > 1")
    met = rows.join(sizes, ["table", "bucket"])
    few = met.filter(F.col("members") <= PAIRED_BUCKET).select("fp", "table", "bucket", F.lit(0).cast("long").alias("near"))
    flips = F.array(
        *[
            F.array(
                F.lit(0).cast("long"),
                *[_bit(bit) for bit in range(BITS) if not ((mask & all_bits) >> bit) & 1],
            )
            for mask in masks(radius)
        ]
    )
    many = met.filter(F.col("members") > PAIRED_BUCKET).select(
        "fp", "table", "bucket", F.explode(flips[F.col("table")]).alias("flip")
    ).select("fp", "table", "bucket", F.col("fp").bitwiseXOR(F.col("flip")).alias("near"))
    meeting = few.unionByName(many)
    other = meeting.withColumnRenamed("fp", "high")
    return (
        meeting.withColumnRenamed("fp", "low")
        .join(other, ["table", "bucket", "near"])
        .filter((F.col("low") < F.col("high")) & (F.bit_count(F.col("low").bitwiseXOR(F.col("high"))) <= radius))
        .select("low", "high")
        .distinct()
    )


def _bit(bit: int):
    value = 1 << bit
    return F.lit(value - (1 << BITS) if bit == BITS - 1 else value).cast("long")


def near_duplicates(documents: DataFrame, words: int = SHINGLE_WORDS, radius: int = RADIUS) -> DataFrame:
    """Fingerprint and component of every document, with its key and the component's label.

    Equal fingerprints are collapsed before anything is linked. Null and empty texts have
    fingerprint 0 and are linked like others. The component is the smallest id that can be
    reached; a row without an id takes part, and its component is null only if no id is
    reached. The label is a fingerprint of the component; it tells components with equal ids
    apart. Repeated rows each give a row. Other columns are ignored.
    """
    marked = stored(with_fingerprint(keyed(documents), words), "fingerprints")
    nodes = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("smallest")), "nodes")
    pairs = stored(linked_pairs(nodes.select("fp"), radius), "pairs")
    labels = component_labels(pairs, "low", "high")
    # Fingerprints without a link are their own component and need no label.
    labelled = nodes.join(labels, nodes["fp"] == labels["node"], "left").select(
        "fp", F.coalesce("label", "fp").alias("label"), "smallest"
    )
    reached = labelled.groupBy("label").agg(F.min("smallest").alias("component_id"))
    of_fingerprint = labelled.join(reached, "label").select("fp", "label", "component_id")
    return marked.join(of_fingerprint, "fp").select(
        "doc_id", "text_hash", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "label"
    )


def representatives(documents: DataFrame, words: int = SHINGLE_WORDS, radius: int = RADIUS) -> DataFrame:
    """One key per component: the smallest id, and the smallest hash among its rows."""
    found = near_duplicates(documents, words, radius)
    return found.groupBy("label").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_hash")).alias("kept")
    ).select("kept.doc_id", "kept.text_hash")
