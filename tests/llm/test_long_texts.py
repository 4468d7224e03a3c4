"""Texts of a million words, and shards as files."""

from __future__ import annotations

import collections
import math
import random
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from boxmetrics.llm import decontamination, language_model, line_rules, packing, privacy, quality, queries, sharding
from boxmetrics.llm import simhash, substrings

COUNT = 1_000_000
ITEM = " ".join(f"item{n}" for n in range(10))
MAIL = "someone@mail.example.org"


@pytest.fixture(scope="module")
def long_words():
    rng = random.Random(11)
    vocabulary = [f"w{n}" for n in range(30_000)]
    words = rng.choices(vocabulary, k=COUNT - 11)
    return [*words, *ITEM.split(), MAIL]


@pytest.fixture(scope="module")
def documents(spark, long_words):
    lines = [" ".join(long_words[at : at + 40]) for at in range(0, COUNT, 40)]
    rows = [(1, "\n".join(lines)), (2, " ".join(long_words[500_000:501_000])), (3, None)]
    return spark.createDataFrame(rows, "doc_id long, text string")


def _by_id(frame):
    return {row["doc_id"]: row for row in frame.collect()}


def test_packing(documents):
    found = packing.packed(documents, queries.vocabulary()).filter("doc_id = 1").orderBy("start").collect()
    assert [row["start"] for row in found] == [0, *np.cumsum([row["length"] for row in found])[:-1]]
    assert sum(row["length"] for row in found) == found[0]["doc_tokens"] > COUNT


def test_substrings(documents):
    found = _by_id(substrings.deduplicated(documents))
    assert [(found[n]["n_words"], found[n]["n_removed"]) for n in (1, 2, 3)] == [(COUNT, 0), (1000, 1000), (0, 0)]


def test_decontamination(spark, documents):
    found = _by_id(decontamination.contamination(documents, spark.createDataFrame([(5, ITEM)], "item_id long, text string")))
    assert found[1]["n_hit"] == 10 and found[1]["n_items"] == 1 and not found[2]["contaminated"]


def test_quality(spark, documents):
    labels = spark.createDataFrame([(1, 0), (2, 1)], "doc_id long, quality int")
    assert all(0 <= row["score"] <= 1 for row in quality.scored(documents, labels).collect())


def test_language_model(documents, long_words):
    found = _by_id(language_model.scored(documents))
    learned = collections.Counter()
    parts = {1: long_words, 2: long_words[500_000:501_000], 3: []}
    for doc_id, words in parts.items():
        if zlib.crc32(str(doc_id).encode()) % 7 != 2:
            learned.update([*words, "\0"])
    total, distinct = sum(learned.values()), len(learned)
    for doc_id, words in parts.items():
        base = sum(math.log10((learned[word] + 1) / (total + distinct + 1)) for word in [*words, "\0"])
        assert found[doc_id]["n_tokens"] == len(words) + 1
        assert found[doc_id]["base_score"] == pytest.approx(base, rel=1e-9)


def test_line_rules(documents, long_words):
    found = _by_id(line_rules.quality(documents))
    windows = collections.Counter(zip(*[long_words[n:] for n in range(8)]))
    assert max(windows.values()) == 1
    assert found[1]["n_words"] == COUNT and found[1]["n_repeat_words"] == 0 and found[1]["kept"]
    assert found[1]["word_chars"] == sum(map(len, long_words))


def test_privacy(documents):
    row = _by_id(privacy.personal_data(documents))[1]
    text = documents.filter("doc_id = 1").first()["text"]
    assert row["n_email"] == 1 and f"email:{len(text) - len(MAIL)}:{len(text)}" in row["spans"].split(",")


def test_simhash(documents, long_words):
    ones = np.zeros(64, dtype=np.int64)
    hashes = [xxhash.xxh64_intdigest(" ".join(shingle), 42) for shingle in zip(long_words, long_words[1:], long_words[2:])]
    values = np.array(hashes, dtype=np.uint64)
    for bit in range(64):
        ones[bit] = int((values >> np.uint64(bit) & np.uint64(1)).sum())
    wanted = sum(1 << bit for bit in range(64) if 2 * ones[bit] > len(values))
    assert _by_id(simhash.near_duplicates(documents))[1]["fingerprint"] == f"{wanted:016x}"


def test_sharding(documents):
    text = documents.filter("doc_id = 1").first()["text"].encode()
    row = _by_id(sharding.sharded(documents))[1]
    assert (row["size"], row["text_crc32"]) == (len(text) + 8, zlib.crc32(text))


@pytest.mark.parametrize("own", ["shard", "SHARD", "other"])
def test_shards_as_files(spark, tmp_path, own):
    rows = [(n % 300 if n % 7 else None, f"text {n % 50}" if n % 11 else None, n) for n in range(2000)]
    frame = spark.createDataFrame(rows, f"doc_id long, text string, {own} long")
    name = sharding.write_shards(frame, str(tmp_path / "shards"))
    assert name == ("shard" if own == "other" else "_shard")
    back = spark.read.option("basePath", str(tmp_path / "shards")).parquet(str(tmp_path / "shards" / f"{name}=*"))
    assert collections.Counter(tuple(r) for r in back.select("doc_id", "text", own).collect()) == collections.Counter(rows)
    # A file's shard is that of the operator.
    wanted = {(r["doc_id"], r["text_crc32"], r["size"]): r["shard"] for r in sharding.sharded(frame).collect()}
    text = F.coalesce("text", F.lit(""))
    placed = back.select("doc_id", F.crc32(text.cast("binary")).alias("crc"), (F.octet_length(text) + 8).alias("size"), name)
    assert all(wanted[r["doc_id"], r["crc"], r["size"]] == r[name] for r in placed.collect())


def test_no_shards_of_nothing(spark, tmp_path):
    frame = spark.createDataFrame([], "doc_id long, text string")
    assert sharding.write_shards(frame, str(tmp_path / "shards")) == "shard"
