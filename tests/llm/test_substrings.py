"""Repeated passages through sources, digests and compaction, also with weak hashes."""

from __future__ import annotations

import collections
import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from boxmetrics.llm import substrings, words
from boxmetrics.llm.common import keyed

SCHEMA = "doc_id long, text string"


def _plain(rows, size):
    firsts = {}
    for doc_id, text in rows:
        parts = (text or "").encode().split()
        for at in range(len(parts) - size + 1):
            key = tuple(parts[at : at + size])
            if doc_id is not None:
                firsts[key] = min(firsts.get(key, doc_id), doc_id)
    wanted = collections.Counter()
    for doc_id, text in rows:
        parts = (text or "").encode().split()
        gone = set()
        for at in range(len(parts) - size + 1):
            if doc_id is not None and firsts[tuple(parts[at : at + size])] < doc_id:
                gone.update(range(at, at + size))
        kept = b" ".join(part for at, part in enumerate(parts) if at not in gone)
        wanted[doc_id, len(parts), len(gone), hashlib.sha256(kept).hexdigest()] += 1
    return wanted


def _rows(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{n}" for n in range(300)]
    passages = [rng.choices(vocabulary, k=rng.randrange(20, 120)) for _ in range(8)]
    rows = []
    for number in range(60):
        parts = []
        for _ in range(rng.randrange(1, 5)):
            passage = rng.choice(passages)
            cut = rng.randrange(max(len(passage) - 25, 1))
            parts += rng.choices(vocabulary, k=rng.randrange(0, 60)) + passage[cut : cut + rng.randrange(10, 120)]
        gap = rng.choice([" ", "  ", "\n", " \t"])
        rows.append((rng.randrange(40) if number % 13 else None, gap.join(parts)))
    rows += [(100 + n, rows[5][1]) for n in range(40)] + [rows[7]] * 5
    rows += [(200, None), (201, ""), (202, " ".join(["same"] * 400)), (203, " ".join(["same"] * 150))]
    return rows


@pytest.mark.parametrize("bits", [64, 4, 0], ids=["whole hash", "4 bits", "no bits"])
def test_weak_hashes_of_words_change_nothing(spark, monkeypatch, bits):
    """Hashes choose anchors only; what is equal is decided by the words."""
    weak = np.uint64((1 << bits) - 1)
    plain = words.words_of

    def weakened(texts, lower=False, limit=words.CHUNK_BYTES):
        for part in plain(texts, lower, limit):
            part.ids = part.ids & weak
            yield part

    monkeypatch.setattr(substrings, "words_of", weakened)
    # Tasks get the module as it is here, not as it is on their path.
    cloudpickle.register_pickle_by_value(substrings)
    try:
        rows = _rows(bits)
        frame = spark.createDataFrame(rows, SCHEMA).withColumns({name: F.lit("x") for name in ("start", "h", "end", "spans", "size")})
        got = substrings.deduplicated(frame, 20, 10)
        columns = ["doc_id", "n_words", "n_removed", "kept_sha256"]
        wanted = _plain(rows, 20)
        assert collections.Counter(tuple(row) for row in got.select(*columns).collect()) == wanted
        assert sum(key[2] for key in wanted) > 1000
    finally:
        cloudpickle.unregister_pickle_by_value(substrings)


def test_spans_have_the_words_of_their_source(spark):
    rows = [row for row in _rows(3) if row[0] is not None]
    frame = keyed(spark.createDataFrame(rows, SCHEMA))
    texts = {(row["doc_id"], row["text_hash"]): (row["text"] or "").split() for row in frame.collect()}
    spans = substrings.repeated_spans(frame, 20, 10)
    long = substrings.compacted(spans).collect()
    assert len(long) < spans.distinct().count()
    for row in long:
        size = row["end"] - row["start"]
        own = texts[row["doc_id"], row["text_hash"]][row["start"] : row["end"]]
        there = texts[row["source_id"], row["source_hash"]][row["source_start"] : row["source_start"] + size]
        assert size >= 20 and own == there and row["source_id"] < row["doc_id"]


def test_side_by_side_spans_are_compacted(spark):
    # Document 2: one run of three; one that goes on elsewhere in the source; one by itself.
    spans = [(2, 0, 0, 20, 1, 0, 5), (2, 0, 10, 30, 1, 0, 15), (2, 0, 30, 50, 1, 0, 35), (2, 0, 40, 60, 1, 0, 70), (2, 0, 90, 110, 1, 0, 95)]
    names = "doc_id long, text_hash long, start int, end int, source_id long, source_hash long, source_start int"
    got = substrings.compacted(spark.createDataFrame(spans + spans[:2], names)).collect()
    assert sorted(map(tuple, got)) == [(2, 0, 0, 50, 1, 0, 5), (2, 0, 40, 60, 1, 0, 70), (2, 0, 90, 110, 1, 0, 95)]


def test_a_span_that_differs_from_its_source_stops_the_job():
    given = [pa.array([value]) for value in ("a b c", [0], [2], [substrings._digest([b"a", b"x"])])]
    with pytest.raises(RuntimeError, match="differs"):
        substrings.without_spans(*given)
    given[3] = pa.array([[substrings._digest([b"a", b"b"])]])
    given[1], given[2] = pa.array([[0]]), pa.array([[2]])
    assert substrings.without_spans(*given) == ([3], [2], [b"c"])


def test_a_hot_anchor_is_split(spark):
    """Many documents share one passage: the merge joins can split its rows."""
    settings = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "8k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k",
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.files.maxPartitionBytes": "16k",
        "spark.sql.files.openCostInBytes": "0",
    }
    before = {name: spark.conf.get(name, None) for name in settings}
    rng = random.Random(9)
    hot = " ".join(rng.choices([f"w{n}" for n in range(900)], k=90))
    rows = [(n, f"{n} x {hot} y {n}") for n in range(1500)]
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        frame = keyed(spark.createDataFrame(rows, SCHEMA).repartition(8))
        spans = substrings.repeated_spans(frame)
        assert spans.select("doc_id").distinct().count() == 1499
        spans.collect()
        assert "skew=true" in spans._jdf.queryExecution().executedPlan().toString()
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def test_each_text_goes_through_a_function_once(spark, monkeypatch):
    """A function that a plan holds twice takes twice the time, and two workers for each task."""
    evaluated = {}

    def counted(frame, name, plain=substrings.stored):
        evaluated[name] = frame._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython")
        return plain(frame, name)

    monkeypatch.setattr(substrings, "stored", counted)
    rows = [row for row in _rows(4) if row[0] is not None]
    result = substrings.deduplicated(spark.createDataFrame(rows, SCHEMA), 20, 10)
    assert {name: evaluated[name] for name in ("shared", "paths", "edges", "digests")} == {
        "shared": 1, "paths": 1, "edges": 1, "digests": 1
    }
    assert result._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
