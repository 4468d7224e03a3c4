"""The byte transducer and the audit of filters against plain versions and SQL."""

from __future__ import annotations

import collections
import random
from itertools import permutations

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from boxmetrics.llm import filter_audit, sql, transducer

COLUMNS = "kept removed redundant unique_fails good_lost toxic_lost shapley".split()


def _plain_counts(text: str | None) -> list[int]:
    text = text or ""
    words = text.encode().split()
    return [
        len(words),
        len(set(words)),
        sum("A" <= c <= "Z" for c in text),
        len(text),
        sum(c in "#$%&*|" for c in text),
    ]


def _texts(rng: random.Random, rows: int) -> list[str | None]:
    return [
        None if rng.random() < 0.1 else "".join(rng.choices("ab A#é\n漢𝒳\t|\x0b\x85\xa0", k=rng.choice([0, 1, 3, 30, 200])))
        for _ in range(rows)
    ]


@pytest.mark.parametrize("block", [1, 3, 50, 1 << 20])
def test_counts_agree_with_plain_ones(monkeypatch, block):
    monkeypatch.setattr(transducer, "BLOCK_BYTES", block)
    rng = random.Random(block)
    for _ in range(60):
        texts = _texts(rng, rng.randrange(10))
        given = pa.array(["cut", *texts], pa.string()).slice(1)
        assert transducer.counted(given).tolist() == [_plain_counts(text) for text in texts]


def test_equal_hashes_are_told_apart_by_their_bytes(monkeypatch):
    monkeypatch.setattr(transducer, "span_hashes", lambda data, start, length: np.full(len(start), 7, np.uint64))
    texts = [" ".join(random.Random(n).choices(["one", "two", "six", "three"], k=40)) for n in range(20)]
    assert transducer.counted(pa.array(texts)).tolist() == [_plain_counts(text) for text in texts]


def test_a_million_words_in_one_text():
    rng = random.Random(5)
    words = [f"w{n}" for n in range(30_000)]
    text = " ".join(rng.choices(words, k=1_000_000)) + " " + "x" * 3_000_000
    assert transducer.counted(pa.array([text, "A b"])).tolist() == [_plain_counts(text), [2, 2, 1, 3, 0]]


def test_all_80_cases_have_their_orders():
    cases = filter_audit.steps()
    assert len(cases) == 80
    met = collections.Counter(pair for _, _, orders in cases for pair in orders)
    orders = ["".join(order) for order in permutations("ABCDE")]
    assert met == collections.Counter((order, step) for order in orders for step in range(1, 6))


def _plain_audit(rows, labels):
    good = {key for key, quality, _ in labels if quality == 1 and key is not None}
    toxic = {key for key, _, flag in labels if flag == 1 and key is not None}
    first = {}
    for key, text, _ in rows:
        if key is not None:
            first[text or ""] = min(first.get(text or "", key), key)
    failed = []
    for key, text, source in rows:
        words, distinct, capitals, points, symbols = _plain_counts(text)
        fails = {
            "A": words < 200,
            "B": 100 * distinct < 50 * words,
            "C": 100 * capitals > 2 * points,
            "D": symbols > 0,
            "E": key is not None and key > first[text or ""],
        }
        failed.append((source or "", {name for name in fails if fails[name]}, key in good, key in toxic))
    result = {}
    orders = ["".join(order) for order in permutations("ABCDE")]
    for part in {source for source, *_ in failed}:
        own = [row[1:] for row in failed if row[0] == part]
        removed_by = collections.Counter()
        for order in orders:
            left = own
            for step, name in enumerate(order, 1):
                gone = [row for row in left if name in row[0]]
                before = [row for row in own if row not in left or row[0] & set(order[: step - 1])]
                left = [row for row in left if name not in row[0]]
                removed_by[name] += len(gone)
                result[part, order, step] = [
                    len(left),
                    len(gone),
                    sum(name in row[0] for row in before),
                    sum(row[0] == {name} for row in own),
                    sum(row[1] for row in gone),
                    sum(row[2] for row in gone),
                ]
        for order in orders:
            for step, name in enumerate(order, 1):
                result[part, order, step].append(removed_by[name])
    return result


def _rows(rng: random.Random):
    words = [f"word{n}" for n in range(300)]
    texts = [" ".join(rng.sample(words, k=250)) for _ in range(6)]
    texts += [texts[0].upper(), texts[1] + " #", "a " * 300, "SHORT # TEXT", "plain short", "", None, " \n "]
    texts.append("A " * 220 + "|")
    rows = []
    for number in range(160):
        key = None if rng.random() < 0.1 else rng.randrange(120)
        rows.append((key, rng.choice(texts), rng.choice(["web", "web", "web", "books", "", None, "forum"])))
    rows += [rows[3]] * 40 + [(7, "hot text", "hot")] * 30
    labels = [(rng.randrange(130), rng.choice([0, 1, None]), rng.choice([0, 0, 1, None])) for _ in range(150)]
    return rows, [*labels, (None, 1, 1)]


def _frames(spark, rows, labels):
    documents = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns(
        {name: F.lit("other") for name in ("part", "failed", "digest", "counts", "quality", "good", "labelled")}
    )
    return documents, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("limit", [None, 0], ids=["broadcast", "merged"])
def test_audit_agrees_with_all_orders_applied(spark, monkeypatch, limit):
    if limit is not None:
        monkeypatch.setattr(filter_audit, "small_or_merged", lambda frame: frame.hint("merge"))
    rows, labels = _rows(random.Random(12))
    wanted = _plain_audit(rows, labels)
    got = filter_audit.audit(*_frames(spark, rows, labels))
    assert got.columns == ["part", "filter_order", "step", *COLUMNS]
    found = {(row["part"], row["filter_order"], row["step"]): [row[c] for c in COLUMNS] for row in got.collect()}
    assert found == wanted


def test_audit_agrees_with_sql(spark):
    rows, labels = _rows(random.Random(13))
    # The SQL takes unique ids for granted, as the tables have them.
    rows = [(number, *row[1:]) for number, row in enumerate(rows)]
    frames = _frames(spark, rows, labels)
    connection = duckdb.connect()
    for name, frame in zip(("documents", "labels"), frames):
        connection.register(name, frame.select(*frame.columns[:3]).toArrow())
    order = ["part", "filter_order", "step", *COLUMNS]
    wanted = connection.sql(f"SELECT {', '.join(order)} FROM ({sql.op12()})").fetchall()
    assert collections.Counter(map(tuple, filter_audit.audit(*frames).collect())) == collections.Counter(wanted)


def test_audit_of_nothing(spark):
    documents, labels = _frames(spark, [], [])
    assert filter_audit.audit(documents, labels).collect() == []
    some, _ = _frames(spark, [(1, "a b", "s")], [])
    [row] = filter_audit.audit(some, labels).filter("filter_order = 'BCADE' and step = 3").collect()
    assert [row[c] for c in COLUMNS] == [0, 1, 0, 1, 0, 0, 120]
