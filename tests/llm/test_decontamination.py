"""Benchmark decontamination against a plain search, by each of its plans."""

from __future__ import annotations

import collections
import hashlib
import random
import re

import pytest

from boxmetrics.llm import decontamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
COLUMNS = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def _words(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return WORD.findall(lowered)


def _expected(rows, items, window=10):
    of_window = collections.defaultdict(set)
    for item_id, text in items:
        found = _words(text)
        for start in range(max(len(found) - window, 0) + 1 if found else 0):
            of_window[tuple(found[start : start + window])].add(item_id)
    lengths = {len(w) for w in of_window}
    wanted = collections.Counter()
    for doc_id, text in rows:
        found, hit, met = _words(text), set(), set()
        for length in lengths:
            for start in range(len(found) - length + 1):
                own = of_window.get(tuple(found[start : start + length]))
                if own:
                    hit |= set(range(start, start + length))
                    met |= own
        listed = ",".join(sorted(str(i) for i in met if i is not None))
        digest = hashlib.sha256(listed.encode()).hexdigest()
        named = sum(i is not None for i in met)
        wanted[doc_id, len(found), len(hit), named, digest, bool(hit)] += 1
    return wanted


def _sample():
    rng = random.Random(5)
    common = ["the", "of", "and", "a"]
    vocabulary = common * 20 + [f"{a}{b}é{c}" for a in "bcdfg" for b in "aeiou" for c in range(12)]
    passages = [" ".join(rng.choices(vocabulary, k=rng.randint(1, 30))) for _ in range(5000)]
    plain = "the of and a the of and a the of"
    items = [*enumerate(passages), (5000, plain), (5001, "The, OF. and"), (5002, ""), (5003, None), (None, passages[0])]
    items += [items[3], items[3]]
    rows = []
    for doc_id in range(120):
        parts = rng.choices(vocabulary, k=rng.randint(0, 80))
        if doc_id % 3:
            parts[rng.randint(0, len(parts)) :] = rng.choice(passages).upper().split(" ")
        if doc_id % 4 == 0:
            parts += plain.split(" ") * 3
        rows.append((doc_id, " ".join(parts)))
    rows += [(500, None), (501, ""), (502, "of"), (None, passages[9]), rows[1], rows[1]]
    rows.append((503, " ".join(rng.choices(vocabulary, k=100_000))))
    return rows, items


@pytest.mark.parametrize("plan", ["sent", "shuffled", "passes", "counted"])
def test_plans_agree_with_a_plain_search(spark, monkeypatch, plan):
    rows, items = _sample()
    sizes = {"sent": {}, "shuffled": {"limit": 0}, "passes": {"limit": 0, "spots_limit": 8000}, "counted": {"limit": 0}}
    if plan == "counted":
        monkeypatch.setattr(decontamination, "KEYS_LIMIT_BYTES", 0)
    documents = spark.createDataFrame(rows, "doc_id long, text string")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = decontamination.contamination(documents, benchmark, **sizes[plan])
    assert collections.Counter(tuple(row) for row in found.select(*COLUMNS).collect()) == _expected(rows, items)


def test_shuffled_plan_without_rows(spark):
    documents = spark.createDataFrame([(1, "a b c"), (2, None)], "doc_id long, text string")
    benchmark = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    for own, items, hits in ((documents, benchmark, 2), (documents, benchmark.limit(0), 0), (documents.limit(0), benchmark, 0)):
        found = decontamination.contamination(own, items, limit=0)
        assert sum(row["n_hit"] for row in found.collect()) == hits


def test_shuffled_plan_moves_candidates_only(spark):
    """Beside the spots of a prefix, only candidates and windows are shuffled, by the same key."""
    rows, items = _sample()
    documents = spark.createDataFrame(rows, "doc_id long, text string")
    windows = decontamination.item_windows(spark.createDataFrame(items, "item_id long, text string"))
    prefixes = decontamination.prefixed(windows, decontamination.keyed(documents))
    found = decontamination.shuffled_occurrences(decontamination.keyed(documents), prefixes)
    plan = found._jdf.queryExecution().executedPlan().toString()
    exchanged = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert sum("partitioning(window" in line for line in exchanged) == 2
    assert sum("partitioning(prefix" in line for line in exchanged) == len(exchanged) - 2 == 1
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" in plan
