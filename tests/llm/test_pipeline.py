"""The corpus pipeline against its stages done plainly, one after the other."""

from __future__ import annotations

import collections
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from boxmetrics.llm import packing, privacy, quality

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def _documents():
    rng = random.Random(21)
    vocabulary = ["".join(rng.choices("abcdefgh", k=rng.randrange(2, 8))) for _ in range(500)]
    texts = [" ".join(rng.choices(vocabulary, k=rng.randrange(30, 200))) + "." for _ in range(90)]
    item = " ".join(rng.choices(vocabulary, k=16))
    texts += [f"{texts[n]} {item.upper()} {texts[n + 1]}" for n in range(6)]
    texts += [f"{texts[n]} write to a.b{n}@mail.example.org or +49 30 1234567{n}" for n in range(10, 20)]
    texts += [texts[30]] * 4 + [texts[31] + " "] * 3 + [None, "", " \n "]
    bad = [f"buy {n % 7} " * (30 + n) for n in range(60)]
    rows = [(n * 7 % 1009, text) for n, text in enumerate(texts + bad)]
    labels = [(key, int(n < len(texts)), 0) for n, (key, _) in enumerate(rows) if n % 3]
    rows += [(rows[40][0], texts[40], "de"), (rows[40][0], texts[40], None), (None, texts[41]), (None, None)]
    rows.append((rows[42][0], texts[43] + " more"))
    full = [(*row, *("en",) * (3 - len(row)), f"s{n % 3}", len(row[1] or "")) for n, row in enumerate(rows)]
    return full, labels, [(1, item), (2, None), (3, "")]


def _lower(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


def _fingerprint(text):
    parts = [p.decode() for p in _lower(text).encode().split()]
    shingles = [" ".join(parts[i : i + 3]) for i in range(max(1, len(parts) - 2))] if parts else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << bit for bit in range(64) if sum(h >> bit & 1 for h in hashes) * 2 > len(hashes))


def _one_of_each(rows):
    """By brute force: groups of fingerprints within two bits, and of each the smallest row."""
    prints = [_fingerprint(row[1]) for row in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2 and group[i] != group[j]:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    best = {}
    for g, row in zip(group, rows):
        # Two texts under one id: the text with the smaller hash stays, so the id alone decides here.
        place = (row[0] is None, row[0] or 0, [(value is not None, value) for value in row[1:]])
        if g not in best or place < best[g][0]:
            best[g] = (place, row)
    return [row for _, row in best.values()]


def _words(text):
    import re

    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", _lower(text))


def _clean(rows, items):
    windows = set()
    for _, text in items:
        parts = _words(text)
        windows |= {tuple(parts[at : at + 10]) for at in range(max(len(parts) - 9, 1))} if parts else set()
    sizes = {len(window) for window in windows}

    def hit(text):
        parts = _words(text)
        return any(tuple(parts[at : at + size]) in windows for size in sizes for at in range(len(parts) - size + 1))

    return [row for row in rows if not hit(row[1])]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("pipeline"))
    rows, labels, items = _documents()
    frame = spark.createDataFrame(rows, SCHEMA).withColumn("text_hash", F.lit("other")).withColumn("score", F.lit(1))
    frame.repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, rows, items


def test_run_is_its_stages_done_plainly(spark, tables):
    from tokenizers import Tokenizer

    folder, rows, items = tables
    documents = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    # The thresholds are applied to the operator's own scores; its training is tested elsewhere.
    forest = quality.trained(documents, labels)
    import pyarrow as pa

    scores = forest.score(quality.statistics(pa.array([row[1] for row in rows], pa.string())))
    accepted = [row for row, score in zip(rows, scores) if score >= quality.KEPT_SCORE]
    assert 0 < len(accepted) < len(rows) - 30
    single = _one_of_each(accepted)
    assert len(single) < len(accepted) - 5
    clean = _clean(single, items)
    assert len(single) - len(clean) == 6

    tokenizer = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    nobody = privacy.SpanModel(np.r_[-50.0, np.zeros(10)])
    wanted = collections.Counter()
    changed = 0
    for doc_id, text, *_ in clean:
        hidden = None if text is None else privacy._redacted(text, nobody)
        changed += hidden != text
        ids = [*tokenizer.encode(hidden or "", add_special_tokens=False).ids, 0]
        for start, length in packing.cuts(len(ids)):
            crc = zlib.crc32(np.array(ids[start : start + length], dtype="<u4").tobytes())
            wanted[doc_id, start, length, crc] += 1
    assert changed >= 8
    got = corpus_pipeline.run(spark, folder).collect()
    assert collections.Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for r in got) == wanted
    ends = collections.defaultdict(int)
    for row in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert row["offset"] == ends[row["sequence_id"]]
        ends[row["sequence_id"]] += row["length"]
    assert max(ends.values()) <= packing.CAPACITY


def test_ties_are_defined(spark):
    rows = [(5, "some text of its own", lang, source, n) for lang, source, n in [("en", "b", 3), ("de", "z", 9), ("de", "a", 7)]]
    for order in (rows, rows[::-1]):
        [kept] = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(order, SCHEMA), "").collect()
        assert tuple(kept) == (5, "some text of its own", "de", "a", 7)


def test_null_and_empty_texts_are_one_group(spark):
    rows = [(5, "", "en", "a", 0), (5, None, "en", "b", None), (None, None, "de", "a", None), (9, "", "de", "a", 0)]
    frame = spark.createDataFrame(rows, SCHEMA).withColumns({"words": F.lit(1), "row": F.lit(2)})
    for order in (frame, frame.orderBy(F.desc("source"))):
        made = corpus_pipeline.near_duplicates(spark, order, "")
        assert made.columns == frame.columns
        assert [tuple(row) for row in made.collect()] == [(5, None, "en", "b", None, 1, 2)]


def test_stages_on_empty_tables(spark, tmp_path):
    folder = str(tmp_path)
    for name, schema in (
        ("labels", "doc_id long, quality int, toxic int"),
        ("benchmark", "item_id long, text string"),
        ("documents", SCHEMA + ", text_hash string, row string, spans int"),
    ):
        spark.createDataFrame([], schema).write.parquet(f"{folder}/{name}.parquet")
    documents = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        made = stage(spark, documents, folder)
        assert made.columns == documents.columns and made.count() == 0
    assert corpus_pipeline.run(spark, folder).count() == 0


def test_loose_spans_that_an_early_long_span_covers():
    """The strict span that overlaps a candidate may be many strict spans before it."""
    strict = [privacy.Candidate(3, 0, 500, True)] + [privacy.Candidate(1, 10 + 9 * n, 17 + 9 * n, True) for n in range(20)]
    text = "x" * 300 + " 0171 234 5678 " + "x" * 300 + " 0171 234 5678 "
    found = privacy.loose_spans(text, strict)
    assert [(c.start, c.end) for c in found] == [(616, 629)]
