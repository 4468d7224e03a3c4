"""Every operator against brute force on small rows with nulls, ties, repeats and odd columns."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from pyspark.sql import types as T

import corpus_pipeline
from boxmetrics.llm import boosting, decontamination, language_model, line_rules, packing, privacy, queries, quality
from boxmetrics.llm import secrets, sharding, simhash, sql, substrings, words
from boxmetrics.llm.components import component_labels

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [None, "", " ", "\n\n", "one", "é ü x", "word " * 300, "x" * 5000]


def _texts() -> list[str | None]:
    rng = random.Random(3)
    vocabulary = ["".join(rng.choices("abcdeéß", k=rng.randint(1, 6))) for _ in range(400)]
    long = [" ".join(rng.choices(vocabulary, k=rng.randint(5, 260))) + "." for _ in range(30)]
    shared = " ".join(rng.choices(vocabulary, k=70))
    near = []
    for at in range(8):
        part = long[0].split(" ")
        part[at % len(part)] = "changed"
        near.append(" ".join(part))
    passages = [f"{long[i][:40 + 17 * i]} {shared} {long[i + 1]}" for i in range(6)]
    personal = [
        'Mail a.b+c@mail.example.org, call +49 (30) 123-4567 8, ip 10.0.0.255 or 300.1.1.1. card 4111 1111 1111 1111',
        'password = "hunter2hunter2" token:token:abcdef AKIA' + "Z" * 16 + " " + "0af9" * 8,
        "user ACCOUNTNAME01 opens https://db.example.org/x with aB3" + "dE5f" * 6 + "\nhome | news | about | more | end",
    ]
    return ODD + long + long[:5] + near + passages + personal


@pytest.fixture(scope="module")
def rows():
    texts = _texts()
    made = [(i * 3 % 101 if i % 9 else i, t, "en", "src", len(t or "")) for i, t in enumerate(texts)]
    made += [made[10], made[10], (None, texts[9], None, None, None), (None, None, None, None, None)]
    seen, unique = set(), []
    for row in made:
        key = (row[0], row[1])
        if row[0] is None or key in seen or row[0] not in {k for k, _ in seen}:
            seen.add(key)
            unique.append(row)
    return unique


@pytest.fixture(scope="module")
def documents(spark, rows):
    extra = ["text_hash", "score", "key", "shard", "fp", "rank", "words", "parts", "spans"]
    frame = spark.createDataFrame(rows, SCHEMA)
    return frame.withColumns({name: F.lit("other") for name in extra})


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def items(spark, rows):
    texts = [row[1] for row in rows if row[1] and len(row[1]) > 300][:3]
    cut = [" ".join(text.split(" ")[4:20]).upper() for text in texts]
    return spark.createDataFrame([*enumerate(cut), (7, None), (8, ""), (9, "changed")], "item_id long, text string")


def _collected(frame, *columns):
    return collections.Counter(tuple(row) for row in frame.select(*columns).collect())


def _split(text):
    return (text or "").encode().split()


def _sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def test_words_agree_with_split():
    texts = [t or "" for t in _texts()]
    for limit in (1, 700, 1 << 20):
        found = {}
        for part in words.words_of(pa.array(texts), limit=limit):
            for row in range(len(part.first) - 1):
                at = slice(part.first[row], part.first[row + 1])
                content = part.data.tobytes()
                found[part.row + row] = [content[a:b] for a, b in zip(part.starts[at], part.ends[at])]
        assert [found[i] for i in range(len(texts))] == [_split(t) for t in texts]


def test_packing(spark, documents, rows, nothing):
    from tokenizers import Tokenizer
    import public_tokenizers

    tokenizer = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    got = packing.packed(documents, queries.vocabulary()).collect()
    sequences, pieces = collections.defaultdict(list), collections.defaultdict(list)
    for row in got:
        sequences[row["sequence_id"]].append((row["offset"], row["length"]))
        pieces[row["doc_id"]].append(row)
    assert sorted(sequences) == list(range(len(sequences)))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
    wanted = collections.Counter()
    for doc_id, text, *_ in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        for start, length in packing.cuts(len(ids)):
            crc = zlib.crc32(np.array(ids[start : start + length], dtype="<u4").tobytes())
            wanted[doc_id, start, length, crc, len(ids)] += 1
    assert _collected(packing.packed(documents, queries.vocabulary()), "doc_id", "start", "length", "ids_crc32", "doc_tokens") == wanted
    assert packing.packed(nothing, queries.vocabulary()).count() == 0


def test_packing_finds_added_tokens(spark):
    from tokenizers import Tokenizer
    import public_tokenizers

    tokenizer = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    end = "<|endoftext|>"
    texts = ["plain words only", f"one doc ends.{end}next begins", f"a {end} b", end, end * 2, f"é  {end}\n\n it's{end}'s ", "<|endoftext"]
    texts.append(f"long {end} text\n" * 700)
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    wanted = collections.Counter()
    for doc_id, text in enumerate(texts):
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 0]
        for start, length in packing.cuts(len(ids)):
            crc = zlib.crc32(np.array(ids[start : start + length], dtype="<u4").tobytes())
            wanted[doc_id, start, length, crc, len(ids)] += 1
    assert _collected(packing.packed(frame, queries.vocabulary()), "doc_id", "start", "length", "ids_crc32", "doc_tokens") == wanted


def test_patterns_hold_the_histogram():
    rng = random.Random(1)
    for _ in range(30):
        histogram = {rng.randint(1, 1024): rng.randint(1, 900) for _ in range(rng.randint(1, 200))}
        held, padding = collections.Counter(), 0
        for pattern in packing.packed_patterns(histogram):
            used = sum(length * times for length, times in pattern.content)
            assert used <= 1024
            padding += (1024 - used) * pattern.count
            for length, times in pattern.content:
                held[length] += times * pattern.count
        assert held == collections.Counter(histogram)


def test_secrets_and_lines_and_benchmark_match_sql(spark, documents, rows, items, nothing):
    named = [row for row in rows if row[0] is not None]
    once = list({row[0]: row for row in named}.values())
    frame = documents.filter("doc_id is not null").dropDuplicates(["doc_id"])
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": [r[0] for r in once], "text": [r[1] for r in once]}))
    con.register("benchmark", pa.Table.from_pylist([r.asDict() for r in items.collect()]))
    for found, statement in (
        (secrets.secrets(frame), sql.op2()),
        (line_rules.quality(frame).drop("clean_text"), sql.op7()),
        (decontamination.contamination(frame, items).drop("text_hash"), sql.op4()),
        (decontamination.contamination(frame, items, limit=0).drop("text_hash"), sql.op4()),
    ):
        relation = con.sql(statement)
        columns = sorted(relation.columns)
        wanted = collections.Counter(relation.select(*columns).fetchall())
        assert sorted(found.columns) == columns
        assert _collected(found, *columns) == wanted
    assert secrets.secrets(documents).count() == line_rules.quality(documents).count() == len(rows)
    assert decontamination.contamination(documents, items).count() == len(rows)
    assert decontamination.contamination(documents, items).filter("contaminated").count() >= 3
    for made in (secrets.secrets(nothing), line_rules.quality(nothing), decontamination.contamination(nothing, items)):
        assert made.count() == 0
    no_items = decontamination.contamination(documents, items.limit(0))
    assert no_items.filter("contaminated").count() == 0


def test_weak_candidates_need_a_complement(spark):
    far = " x" * 400
    frame = spark.createDataFrame(
        [(1, "ACCOUNTNAME01 and https://db.example.org/x"), (2, "ACCOUNTNAME01" + far + " https://db.example.org/x"), (3, "ACCOUNTNAME01")],
        "doc_id long, text string",
    )
    got = {row["doc_id"]: row["spans"] for row in secrets.secrets(frame).collect()}
    assert got == {1: "identifier:0:13,endpoint:18:42", 2: "", 3: ""}


def test_substrings(spark, documents, rows, nothing):
    size = substrings.WINDOW
    firsts = {}
    for doc_id, text, *_ in rows:
        parts = _split(text)
        for at in range(len(parts) - size + 1):
            key = tuple(parts[at : at + size])
            if doc_id is not None:
                firsts[key] = min(firsts.get(key, doc_id), doc_id)
    wanted = collections.Counter()
    for doc_id, text, *_ in rows:
        parts = _split(text)
        gone = set()
        for at in range(len(parts) - size + 1):
            if doc_id is not None and firsts[tuple(parts[at : at + size])] < doc_id:
                gone.update(range(at, at + size))
        kept = b" ".join(part for at, part in enumerate(parts) if at not in gone)
        wanted[doc_id, len(parts), len(gone), _sha(kept)] += 1
    got = substrings.deduplicated(documents, texts=True)
    assert _collected(got, "doc_id", "n_words", "n_removed", "kept_sha256") == wanted
    assert sum(key[2] for key in wanted) > 0
    assert got.filter(F.sha2("kept_text", 256) != F.col("kept_sha256")).count() == 0
    assert substrings.deduplicated(nothing).count() == 0


def test_anchors_do_not_depend_on_the_place(monkeypatch):
    monkeypatch.setattr(substrings, "_PLACE_BITS", np.uint64(6))
    rng = random.Random(8)
    shared, before, after = ([rng.choice("abcdefgh") + str(rng.randint(0, 60)) for _ in range(n)] for n in (900, 137, 80))
    window, anchor = substrings.WINDOW, substrings.ANCHOR

    def anchors(parts):
        paths = substrings.paths_of(pa.array([" ".join(parts)])).to_pylist()[0]
        return {path["start"] + step: path["anchor"] for path in paths for step in range(path["windows"])}

    (chunk,) = words.words_of(pa.array([" ".join(shared)]))
    kmers = words.Spans(chunk.ids).hashed(np.arange(len(shared) - anchor + 1), anchor)
    wanted = {}
    for at in range(len(shared) - window + 1):
        near = kmers[at : at + window - anchor + 1]
        wanted[at] = int(near[np.argmin(near >> np.uint64(6))].astype(np.int64))
    assert anchors(shared) == wanted
    moved = anchors(before + shared + after)
    assert {at: moved[at + len(before)] for at in wanted} == wanted


def test_quality_trees(spark, documents, nothing):
    rng = np.random.default_rng(5)
    features = rng.normal(size=(3000, 4))
    truth = ((features[:, 0] > 0.3) ^ (features[:, 2] < -0.5)).astype(float)
    forest = boosting.fitted(features[:2000], truth[:2000])
    assert ((forest.score(features[2000:]) >= 0.5) == truth[2000:]).mean() > 0.95

    good = [(i, f"Some words of text number {i} are here. They differ, and they end.", 1) for i in range(400)]
    bad = [(1000 + i, f"buy {i} " * 40, 0) for i in range(400)]
    frame = spark.createDataFrame([(a, b) for a, b, _ in good + bad], "doc_id long, text string")
    labels = spark.createDataFrame([(a, c, 0) for a, _, c in good + bad] + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    got = {row["doc_id"]: row for row in quality.scored(frame, labels).collect()}
    assert all(row["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, row in got.items())
    assert all(got[i]["predicted"] == label for i, _, label in good + bad if got[i]["held_out"])
    assert {row["score"] for row in quality.scored(documents, labels.limit(0)).collect()} == {0.5}
    assert quality.scored(nothing, labels).count() == 0


def test_language_model(spark, documents, rows, nothing):
    tokens = [(doc_id, [w.decode() for w in (text or "").encode().lower().split()] + ["\0"]) for doc_id, text, *_ in rows]
    fold = {doc_id: None if doc_id is None else zlib.crc32(str(doc_id).encode()) % 7 for doc_id, _ in tokens}
    counts = collections.Counter(w for doc_id, part in tokens for w in part if fold[doc_id] not in (None, 2))
    total, distinct = sum(counts.values()), len(counts)
    wanted = collections.Counter()
    for doc_id, part in tokens:
        base = sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in part)
        wanted[doc_id, fold[doc_id] == 2, len(part), sum(counts[w] > 0 for w in part), total, round(base, 5)] += 1
    for sizes in ({}, {"block_bytes": 2000, "range_bytes": 4000}):
        got = language_model.scored(documents, **sizes)
        columns = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 5)]
        assert _collected(got, *columns) == wanted
    scores = {(r["doc_id"], r["n_tokens"]): r["score"] for r in got.collect()}
    other = {(r["doc_id"], r["n_tokens"]): r["score"] for r in language_model.scored(documents).collect()}
    assert all(value < 0 and math.isfinite(value) for value in scores.values())
    assert all(math.isfinite(value) for value in other.values())
    assert language_model.scored(nothing).count() == 0


def test_language_model_scores_use_all_training_documents(spark, documents, rows):
    hashed = documents.select("doc_id", F.xxhash64("doc_id", F.lit("deleted")).alias("h")).distinct().collect()
    deleted = {r["doc_id"] for r in hashed if r["doc_id"] is not None and r["h"] % language_model.DELETED == 0}
    learned, kept, parts = (collections.Counter(), collections.Counter()), (collections.Counter(), collections.Counter()), []
    for doc_id, text, *_ in rows:
        part = ["\0", *[w.decode() for w in (text or "").encode().lower().split()], "\0"]
        parts.append((doc_id, part))
        if doc_id is None or zlib.crc32(str(doc_id).encode()) % 7 == 2:
            continue
        for words_counted, pairs_counted in (learned, kept) if doc_id not in deleted else (learned,):
            words_counted.update(part[1:])
            pairs_counted.update(zip(part, part[1:]))
    floor = 1 / (len(learned[0]) + 1)

    def found(counts, before, word):
        context = counts[0][before]
        pair = counts[1][before, word] / context if context else 0.0
        return min(math.frexp(context)[1], language_model._BUCKETS - 1), pair, counts[0][word] / max(sum(counts[0].values()), 1)

    def steps(value):
        return round(language_model._STEPS * math.log(value / floor)) if value else language_model._NEVER

    cells = collections.Counter()
    for doc_id, part in parts:
        if doc_id in deleted and zlib.crc32(str(doc_id).encode()) % 7 != 2:
            for before, word in zip(part, part[1:]):
                bucket, pair, single = found(kept, before, word)
                cells[bucket, steps(pair), steps(single)] += 1
    assert any(kept[0][word] == 0 for word in learned[0])
    weights = language_model.mixture([(*cell, n) for cell, n in cells.items()])
    wanted = collections.Counter()
    for doc_id, part in parts:
        score = 0.0
        for before, word in zip(part, part[1:]):
            bucket, pair, single = found(learned, before, word)
            score += math.log10(weights[bucket] @ [pair, single, floor])
        wanted[doc_id, len(part) - 1, round(score, 5)] += 1
    levels = {"block_bytes": 4000, "range_bytes": 500, "fan_out": 6}
    for sizes in ({}, {"block_bytes": 2000, "range_bytes": 4000}, levels, {"repeated_bytes": 0}, {**levels, "repeated_bytes": 0}):
        assert _collected(language_model.scored(documents, **sizes), "doc_id", "n_tokens", F.round("score", 5)) == wanted


def test_mixture_weights_add_up():
    weights = language_model.mixture([(3, 20, 8, 50), (3, language_model._NEVER, 4, 10), (1, 0, 0, 5)])
    assert np.allclose(weights.sum(axis=1), 1) and (weights > 0).all()
    assert weights[3, 0] > weights[3, 2]


def test_personal_data(spark, documents, rows, nothing):
    patterns = [
        r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        r"[0-9]([\x20-]?[0-9])+",
        r"\+[0-9][\x20().0-9-]+[0-9]",
    ]

    def passes(kind, hit):
        digits = re.sub("[^0-9]", "", hit)
        if kind == 1:
            return all(int(part) <= 255 for part in hit.split("."))
        if kind == 2:
            return 14 <= len(digits) <= 19 and privacy._luhn(digits)
        return kind == 0 or 10 <= len(digits) <= 15

    texts = [*(row[1] for row in rows), "a@b.c%d@e.f x@@y.z 1.2.3.4.5.6.7.8 01.002.0003.4 +1 2 3", "@a.b +49 89 1234567890 4111-1111-1111-1111 5"]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {row["doc_id"]: row for row in privacy.personal_data(frame).collect()}
    for i, text in enumerate(texts):
        spans = sorted(
            (hit.start(), kind, hit.end()) for kind, p in enumerate(patterns) for hit in re.finditer(p, text or "") if passes(kind, hit[0])
        )
        listed = ",".join(f"{privacy.KINDS[kind]}:{a}:{b}" for a, kind, b in spans)
        assert got[i]["base_sha256"] == _sha(listed), text
        assert [got[i][f"n_{k}"] for k in privacy.KINDS] == [sum(s[1] == n for s in spans) for n in range(4)]
        assert set(filter(None, listed.split(","))) <= set(got[i]["spans"].split(","))
    assert privacy.personal_data(documents).count() == len(rows)
    assert privacy.personal_data(nothing).count() == 0
    assert "@" not in "".join(row["text"] or "" for row in privacy.redacted(documents).filter("text like '%Mail a%'").collect())


def test_labelers_are_weighed_by_their_agreement():
    model = privacy.fitted([(3, (0, 1, 1, 1), 300), (3, (1, 1, 0, 1), 300), (3, (0, 0, -1, -1), 400), (3, (0, -1, 0, -1), 200)])
    assert model.keeps(3, (0, 1, 1, 1)) and not model.keeps(3, (0, 0, -1, -1))
    assert not privacy.fitted([]).keeps(0, (0, 1, 1, 1))


def _fingerprint(text):
    parts = [p.decode() for p in (text or "").encode().lower().split()]
    shingles = [" ".join(parts[i : i + 3]) for i in range(max(1, len(parts) - 2))] if parts else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << bit for bit in range(64) if sum(h >> bit & 1 for h in hashes) * 2 > len(hashes))


def test_simhash(spark, documents, rows, nothing, monkeypatch):
    prints = [_fingerprint(row[1]) for row in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                parent[root(i)] = root(j)
    smallest = {}
    for i, row in enumerate(rows):
        ids = [x for x in (smallest.get(root(i)), row[0]) if x is not None]
        smallest[root(i)] = min(ids, default=None)
    wanted = collections.Counter((row[0], f"{prints[i]:016x}", smallest[root(i)]) for i, row in enumerate(rows))
    for most in (32, 2):
        monkeypatch.setattr(simhash, "PAIRED_BUCKET", most)
        assert _collected(simhash.near_duplicates(documents), "doc_id", "fingerprint", "component_id") == wanted
    assert simhash.near_duplicates(nothing).count() == 0


def test_one_document_of_each_component_is_kept(spark):
    rng = random.Random(4)
    text, far, other = (" ".join(rng.choices("abcdefghijklmnop", k=400)) for _ in range(3))
    near = next(
        changed
        for at in range(400)
        for changed in [" ".join([*text.split()[:at], "z", *text.split()[at + 1 :]])]
        if 1 <= (_fingerprint(changed) ^ _fingerprint(text)).bit_count() <= 2
    )
    for rows in (
        # One id with two texts, and a near copy under another id.
        [(1, text), (1, far), (2, near), (3, other)],
        # No ids: near copies one or two bits apart.
        [(None, text), (None, near), (None, far), (None, other)],
    ):
        frame = spark.createDataFrame(rows, "doc_id long, text string")
        kept = corpus_pipeline.near_duplicates(spark, frame, "").collect()
        of_texts = collections.Counter("text" if row["text"] in (text, near) else row["text"] for row in kept)
        assert of_texts == {"text": 1, far: 1, other: 1}


def test_masks_cover_all_pairs_of_bits(spark, monkeypatch):
    kept = [mask & (2**64 - 1) for mask in simhash.masks()]
    assert len(kept) == 7
    for a in range(64):
        for b in range(64):
            assert any(not mask & (1 << a | 1 << b) for mask in kept)
    rng = random.Random(2)
    base = [rng.getrandbits(64) for _ in range(5)]
    values = {b ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for b in base for _ in range(80)} | set(base)
    signed = sorted(v - 2**64 if v >> 63 else v for v in values)
    wanted = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 2}
    frame = spark.createDataFrame([(v,) for v in signed], "fp long")
    for most in (10_000, 4):
        monkeypatch.setattr(simhash, "PAIRED_BUCKET", most)
        assert {tuple(row) for row in simhash.linked_pairs(frame).collect()} == wanted


def test_components_of_a_long_path(spark):
    pairs = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 102), (101, 102)], "a long, b long")
    got = {row["node"]: row["label"] for row in component_labels(pairs, "a", "b").collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100, 102: 100}


def test_sharding(spark, documents, rows, nothing):
    got = sharding.sharded(documents).collect()
    facts = collections.Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got)
    assert facts == collections.Counter((r[0], len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode())) for r in rows)
    slots = collections.defaultdict(list)
    for row in got:
        slots[row["shard"]].append(row["slot"])
        assert row["grown_shard"] in (row["shard"], sharding.SHARDS)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.sharded(nothing).count() == 0


def test_jump_hash_is_consistent_and_even():
    keys = np.random.default_rng(1).integers(0, 2**63, 60_000, dtype=np.uint64)
    for shards in (1, 5, 24):
        now, grown = sharding.jump_shards(keys, shards), sharding.jump_shards(keys, shards + 1)
        assert ((grown == now) | (grown == shards)).all()
        assert abs((grown == shards).mean() - 1 / (shards + 1)) < 0.01
        sizes = np.bincount(now, minlength=shards)
        assert sizes.max() / sizes.mean() < 1.1


def test_pipeline_stages(spark, documents, rows, tmp_path):
    folder = str(tmp_path)
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    long = next(row[1] for row in rows if row[1] and len(row[1]) > 300 and row[0] is not None)
    spark.createDataFrame([(1, " ".join(long.split(" ")[2:14]))], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = [stage(spark, docs, folder) for _, stage in corpus_pipeline.STAGES[:-1]]
    for frame in kept:
        assert frame.schema.names == docs.schema.names
        assert [f.dataType for f in frame.schema] == [f.dataType for f in docs.schema]
    near = simhash.near_duplicates(docs)
    groups = near.select(F.coalesce(F.col("component_id").cast("string"), "fingerprint")).distinct().count()
    assert kept[0].count() == len(rows) and kept[1].count() == groups
    clean = kept[2].select("text").collect()
    assert 0 < len(clean) < len(rows) and all(" ".join(long.split(" ")[2:14]) not in (row["text"] or "") for row in clean)
    packed = corpus_pipeline.run(spark, folder)
    assert isinstance(packed.schema["sequence_id"].dataType, T.LongType) and packed.count() > 0
