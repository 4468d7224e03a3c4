"""Secret scans: linked parts of any length, and many matches in a text."""

from __future__ import annotations

import collections
import hashlib
import random
import re
import time

import duckdb
import pytest

from boxmetrics.llm import secrets, sql

SCHEMA = "doc_id long, text string"
WORD = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""


def _spans(text):
    """All spans by the definitions, with every pair of parts looked at."""
    text = text or ""
    base = [(m.start(), 0, m.end(), "assign") for m in re.finditer(WORD, text, re.I | re.A) if len(m[2]) >= 6]
    base += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    base += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    weak = []
    for rank, (kind, pattern) in enumerate(secrets.WEAK.items(), 3):
        for m in re.finditer(pattern, text):
            if not any(m.start() < b[2] and b[0] < m.end() for b in base):
                weak.append((m.start(), rank, m.end(), kind))
    parts = [(s, e, secrets.PART_OF_BASE.get(kind, kind)) for s, _, e, kind in base + weak]
    linked = [w for w in weak if any(k in secrets.COMPLEMENTS[w[3]] and s <= w[2] + 200 and e >= w[0] - 200 for s, e, k in parts)]
    return sorted(base), sorted(base + linked)


def _listed(spans):
    return ",".join(f"{kind}:{start}:{end}" for start, _, end, kind in spans)


def _expected(rows):
    found = collections.Counter()
    for doc_id, text in rows:
        base, every = _spans(text)
        kinds = collections.Counter(span[3] for span in base)
        digest = hashlib.sha256(_listed(base).encode()).hexdigest()
        found[doc_id, kinds["assign"], kinds["access"], kinds["hex"], digest, _listed(every)] += 1
    return found


def _texts():
    rng = random.Random(6)
    parts = [
        "ACCOUNTNAME01", "https://db.example.org/x", "aB3" + "dE5f" * 6, "token: " + "x" * 600, "0af9" * 8, "AKIA" + "Z" * 16,
        "secret=ab", "password='hunter2hunter2'", "https://h.example.org/" + "p" * 350, "aB3" + "dE5f" * 120, "é", "漢字 " * 20, "word " * 38,
    ]
    return [rng.choice([" ", "\n", "  "]).join(rng.choices(parts, k=rng.randrange(12))) for _ in range(150)]


def test_all_pairs_of_parts(spark):
    rows = [(n if n % 10 else None, text) for n, text in enumerate(_texts())] + [(500, None), (501, "")]
    rows += rows[3:6] * 4
    got = secrets.secrets(spark.createDataFrame(rows, SCHEMA))
    assert collections.Counter(map(tuple, got.collect())) == _expected(rows)


def test_sql_measures_between_spans(spark):
    rows = list(enumerate(_texts()))
    connection = duckdb.connect()
    connection.register("documents", spark.createDataFrame(rows, SCHEMA).toArrow())
    columns = "doc_id, n_assign, n_access, n_hex, base_sha256, spans"
    assert collections.Counter(connection.sql(f"SELECT {columns} FROM ({sql.op2()})").fetchall()) == _expected(rows)


@pytest.mark.parametrize("gap, linked", [(1, True), (200, True), (201, False)])
def test_a_long_part_is_linked_from_its_end(spark, gap, linked):
    text = "token: " + "x" * 600 + " " * gap + "https://db.example.org/x"
    [row] = secrets.secrets(spark.createDataFrame([(1, text)], SCHEMA)).collect()
    wanted = f"assign:0:607,endpoint:{607 + gap}:{631 + gap}" if linked else "assign:0:607"
    assert row["spans"] == wanted


def test_many_matches_in_a_text(spark):
    lines = 200_000
    text = "token=abcdefgh\n" * lines + "ACCOUNTNAME01"
    began = time.monotonic()
    [row] = secrets.secrets(spark.createDataFrame([(1, text)], SCHEMA)).collect()
    assert row["n_assign"] == lines and row["spans"].endswith("identifier:3000000:3000013")
    assert time.monotonic() - began < 60


def test_a_million_words(spark):
    words = ["plain", "words", "here", "ACCOUNTNAME01", "https://db.example.org/x"]
    text = " ".join(random.Random(1).choices(words, [60, 60, 60, 1, 1], k=1_000_000))
    [row] = secrets.secrets(spark.createDataFrame([(1, text)], SCHEMA)).collect()
    assert row["n_assign"] == 0
    found = [(m.start(), m.end(), m[0][0] == "h") for m in re.finditer(r"ACCOUNTNAME01|https://\S+", text)]
    wanted = []
    for at, (start, end, kind) in enumerate(found):
        # The next part of the other kind on either side decides.
        before = next((one for one in reversed(found[max(0, at - 50) : at]) if one[2] != kind), None)
        after = next((one for one in found[at + 1 : at + 50] if one[2] != kind), None)
        if before and before[1] >= start - 200 or after and after[0] <= end + 200:
            wanted.append(f"{'endpoint' if kind else 'identifier'}:{start}:{end}")
    assert row["spans"] == ",".join(wanted) and len(wanted) > 3000
