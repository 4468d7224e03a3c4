"""The tokenization automaton against the tokenizer itself."""

from __future__ import annotations

import hashlib
import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from boxmetrics.llm import tokenization
from boxmetrics.llm.tokenization import Automaton

PATH = str(public_tokenizers.path("byte_bpe_50k.json"))
SCHEMA = "doc_id long, text string"
ODD = [
    None,
    "",
    " ",
    "  \n\t ",
    "one",
    "it's we'll  they're",
    "one doc ends.<|endoftext|>next begins",
    "<|endoftext|><|endoftext|> <|endoftext|",
    "x" * 5000,
    " " * 3000 + "a",
    "𝒳 漢字 ١٢٣ é é    \x85\x1c\x00",
    "".join(map(chr, range(0x1680, 0x3001, 7))),
]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(PATH)
    made.no_truncation()
    made.no_padding()
    return made


def _random_text(rng: random.Random) -> str:
    ranges = [(32, 127), (97, 105), (9, 33), (0x80, 0x800), (0x800, 0xD800), (0xE000, 0x110000)]
    return "".join(chr(rng.randrange(*rng.choices(ranges, [5, 5, 2, 2, 1, 1])[0])) for _ in range(rng.randrange(60)))


def test_ids_and_texts_are_those_of_the_library(library):
    rng = random.Random(11)
    texts = [text for text in ODD if text] + [_random_text(rng) for _ in range(4000)]
    own = tokenization.tokenizer(PATH)
    for text, wanted in zip(texts, library.encode_batch(texts, add_special_tokens=False)):
        assert own.ids(text) == wanted.ids, text
        assert own.text(wanted.ids) == library.decode(wanted.ids, skip_special_tokens=False) == text


def test_any_ids_are_decoded(library):
    rng = random.Random(12)
    own = tokenization.tokenizer(PATH)
    for _ in range(2000):
        ids = [rng.choice([rng.randrange(256), rng.randrange(50257)]) for _ in range(rng.randrange(12))]
        assert own.text(ids) == library.decode(ids, skip_special_tokens=False)


def _merged(word: bytes, merges: list[tuple[bytes, bytes]]) -> list[bytes]:
    """The merges one after the other, each from left to right."""
    parts = [word[at : at + 1] for at in range(len(word))]
    for left, right in merges:
        at = 0
        while at + 1 < len(parts):
            if (parts[at], parts[at + 1]) == (left, right):
                parts[at : at + 2] = [left + right]
            at += 1
    return parts


def test_automaton_of_any_merges():
    """Few letters and random merges: runs of one letter, tokens that are never reached."""
    for seed in range(300):
        rng = random.Random(seed)
        letters = [bytes([byte]) for byte in b"abc"[: rng.choice([1, 2, 3])]]
        tokens, merges = list(letters), []
        for _ in range(rng.randrange(1, 14)):
            pair = (rng.choice(tokens), rng.choice(tokens))
            if b"".join(pair) not in tokens:
                tokens.append(b"".join(pair))
                merges.append(pair)
        # Tokens that no path has are not merged further.
        vocabulary = {bytes([byte]): byte for byte in range(256)}
        vocabulary |= {token: 256 + at for at, token in enumerate(tokens) if len(token) > 1}
        automaton = Automaton(vocabulary, merges)
        for _ in range(60):
            word = b"".join(rng.choices(letters, k=rng.randrange(1, 14)))
            path = [automaton.label[token] for token in automaton.path(word)]
            assert path == _merged(word, merges), (merges, word)


def test_long_texts_go_in_blocks(library, monkeypatch):
    rng = random.Random(13)
    text = " ".join(_random_text(rng) + "\n" * rng.randrange(3) for _ in range(400)) + "<|endoftext|> end"
    own = tokenization.tokenizer(PATH)
    wanted = own.digests(text)
    monkeypatch.setattr(tokenization, "_LONG_TEXT", 10)
    monkeypatch.setattr(tokenization, "BLOCK_WORDS", 7)
    assert own.digests(text) == wanted
    assert own.ids(text) == library.encode(text, add_special_tokens=False).ids


def test_little_is_remembered(library, monkeypatch):
    monkeypatch.setattr(tokenization, "REMEMBERED", 5)
    own = tokenization.Tokenizer(PATH)
    text = "some quite unusual wordings xqzt need transitions, repeatedly: xqzt wordings"
    for _ in range(2):
        assert own.ids(text) == library.encode(text, add_special_tokens=False).ids
    assert len(own._paths) <= 5


def test_a_million_words(library):
    rng = random.Random(14)
    words = ["".join(rng.choices("abcdefgh", k=rng.randrange(1, 9))) for _ in range(5000)]
    text = " ".join(rng.choices(words, k=1_000_000))
    number, ids, decoded = tokenization.tokenizer(PATH).digests(text)
    wanted = library.encode(text, add_special_tokens=False).ids
    assert number == len(wanted)
    assert ids == hashlib.sha256(",".join(map(str, wanted)).encode()).hexdigest()
    assert decoded == hashlib.sha256(text.encode()).hexdigest()


def _expected(library, rows):
    found = []
    for doc_id, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        digests = [hashlib.sha256(part.encode()).hexdigest() for part in (",".join(map(str, ids)), back)]
        found.append((doc_id, len(ids), *digests))
    return sorted(found, key=str)


def test_query_on_odd_rows(spark, library):
    rows = [(at % 9 if at % 4 else None, text) for at, text in enumerate(ODD)]
    rows += rows[4:7] + rows[4:7]
    frame = spark.createDataFrame(rows, SCHEMA).withColumns({name: F.lit("other") for name in ("ids", "r", "n_tokens")})
    got = tokenization.round_trips(frame, PATH)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == _expected(library, rows)
    both = tokenization.encoded(frame, PATH).withColumn("back", tokenization.decoded_text(F.col("ids"), PATH))
    assert all(row["back"] == row["text"] for row in both.collect())
    nothing = spark.createDataFrame([], SCHEMA)
    assert tokenization.round_trips(nothing, PATH).collect() == []


def test_other_vocabularies_are_refused(tmp_path):
    import json

    with open(PATH, encoding="utf-8") as file:
        content = json.load(file)
    content["normalizer"] = {"type": "NFC"}
    (tmp_path / "other.json").write_text(json.dumps(content))
    with pytest.raises(ValueError, match="byte-level"):
        tokenization.Tokenizer(str(tmp_path / "other.json"))


def test_whole_tables(spark, library):
    folder = "/root/testdata/sf0.01"
    from boxmetrics.llm import queries

    rows = [tuple(row) for row in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.op11_tokenization(spark, folder).collect()
    assert sorted(map(tuple, got), key=str) == _expected(library, rows)
