"""Packing of token sequences: shortest-pack-first over the histogram of piece lengths.

A document is cut into pieces of the capacity and a tail. Only the histogram of lengths, at
most one count per possible length, reaches the driver. Lengths are placed longest first, each
into the packs that have the most room, and packs that look alike are kept as one pattern with
a count. Patterns are then joined back to the pieces by their rank among pieces of equal length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxmetrics.llm.common import keyed, numbered, stored
from boxmetrics.llm.words import Words, words_of

CAPACITY = 1024
END_ID = 0
#: A tail of this length or more is cut there: halves fill sequences exactly.
TAIL_CUT = 512
#: Words whose ids a task remembers.
REMEMBERED_WORDS = 500_000

PIECE = "array<struct<start: bigint, length: bigint, ids_crc32: bigint>>"

# Beginnings of the UTF-8 forms of white space beyond ASCII, and the rare ASCII ones. A text
# with any of them is encoded in one go.
_WIDE_SPACES = [
    b"\x1c", b"\x1d", b"\x1e", b"\x1f", b"\xc2\x85", b"\xc2\xa0",
    b"\xe1\x9a\x80", b"\xe2\x80", b"\xe2\x81\x9f", b"\xe3\x80\x80",
]
_GAPS = (0x20, 0x0A)


@dataclass(frozen=True)
class Vocabulary:
    """A byte-level vocabulary: its file of ranks, the pattern that parts a text, and its added
    tokens with their ids, which are found in texts before anything else."""

    path: str
    pattern: str
    added: tuple[tuple[str, int], ...] = ()


@lru_cache(maxsize=2)
def _encoding(vocabulary: Vocabulary):
    import base64

    import tiktoken

    with open(vocabulary.path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=vocabulary.pattern, mergeable_ranks=ranks, special_tokens=dict(vocabulary.added))


class TokenIds:
    """Token ids of whole chunks of texts, each distinct word encoded once.

    No token goes across a single space or line feed between other characters, so a word
    with the character before it can be encoded alone. Texts with other gaps or with an added
    token are encoded whole. Ids of up to REMEMBERED_WORDS words are kept in one flat array; a word is found
    there by its 64-bit hash.
    """

    def __init__(self, vocabulary: Vocabulary) -> None:
        self._encoding = _encoding(vocabulary)
        self._encoded = self._encoding.encode_ordinary
        if vocabulary.added:
            self._encoded = partial(self._encoding.encode, allowed_special="all")
        self._breaks = [*_WIDE_SPACES, *[token.encode() for token, _ in vocabulary.added]]
        (self._line_feed,) = self._encoding.encode_ordinary("\n")
        self._forget()

    def _forget(self) -> None:
        self._known = np.zeros(0, dtype=np.uint64)
        self._begin = np.zeros(0, dtype=np.int64)
        self._size = np.zeros(0, dtype=np.int64)
        self._pool = np.zeros(0, dtype=np.uint32)

    def _learn(self, keys: np.ndarray, words: list[bytes]) -> None:
        spaced = np.array([word[:1] == b" " for word in words])
        ids, begin, size = [], np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        at = len(self._pool)
        for place in np.flatnonzero(~spaced).tolist():
            part = np.array(self._encoding.encode_ordinary(words[place].decode()), dtype=np.uint32)
            begin[place], size[place] = at, len(part)
            at += len(part)
            ids.append(part)
        if spaced.any():
            # A line feed before a space is a token of its own: it shows where a word ends.
            text = b"\n".join([*[word for word in words if word[:1] == b" "], b""]).decode()
            joined = np.array(self._encoding.encode_ordinary(text), dtype=np.uint32)
            ends = np.flatnonzero(joined == self._line_feed)
            first = np.r_[0, ends[:-1] + 1]
            begin[spaced], size[spaced] = first + at, ends - first
            ids.append(joined)
        self._pool = np.concatenate([self._pool, *ids])
        order = np.argsort(all_keys := np.r_[self._known, keys], kind="stable")
        self._known = all_keys[order]
        self._begin = np.r_[self._begin, begin][order]
        self._size = np.r_[self._size, size][order]

    def _found(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the keys among the known ones, and which of them are known."""
        if not len(self._known):
            return np.zeros(len(keys), dtype=np.int64), np.zeros(len(keys), dtype=bool)
        at = np.minimum(np.searchsorted(self._known, keys), len(self._known) - 1)
        return at, self._known[at] == keys

    def of(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """Ids of each text, in order."""
        texts = texts.fill_null("").cast(pa.large_string())
        for words in words_of(texts):
            yield from self._chunk(texts, words)

    def _chunk(self, texts: pa.Array, words: Words) -> Iterator[np.ndarray]:
        n_rows, data = len(words.first) - 1, words.data
        row = words.rows()
        opens = np.zeros(len(words.ids), dtype=bool)
        opens[words.first[:-1][np.diff(words.first) > 0]] = True
        before = np.r_[0, words.ends[:-1]]
        before[opens] = words.offsets[row[opens]]
        gap = words.starts - before
        lead = data[np.maximum(words.starts - 1, 0)]
        plain = np.where(opens, gap == 0, (gap == 1) & np.isin(lead, _GAPS))
        whole = np.zeros(n_rows, dtype=bool)
        whole[row[~plain]] = True
        filled = np.diff(words.first) > 0
        trailing = words.offsets[1:][filled] != words.ends[words.first[1:][filled] - 1]
        whole[np.flatnonzero(filled)[trailing]] = True
        whole |= ~filled
        content = data.tobytes()
        if any(mark in content for mark in self._breaks):
            for at in range(n_rows):
                piece = content[words.offsets[at] : words.offsets[at + 1]]
                whole[at] |= any(mark in piece for mark in self._breaks)

        simple = ~whole[row]
        starts = (words.starts - ~opens)[simple]
        ends = words.ends[simple]
        keys = words.ids[simple] + np.where(opens, 0, lead)[simple].astype(np.uint64)
        distinct, where, each = np.unique(keys, return_index=True, return_inverse=True)
        if len(self._known) + len(distinct) > REMEMBERED_WORDS:
            self._forget()
        at, known = self._found(distinct)
        if not known.all():
            new = where[~known]
            self._learn(distinct[~known], [content[a:b] for a, b in zip(starts[new].tolist(), ends[new].tolist())])
            at, _ = self._found(distinct)
        at = at[each]
        sizes = self._size[at]
        ends_at = np.cumsum(sizes)
        step = np.arange(ends_at[-1] if len(ends_at) else 0) - np.repeat(ends_at - sizes, sizes)
        ids = self._pool[np.repeat(self._begin[at], sizes) + step]
        per_row = np.bincount(row[simple], weights=sizes, minlength=n_rows).astype(np.int64)
        bounds = np.r_[0, np.cumsum(per_row)]
        for at_row in range(n_rows):
            if whole[at_row]:
                text = texts[words.row + at_row].as_py()
                yield np.array(self._encoded(text), dtype=np.uint32)
            else:
                yield ids[bounds[at_row] : bounds[at_row + 1]]


@lru_cache(maxsize=2)
def _ids(vocabulary: Vocabulary) -> TokenIds:
    return TokenIds(vocabulary)


def cuts(tokens: int, capacity: int = CAPACITY, tail_cut: int = TAIL_CUT) -> list[tuple[int, int]]:
    """Start and length of the pieces of a document."""
    whole = tokens - tokens % capacity
    pieces = [(start, capacity) for start in range(0, whole, capacity)]
    rest = tokens - whole
    if rest > tail_cut:
        pieces.append((whole, tail_cut))
        whole, rest = whole + tail_cut, rest - tail_cut
    if rest:
        pieces.append((whole, rest))
    return pieces


def with_pieces(documents: DataFrame, vocabulary: Vocabulary, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: key, `doc_tokens`, `start`, `length`, `ids_crc32`."""

    @F.arrow_udf(PIECE)
    def pieces(texts: pa.Array) -> pa.Array:
        made = []
        for numbers in _ids(vocabulary).of(texts):
            ids = np.r_[numbers, END_ID].astype("<u4").tobytes()
            made.append(
                [
                    {"start": start, "length": length, "ids_crc32": zlib.crc32(ids[4 * start : 4 * (start + length)])}
                    for start, length in cuts(len(ids) // 4, capacity)
                ]
            )
        kind = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
        return pa.array(made, pa.list_(kind))

    cut = documents.withColumn("pieces", pieces("text"))
    # No list is empty. A plain inline would make Spark infer a filter on the size of the
    # list and, to evaluate it below the projection, run the function a second time.
    last = F.element_at("pieces", -1)
    return cut.select(
        "doc_id",
        "text_hash",
        (last["start"] + last["length"]).alias("doc_tokens"),
        F.inline_outer("pieces"),
    )


@dataclass(frozen=True)
class Pattern:
    """Packs that hold the same lengths: (length, times) pairs, longest first."""

    content: tuple[tuple[int, int], ...]
    count: int


def packed_patterns(histogram: dict[int, int], capacity: int = CAPACITY) -> list[Pattern]:
    """Patterns that hold every piece of the histogram once.

    Each length goes to the packs with the most room, as long as it fits. A step either uses
    up a group of equal packs or ends the length, which keeps the number of patterns within
    twice the number of lengths.
    """
    open_packs: dict[int, list[tuple[tuple[tuple[int, int], ...], int]]] = {}
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            room = max((space for space in open_packs if open_packs[space]), default=0)
            if room < length:
                times = capacity // length
                packs, odd = divmod(left, times)
                for count, each in ((packs, times), (1, odd)):
                    if count and each:
                        content = ((length, each),)
                        open_packs.setdefault(capacity - each * length, []).append((content, count))
                break
            content, count = open_packs[room].pop()
            # As often as it fits, but never beyond what evens the packs of this pattern.
            times = max(1, min(room // length, left // count))
            used = min(count, left // times)
            grown = (*content, (length, times))
            open_packs.setdefault(room - times * length, []).append((grown, used))
            if used < count:
                open_packs[room].append((content, count - used))
            left -= used * times
    return [Pattern(content, count) for packs in open_packs.values() for content, count in packs]


def placements(patterns: list[Pattern]) -> list[tuple[int, int, int, int, int, int]]:
    """For runs of ranks within a length: where their sequences and offsets begin.

    Rows are (length, first rank, rank after the last, first sequence, packs, first offset).
    """
    rows, ranks, sequence = [], {}, 0
    for pattern in patterns:
        offset = 0
        for length, times in pattern.content:
            first = ranks.get(length, 0)
            ranks[length] = first + times * pattern.count
            rows.append((length, first, ranks[length], sequence, pattern.count, offset))
            offset += length * times
        sequence += pattern.count
    return rows


def packed(documents: DataFrame, vocabulary: Vocabulary, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of all documents with their place in a sequence.

    Null and empty texts consist of the end id alone. Every row of the input is packed, and
    repeated rows too. Sequences are numbered from 0, offsets in them are gapless. Other
    columns are ignored.
    """
    pieces = stored(with_pieces(keyed(documents), vocabulary, capacity), "pieces")
    histogram = {row["length"]: row["n"] for row in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    # The capacity bounds this table: two patterns per length, 44 different lengths in each.
    places = documents.sparkSession.createDataFrame(
        placements(packed_patterns(histogram, capacity)),
        "at long, first long, after long, sequence long, packs long, begins long",
    )
    ranked = numbered(pieces, "length", ["doc_id", "text_hash", "start"], "rank")
    here = (
        (F.col("length") == F.col("at")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("after"))
    )
    within = F.col("rank") - F.col("first")
    return ranked.join(F.broadcast(places), here).select(
        "doc_id",
        "start",
        "length",
        "ids_crc32",
        "doc_tokens",
        (F.col("sequence") + F.pmod(within, F.col("packs"))).alias("sequence_id"),
        (F.col("begins") + F.floor(within / F.col("packs")) * F.col("length")).cast("long").alias("offset"),
    )
