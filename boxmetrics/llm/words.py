"""Words of whole batches of texts as arrays: positions and 64-bit hashes, without a loop.

A hash is a polynomial over the bytes of a word modulo 2**64, from prefix sums, then mixed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Some twenty arrays of eight bytes for each of these are alive at once in every worker.
CHUNK_BYTES = 1 << 18

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE_VALUES = np.random.Generator(np.random.PCG64(20)).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BYTE_BASE = 0x9E3779B97F4A7C15 | 5
_WORD_BASE = 0xD1342543DE82EF95
_CHECK_BASE = 0xA0761D6478BD642F

_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64."""
    known = _tables.get(base)
    if known is None or len(known[0]) < size:
        length = max(size, CHUNK_BYTES + 1)
        known = tuple(_geometric(value, length) for value in (base, pow(base, -1, 1 << 64)))
        _tables[base] = known
    return known


def _geometric(value: int, length: int) -> np.ndarray:
    steps = np.full(length, value, dtype=np.uint64)
    steps[0] = 1
    return np.multiply.accumulate(steps)


def mixed(values: np.ndarray, salt: int = 0) -> np.ndarray:
    """A one-to-one scramble of 64-bit values."""
    values = values + np.uint64(salt)
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


@dataclass
class Words:
    """Words of some consecutive rows. Row r has the words first[r] to first[r + 1]."""

    row: int
    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    ids: np.ndarray

    def rows(self) -> np.ndarray:
        """Row of each word, counted from the first row of the chunk."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """First row, bytes and offsets of runs of rows that have about `limit` bytes."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.fill_null("").cast(pa.large_string())
    if not len(texts):
        return
    _, at, data = texts.buffers()
    offsets = np.frombuffer(at, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    content = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(texts):
        after = int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1
        after = min(max(after, row + 1), len(texts))
        yield row, content[offsets[row] : offsets[after]], offsets[row : after + 1] - offsets[row]
        row = after


def words_of(texts: pa.Array, lower: bool = False, limit: int = CHUNK_BYTES) -> Iterator[Words]:
    """Words `[^\\x20\\x09-\\x0D]+` of all rows, A-Z in lower case if asked for."""
    for row, data, offsets in chunks(texts, limit):
        if lower:
            data = _LOWER[data]
        inside = np.zeros(len(data) + 2, dtype=bool)
        inside[1:-1] = ~_SPACE[data]
        begins = inside[1:-1] & ~inside[:-2]
        ends = inside[1:-1] & ~inside[2:]
        filled = offsets[:-1][np.diff(offsets) > 0]
        begins[filled] = inside[1:-1][filled]
        last = offsets[1:][np.diff(offsets) > 0] - 1
        ends[last] = inside[1:-1][last]
        starts, ends = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        powers, inverse = _powers(_BYTE_BASE, len(data) + 1)
        sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(_BYTE_VALUES[data] * powers[: len(data)], out=sums[1:])
        ids = mixed((sums[ends] - sums[starts]) * inverse[starts])
        yield Words(row, data, offsets, starts, ends, np.searchsorted(starts, offsets), ids)


class Spans:
    """Hashes of any run of words, from prefix sums over their ids."""

    def __init__(self, ids: np.ndarray, *, check: bool = False) -> None:
        base = _CHECK_BASE if check else _WORD_BASE
        values = mixed(ids, 0x5851F42D4C957F2D) if check else ids
        powers, self._inverse = _powers(base, len(ids) + 1)
        self._sums = np.zeros(len(ids) + 1, dtype=np.uint64)
        np.cumsum(values * powers[: len(ids)], out=self._sums[1:])

    def hashed(self, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        return mixed((self._sums[start + length] - self._sums[start]) * self._inverse[start])
