"""Counts of texts by a table-driven byte transducer, with their distinct words.

The transducer reads UTF-8 bytes and has two states, outside and inside of a word. Which state
follows depends on the class of the byte alone, so the state before each byte is known from the
byte before it, and the tables are applied to whole blocks of bytes at once. What it emits is
counted per text, and the spans of words go into a hash table. A word counts as seen before
only if its bytes agree with those of the word in the table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from boxmetrics.llm.words import mixed

BLOCK_BYTES = 1 << 20

# The classes of bytes, and what the filters look for.
SYMBOLS = b"#$%&*|"
_SPACE, _FOLLOWS, _OTHER, _CAPITAL, _SYMBOL = range(5)
_CLASS = np.full(256, _OTHER, dtype=np.uint8)
_CLASS[[0x20, *range(0x09, 0x0E)]] = _SPACE
_CLASS[0x80:0xC0] = _FOLLOWS
_CLASS[ord("A") : ord("Z") + 1] = _CAPITAL
_CLASS[list(SYMBOLS)] = _SYMBOL

# States, the one that follows each class, and what is emitted in a state for a class.
_OUTSIDE, _INSIDE = 0, 1
_STATE_AFTER = np.array([_OUTSIDE, _INSIDE, _INSIDE, _INSIDE, _INSIDE], dtype=np.uint8)
POINT, CAPITAL, SYMBOL, BEGIN, END = 1, 2, 4, 8, 16
_EMITTED = np.zeros((2, 5), dtype=np.uint8)
_EMITTED[:, [_SPACE, _OTHER, _CAPITAL, _SYMBOL]] = POINT
_EMITTED[:, _CAPITAL] |= CAPITAL
_EMITTED[:, _SYMBOL] |= SYMBOL
_EMITTED[_OUTSIDE, 1:] |= BEGIN
_EMITTED[_INSIDE, _SPACE] |= END

_BASE = 0x9E3779B97F4A7C15 | 5
_BYTE = np.random.Generator(np.random.PCG64(12)).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)


class SpanTable:
    """An open-addressing hash table of spans in one buffer of bytes, each of some row.

    Spans are added in bulk. In each round every open span looks at its slot: if that is empty
    one of them takes it, and the others there compare themselves with the span that has it,
    row, length and bytes. Those that differ go on to the next slot.
    """

    def __init__(self, data: np.ndarray) -> None:
        self._data = data
        self._empty(1 << 10)
        self.size = 0

    def _empty(self, slots: int) -> None:
        self._row = np.full(slots, -1, dtype=np.int64)
        self._start = np.zeros(slots, dtype=np.int64)
        self._length = np.zeros(slots, dtype=np.int64)
        self._hash = np.zeros(slots, dtype=np.uint64)

    def add(self, row: np.ndarray, start: np.ndarray, length: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """Which of the spans are new; of equal ones among them, one is."""
        if 2 * (self.size + len(row)) > len(self._row):
            kept = self._row >= 0
            old = [column[kept] for column in (self._row, self._start, self._length, self._hash)]
            self._empty(1 << (4 * (self.size + len(row))).bit_length())
            self._insert(*old, verified=True)
        new = self._insert(row, start, length, hashes, verified=False)
        self.size += int(new.sum())
        return new

    def _insert(self, row, start, length, hashes, *, verified: bool) -> np.ndarray:
        """With `verified`, the spans are known to be distinct."""
        mask = len(self._row) - 1
        new = np.zeros(len(row), dtype=bool)
        slot = (hashes & np.uint64(mask)).astype(np.int64)
        left = np.arange(len(row))
        while len(left):
            at = slot[left]
            free = self._row[at] < 0
            asking = left[free]
            self._start[at[free]] = asking
            won = asking[self._start[at[free]] == asking]
            taken = slot[won]
            self._row[taken], self._start[taken] = row[won], start[won]
            self._length[taken], self._hash[taken] = length[won], hashes[won]
            new[won] = True
            left = left[~new[left]]
            if not verified:
                at = slot[left]
                alike = (self._row[at] == row[left]) & (self._length[at] == length[left]) & (self._hash[at] == hashes[left])
                same = np.zeros(len(left), dtype=bool)
                same[alike] = self._equal(start[left[alike]], self._start[at[alike]], length[left[alike]])
                left = left[~same]
            slot[left] = (slot[left] + 1) & mask
        return new

    def _equal(self, one: np.ndarray, other: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether the bytes of two spans of equal length agree, a bounded number at a time."""
        result = np.ones(len(one), dtype=bool)
        ends = np.cumsum(length)
        at = 0
        while at < len(one):
            done = ends[at] - length[at]
            after = max(int(np.searchsorted(ends, done + BLOCK_BYTES, side="right")), at + 1)
            part, begins = slice(at, after), ends[at:after] - length[at:after] - done
            step = np.arange(int(ends[after - 1] - done)) - np.repeat(begins, length[part])
            first, second = np.repeat(one[part], length[part]) + step, np.repeat(other[part], length[part]) + step
            result[part] = np.logical_and.reduceat(self._data[first] == self._data[second], begins)
            at = after
        return result


def span_hashes(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span."""
    begins = np.cumsum(length) - length
    step = np.arange(int(length.sum())) - np.repeat(begins, length)
    powers = np.full(int(length.max()), _BASE, dtype=np.uint64)
    powers[0] = 1
    powers = np.multiply.accumulate(powers)
    values = _BYTE[data[np.repeat(start, length) + step]] * powers[step]
    return mixed(np.add.reduceat(values, begins))


def _blocks(offsets: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """(first row, row after the last, begin, end): runs of rows, or parts of one long row."""
    row, rows = 0, len(offsets) - 1
    while row < rows:
        after = int(np.searchsorted(offsets, offsets[row] + BLOCK_BYTES, side="right")) - 1
        if after > row:
            yield row, after, int(offsets[row]), int(offsets[after])
            row = after
        else:
            for at in range(int(offsets[row]), int(offsets[row + 1]), BLOCK_BYTES):
                yield row, row + 1, at, min(at + BLOCK_BYTES, int(offsets[row + 1]))
            row += 1


def counted(texts: pa.Array) -> np.ndarray:
    """Words, distinct words, capitals, code points and symbols of each text, as columns."""
    texts = texts.fill_null("").cast(pa.large_string())
    rows = len(texts)
    result = np.zeros((rows, 5), dtype=np.int64)
    if not rows:
        return result
    _, at, buffer = texts.buffers()
    offsets = np.frombuffer(at, dtype=np.int64)[texts.offset : texts.offset + rows + 1]
    data = np.frombuffer(buffer, dtype=np.uint8) if buffer is not None else np.zeros(0, np.uint8)
    table, table_rows, opened = None, (0, 0), -1
    for first, after, begin, end in _blocks(offsets):
        if end == begin:
            continue
        kind = _CLASS[data[begin:end]]
        # The state before a byte; a text begins outside, a further part of one where it was.
        state = np.empty(len(kind), dtype=np.uint8)
        state[1:] = _STATE_AFTER[kind[:-1]]
        row_begins = offsets[first:after][offsets[first:after] < offsets[first + 1 : after + 1]]
        state[row_begins[row_begins >= begin] - begin] = _OUTSIDE
        if begin > offsets[first]:
            state[0] = _OUTSIDE if opened < 0 else _INSIDE
        emitted = _EMITTED[state, kind]
        bounds = np.clip(offsets[first : after + 1], begin, end) - begin
        for column, event in ((0, BEGIN), (2, CAPITAL), (3, POINT), (4, SYMBOL)):
            sums = np.r_[0, np.cumsum((emitted & event) != 0, dtype=np.int64)]
            result[first:after, column] += sums[bounds[1:]] - sums[bounds[:-1]]

        starts = np.flatnonzero(emitted & BEGIN) + begin
        ends = np.flatnonzero(emitted & END) + begin
        # The end of a row ends its word, unless more of the row follows.
        last = offsets[first + 1 : after + 1][offsets[first:after] < offsets[first + 1 : after + 1]]
        last = last[last <= end]
        last = last[_CLASS[data[last - 1]] != _SPACE]
        ends = np.sort(np.r_[ends, last])
        if opened >= 0:
            starts = np.r_[opened, starts]
        opened = int(starts[-1]) if len(starts) > len(ends) else -1
        starts = starts[: len(ends)]
        if not len(starts):
            continue
        if (first, after) != table_rows or table is None:
            table, table_rows = SpanTable(data), (first, after)
        row = np.searchsorted(offsets, starts, side="right") - 1
        length = ends - starts
        new = table.add(row, starts, length, span_hashes(data, starts, length))
        result[first:after, 1] += np.bincount(row[new] - first, minlength=after - first)
    return result
