"""Scores of a word n-gram model by deleted interpolation.

The chance of a word is a mixture of its bigram, unigram and uniform estimates; each further
order mixes its estimate with the chance by the orders below. The weights depend on how often the
context was seen: contexts with counts of equal binary logarithm share a bucket.
Expectation-maximisation learns the weights on training documents that are held out of the
counts (one in DELETED), order by order; scores then use the counts of all training documents.
Documents outside of training are only scored.

Counting and looking up go by blocks of documents and ranges of hashes: a block asks for its
distinct words and word pairs once, sorted, and each range answers all blocks in that order.
So a hot word costs a block one entry, and what is shuffled are packed arrays.

A block is cut into at most FAN_OUT ranges, whatever the input. Where that is too few, ranges
are cut again, level by level: the same range of some blocks is merged, the merged keys are cut
into finer ranges, and answers go back the same way. So the number of packed arrays grows with
the input, not with its square.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxmetrics.llm.common import keyed, small_or_merged, stored, with_results
from boxmetrics.llm.words import mixed, words_of

FOLDS, HELD_OUT = 7, 2
#: One of so many training documents is held out of the counts to learn the weights.
DELETED = 8
BLOCK_BYTES = 16 * 1024 * 1024
RANGE_BYTES = 32 * 1024 * 1024
#: At most so many ranges of a block, or of a merged range.
FAN_OUT = 1024
#: Rows equal in id and text that have more bytes than this together are counted as one row.
REPEATED_BYTES = 2 * 1024 * 1024
_ROUNDS = 60
_BUCKETS = 40
#: Steps per natural logarithm in which ratios of estimates are counted.
_STEPS = 4
_NEVER = -999
_START, _END = np.uint64(0x51A7), np.uint64(0xE4D)
_PAIR = np.uint64(0xC2B2AE3D27D4EB4F)
#: The longest n-grams that are counted, in words.
ORDER = 2


def _packed(values: np.ndarray) -> bytes:
    """Arrays of integers with their equal high bytes side by side, compressed."""
    size = values.dtype.itemsize
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(-1, size).T)
    return zstandard.ZstdCompressor(1).compress(planes.tobytes())


def _unpacked(data: bytes, dtype: type) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8)
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).reshape(-1).view(dtype)


@dataclass
class Tokens:
    """Tokens of a block: documents end to end, each with its end token.

    `longer` has the places of n-grams of three and more words, and of their contexts.
    """

    keys: np.ndarray
    word: np.ndarray
    pair: np.ndarray
    context: np.ndarray
    longer: list[tuple[np.ndarray, np.ndarray]]
    row: np.ndarray
    first: np.ndarray


def tokens_of(texts: pa.Array, order: int = ORDER) -> Tokens:
    """Sorted distinct keys of words (even) and longer n-grams (odd), and where each token's are."""
    ids, sizes = [], []
    for words in words_of(texts, lower=True):
        ids.append(words.ids)
        sizes.append(np.diff(words.first))
    words, size = np.concatenate([*ids, np.zeros(0, np.uint64)]), np.concatenate([*sizes, np.zeros(0, np.int64)])
    first = np.r_[0, np.cumsum(size + 1)]
    row = np.repeat(np.arange(len(size)), size + 1)
    token = np.full(first[-1], _END, dtype=np.uint64)
    last = np.zeros(first[-1], dtype=bool)
    last[first[1:] - 1] = True
    token[~last] = words
    before = np.r_[_START, token[:-1]]
    before[first[:-1]] = _START
    one = np.uint64(1)
    word = mixed(token) & ~one
    pair = mixed(before * _PAIR + token, 77) | one
    # The start was seen as often as the end.
    end = mixed(np.array([_END])) & ~one
    context = np.where(before == _START, end[0], mixed(before)) & ~one
    grams, contexts = [word, pair], []
    for words_of_gram in range(3, order + 1):
        previous = np.r_[end, grams[-1][:-1]]
        previous[first[:-1]] = end
        contexts.append(previous)
        grams.append(mixed(previous * _PAIR + token, 75 + words_of_gram) | one)
    keys, where = np.unique(np.r_[(*grams, end)], return_inverse=True)
    places = where[:-1].reshape(len(grams), len(token))
    longer = [(gram, np.searchsorted(keys, previous)) for gram, previous in zip(places[2:], contexts)]
    return Tokens(keys, places[0], places[1], np.searchsorted(keys, context), longer, row, first)


def cuts(ranges: int, fan_out: int) -> tuple[int, int]:
    """Levels, and into how many parts each of them cuts a range, for so many ranges at least."""
    levels = 1
    while fan_out**levels < ranges:
        levels += 1
    parts = max(1, int(ranges ** (1 / levels)))
    while parts**levels < ranges:
        parts += 1
    return levels, parts


def _cells(keys: np.ndarray, seen: np.ndarray, modelled: np.ndarray, ranges: int) -> Iterator[tuple]:
    """Sorted keys and their counts by range. Ranges of a finer cut lie within those of a coarser."""
    of_key = (keys >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)
    numbers, first = np.unique(of_key, return_index=True)
    for number, begin, end in zip(numbers.tolist(), first, [*first[1:], len(keys)]):
        part = slice(begin, end)
        steps = np.diff(keys[part], prepend=np.uint64(0))
        yield number, _packed(steps), _packed(seen[part]), _packed(modelled[part])


_COUNTS = "block long, range int, keys binary, seen binary, modelled binary"
_ANSWERS = "block long, range int, seen binary, modelled binary"
_TOTALS = f"{_ANSWERS}, v long, n long, n_modelled long"


def block_counts(block: int, table: pa.Table, ranges: int, order: int) -> Iterator[tuple]:
    tokens = tokens_of(table["text"], order)
    times = np.where(table["learns"].to_numpy(), table["times"].to_numpy(), 0)[tokens.row]
    size = len(tokens.keys)
    # Sums in float are exact up to 2**53.
    grams = [tokens.word, tokens.pair, *[gram for gram, _ in tokens.longer]]
    seen = sum(np.bincount(where, times, size) for where in grams).astype(np.uint64)
    modelled = np.zeros_like(seen) if table["deleted"][0].as_py() else seen
    for number, *arrays in _cells(tokens.keys, seen, modelled, ranges):
        yield block, number, *arrays


@dataclass
class Merged:
    """Distinct keys of some cells with their sums, and where each cell's keys are among them."""

    keys: np.ndarray
    places: list[np.ndarray]
    seen: np.ndarray
    modelled: np.ndarray


def merged(table: pa.Table) -> Merged:
    own = [np.cumsum(_unpacked(data.as_py(), np.uint64), dtype=np.uint64) for data in table["keys"]]
    keys, where = np.unique(np.concatenate(own), return_inverse=True)
    sums = []
    for name in ("seen", "modelled"):
        values = np.concatenate([_unpacked(data.as_py(), np.uint64) for data in table[name]])
        sums.append(np.bincount(where, values, len(keys)).astype(np.uint64))
    return Merged(keys, np.split(where, np.cumsum([len(part) for part in own])[:-1]), *sums)


def finer_counts(block: int, table: pa.Table, ranges: int) -> Iterator[tuple]:
    """One range of some blocks, merged and cut into finer ranges."""
    found = merged(table)
    for number, *arrays in _cells(found.keys, found.seen, found.modelled, ranges):
        yield block, number, *arrays


def coarser_answers(table: pa.Table, answers: pa.Table) -> Iterator[tuple]:
    """The sums for one range of some blocks, for each in its order, from those of its finer ranges."""
    found = merged(table)
    seen, modelled = _in_order(answers, len(found.keys))
    for block, number, mine in zip(table["block"].to_pylist(), table["range"].to_pylist(), found.places):
        yield block, number, _packed(seen[mine]), _packed(modelled[mine])


def _in_order(answers: pa.Table, size: int) -> list[np.ndarray]:
    order = np.argsort(answers["range"].to_numpy())
    sums = [
        np.concatenate([np.zeros(0, np.uint64), *[_unpacked(answers[name][int(i)].as_py(), np.uint64) for i in order]])
        for name in ("seen", "modelled")
    ]
    if len(sums[0]) != size:
        raise RuntimeError("the answers are not those of this block")
    return sums


def range_totals(table: pa.Table) -> Iterator[tuple]:
    """The sums of one range, in the order in which each block has its keys."""
    found = merged(table)
    words = (found.keys & np.uint64(1)) == 0
    seen, modelled = found.seen, found.modelled
    facts = int((seen[words] > 0).sum()), int(seen[words].sum()), int(modelled[words].sum())
    for block, number, mine in zip(table["block"].to_pylist(), table["range"].to_pylist(), found.places):
        yield block, number, _packed(seen[mine]), _packed(modelled[mine]), *facts
        facts = (0, 0, 0)


def _finer(ranges: int):
    def counted(key, table):
        return _table(finer_counts(key[0].as_py(), table, ranges), _names(_COUNTS))

    return counted


def totals_and_answers(counts: DataFrame, levels: int, parts: int) -> tuple[DataFrame, DataFrame]:
    """The sums of the finest ranges, and the answers to each block and range of `counts`."""
    steps = []
    for level in range(1, levels):
        # Stored, as the way back asks for the same keys.
        cells = stored(counts, "counts").withColumn("parent", _divided("block", parts))
        counts = cells.groupBy("parent", "range").applyInArrow(_finer(parts ** (level + 1)), _COUNTS)
        steps.append(cells)
    totals = stored(
        counts.groupBy("range").applyInArrow(lambda table: _table(range_totals(table), _names(_TOTALS)), _TOTALS), "totals"
    )
    answers = totals.select(*_names(_ANSWERS))
    for cells in reversed(steps):
        given = answers.withColumn("coarser", _divided("range", parts).cast("int"))
        own = cells.groupBy("parent", "range").cogroup(given.groupBy("block", "coarser"))
        back = own.applyInArrow(
            lambda table, given: _table(coarser_answers(table, given), _names(_ANSWERS)), _ANSWERS
        )
        answers = stored(back, "answers")
    return totals, answers


def _divided(name: str, by: int) -> Column:
    value = F.col(name).cast("long")
    return ((value - F.pmod(value, F.lit(by))) / by).cast("long")


def _names(schema: str) -> list[str]:
    return [part.split()[0] for part in schema.split(",")]


@dataclass(frozen=True)
class Facts:
    words: int
    tokens: int
    modelled: int


@dataclass
class Estimates:
    tokens: Tokens
    seen: np.ndarray
    bucket: np.ndarray
    pair: np.ndarray
    word: np.ndarray
    longer: list[tuple[np.ndarray, np.ndarray]]


def estimates(table: pa.Table, answers: pa.Table, facts: Facts, order: int, *, deleted: bool) -> Estimates:
    """Estimates from all training documents, or without the deleted ones."""
    tokens = tokens_of(table["text"], order)
    seen, modelled = _in_order(answers, len(tokens.keys))
    counts, total = (modelled, facts.modelled) if deleted else (seen, facts.tokens)

    def ratio(gram: np.ndarray, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        often = counts[context].astype(float)
        likely = np.divide(counts[gram], often, out=np.zeros(len(often)), where=often > 0)
        return likely, np.minimum(np.frexp(often)[1], _BUCKETS - 1)

    pair, bucket = ratio(tokens.pair, tokens.context)
    word = counts[tokens.word] / max(total, 1)
    return Estimates(tokens, seen[tokens.word], bucket, pair, word, [ratio(*places) for places in tokens.longer])


def chances(found: Estimates, weights: list[np.ndarray], floor: float) -> np.ndarray:
    """The chance of each token by the orders whose weights are given."""
    share = weights[0][found.bucket]
    chance = share[:, 0] * found.pair + share[:, 1] * found.word + share[:, 2] * floor
    for (likely, bucket), own in zip(found.longer, weights[1:]):
        share = own[bucket]
        chance = share[:, 0] * likely + share[:, 1] * chance
    return chance


def held_out_cells(found: Estimates, weights: list[np.ndarray], floor: float) -> np.ndarray:
    """For each token the bucket and steps from which the next order's weights are learned."""
    if not weights:
        return np.c_[found.bucket, _steps(found.pair, floor), _steps(found.word, floor)]
    likely, bucket = found.longer[len(weights) - 1]
    return np.c_[bucket, _steps(likely, chances(found, weights, floor))]


def _steps(values: np.ndarray, floor: float | np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.where(values > 0, np.round(_STEPS * np.log(values / floor)), _NEVER).astype(np.int32)


def mixture(cells: list[tuple[int, ...]], parts: int = 3) -> np.ndarray:
    """Weights of estimates by bucket, from counts of held-out tokens.

    Cells are (bucket, steps of each estimate but the last over the last, count): steps of pair
    and word over the uniform estimate, or of one longer n-gram over the chance by the orders
    below. Each weight starts from one virtual token, so none is ever zero; buckets without
    tokens get the weights of all.
    """
    weights = np.zeros((_BUCKETS + 1, parts))
    for bucket in range(_BUCKETS, -1, -1):
        own = [cell for cell in cells if bucket in (cell[0], _BUCKETS)]
        if not own:
            weights[bucket] = weights[_BUCKETS]
            continue
        steps = np.array([cell[1:parts] for cell in own], dtype=float)
        ratio = np.c_[np.where(steps == _NEVER, 0.0, np.exp(steps / _STEPS)), np.ones(len(own))]
        count = np.array([cell[parts] for cell in own], dtype=float)
        share = np.full(parts, 1 / parts)
        for _ in range(_ROUNDS):
            part = ratio * share
            share = (part / part.sum(axis=1, keepdims=True) * count[:, None]).sum(axis=0) + 1
            share /= share.sum()
        weights[bucket] = share
    return np.where(weights > 0, weights, 1 / parts) if not cells else weights


def scored(
    documents: DataFrame,
    block_bytes: int = BLOCK_BYTES,
    range_bytes: int = RANGE_BYTES,
    fan_out: int = FAN_OUT,
    repeated_bytes: int = REPEATED_BYTES,
    order: int = ORDER,
) -> DataFrame:
    """Scores of every document by n-grams of up to `order` words, two at least.

    Null and empty texts consist of the end token. Repeated rows each count and each give a
    row. A row without an id is scored but not learned from, and is not held out. If nothing
    can be learned from, all words are unknown. Other columns are ignored.
    """
    if order < 2:
        raise ValueError("the model needs pairs of words at least")
    sizes = (block_bytes, range_bytes, fan_out, order)
    rows = keyed(documents)
    bytes_of = F.sum(F.octet_length("text").cast("long") + 1)
    keys = rows.groupBy("doc_id", "text_hash").agg(F.count("*").alias("times"), bytes_of.alias("bytes"))
    repeated = (F.col("times") > 1) & (F.col("bytes") > repeated_bytes)
    known = keys.agg(
        F.coalesce(F.sum(F.when(~repeated, F.col("bytes")).otherwise(F.col("bytes") / F.col("times"))), F.lit(0))
        .cast("long")
        .alias("size"),
        F.count(F.when(repeated, 1)).alias("repeated"),
    ).first()
    if not known["repeated"]:
        return _scored(rows.withColumn("times", F.lit(1)), known["size"], *sizes).drop("text_hash")
    # Rows that repeat so often meet in one block: one of them is counted for all, and its score
    # is joined to the others.
    hot = small_or_merged(stored(keys.filter(repeated).select("doc_id", "text_hash"), "repeated"))
    copies = with_results(rows, hot, "left_semi")
    once = copies.groupBy("doc_id", "text_hash").agg(F.first("text").alias("text"), F.count("*").alias("times"))
    single = with_results(rows, hot, "left_anti").withColumn("times", F.lit(1))
    weighted = once.select(single.columns).unionByName(single)
    found = stored(_scored(weighted, known["size"], *sizes), "scores")
    of_copies = with_results(found, hot, "left_semi")
    others = with_results(found, hot, "left_anti")
    joined = with_results(copies.select("doc_id", "text_hash"), small_or_merged(of_copies), "inner")
    return others.unionByName(joined.select(others.columns)).drop("text_hash")


def _scored(rows: DataFrame, size: int, block_bytes: int, range_bytes: int, fan_out: int, order: int) -> DataFrame:
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS
    blocks, ranges = max(1, size // block_bytes), max(1, size // range_bytes)
    spread = F.xxhash64("doc_id", "text_hash", F.lit("block"))
    learns = F.coalesce(fold != HELD_OUT, F.lit(False))
    deleted = learns & (F.pmod(F.xxhash64("doc_id", F.lit("deleted")), F.lit(DELETED)) == 0)
    # Deleted documents have blocks of their own, below zero, so that weights need only those.
    few = max(1, blocks // DELETED)
    block = F.when(deleted, -1 - F.pmod(spread, F.lit(few))).otherwise(F.pmod(spread, F.lit(blocks)))
    dealt = rows.select(
        "doc_id",
        "text_hash",
        "text",
        F.col("times").cast("long").alias("times"),
        learns.alias("learns"),
        deleted.alias("deleted"),
        F.coalesce(fold == HELD_OUT, F.lit(False)).alias("held_out"),
        block.cast("long").alias("block"),
    )
    levels, parts = cuts(ranges, fan_out)

    def counted(key, table):
        return _table(block_counts(key[0].as_py(), table, parts, order), _names(_COUNTS))

    counts = dealt.groupBy("block").applyInArrow(counted, _COUNTS)
    totals, answers = totals_and_answers(counts, levels, parts)
    known = totals.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("v", "n", "n_modelled")]).first()
    facts = Facts(known["v"], known["n"], known["n_modelled"])
    floor = 1.0 / (facts.words + 1)

    held = dealt.filter("block < 0").groupBy("block").cogroup(answers.filter("block < 0").groupBy("block"))
    weights: list[np.ndarray] = []
    for _ in range(2, order + 1):
        steps = ["pair", "word"] if not weights else ["likely"]
        weights.append(mixture(_learned(held, facts, floor, order, weights, steps), len(steps) + 1))

    def scores(table, given):
        found = estimates(table, given, facts, order, deleted=False)
        chance = chances(found, weights, floor)
        base = np.log10((found.seen + 1.0) / (facts.tokens + 1.0 * (facts.words + 1)))
        at = found.tokens.first[:-1]
        return pa.table(
            {
                "doc_id": table["doc_id"],
                "text_hash": table["text_hash"],
                "held_out": table["held_out"],
                "n_tokens": pa.array(np.diff(found.tokens.first), pa.int64()),
                "n_known": pa.array(np.add.reduceat((found.seen > 0).astype(np.int64), at), pa.int64()),
                "train_tokens": pa.array(np.full(len(at), facts.tokens), pa.int64()),
                "base_score": pa.array(np.add.reduceat(base, at), pa.float64()),
                "score": pa.array(np.add.reduceat(np.log10(chance), at), pa.float64()),
            }
        )

    schema = "doc_id long, text_hash long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(scores, schema)


def _learned(held, facts: Facts, floor: float, order: int, weights: list[np.ndarray], steps: list[str]) -> list[tuple]:
    """Cells of the held-out tokens. Buckets and steps bound their number, whatever the input."""
    names = ["bucket", *steps]

    def cells(table, given):
        found = estimates(table, given, facts, order, deleted=True)
        cell = held_out_cells(found, weights, floor)
        values, where = np.unique(cell, axis=0, return_inverse=True)
        n = np.bincount(where.reshape(-1), table["times"].to_numpy()[found.tokens.row], len(values)).astype(np.int64)
        columns = {name: pa.array(values[:, at], pa.int32()) for at, name in enumerate(names)}
        return pa.table({**columns, "n": pa.array(n, pa.int64())})

    schema = ", ".join([*[f"{name} int" for name in names], "n long"])
    counted = held.applyInArrow(cells, schema).groupBy(*names).agg(F.sum("n").alias("n"))
    return [tuple(row) for row in counted.collect()]


def _table(rows: Iterator[tuple], names: list[str]) -> pa.Table:
    kinds = {"block": pa.int64(), "range": pa.int32(), "v": pa.int64(), "n": pa.int64(), "n_modelled": pa.int64()}
    columns = list(zip(*rows)) or [[] for _ in names]
    return pa.table([pa.array(c, kinds.get(n, pa.binary())) for n, c in zip(names, columns)], names=names)
