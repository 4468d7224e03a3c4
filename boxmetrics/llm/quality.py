"""Quality classifier: gradient-boosted trees over statistics of whole documents."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxmetrics.llm.boosting import Forest, fitted
from boxmetrics.llm.common import keyed
from boxmetrics.llm.words import Spans, Words, words_of

#: Bound of the sample the trees are fitted on: the labelled rows with the smallest hashes.
TRAIN_ROWS = 20_000
FOLDS = 5
KEPT_SCORE = 0.3

# Classes of bytes whose shares are features.
_CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "digit": b"0123456789",
    "stop": b".!?",
    "comma": b",;:",
    "exclaimed": b"!",
    "symbol": b"#*$%&|<>@^~=+_\\/{}[]",
    "bar": b"|",
    "line": b"\n",
    "wide": bytes(range(128, 256)),
}
_TABLES = np.zeros((len(_CLASSES), 256), dtype=bool)
for _row, _members in enumerate(_CLASSES.values()):
    _TABLES[_row, list(_members)] = True

FEATURES = (
    "words",
    "bytes",
    "word_length",
    "distinct_words",
    "repeated_next",
    "distinct_pairs",
    "distinct_triples",
    "top_word",
    *_CLASSES,
)


def _per_row(counts: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    sums = np.r_[0, np.cumsum(counts, dtype=np.int64)]
    return sums[bounds[1:]] - sums[bounds[:-1]]


def _distinct(ids: np.ndarray, row: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Number of distinct ids in each row, and how often the commonest occurs."""
    if not len(ids):
        return np.zeros(n_rows), np.zeros(n_rows)
    order = np.lexsort((ids, row))
    ids, row = ids[order], row[order]
    begins = np.flatnonzero(np.r_[True, (ids[1:] != ids[:-1]) | (row[1:] != row[:-1])])
    runs = np.diff(np.r_[begins, len(ids)])
    most = np.zeros(n_rows, dtype=np.int64)
    np.maximum.at(most, row[begins], runs)
    return np.bincount(row[begins], minlength=n_rows), most


def _statistics(words: Words) -> np.ndarray:
    n_rows = len(words.first) - 1
    n_words = np.diff(words.first)
    n_bytes = np.diff(words.offsets)
    row = words.rows()
    some_words, some_bytes = np.maximum(n_words, 1), np.maximum(n_bytes, 1)
    length = np.bincount(row, words.ends - words.starts, n_rows)
    distinct, top = _distinct(words.ids, row, n_rows)
    spans = Spans(words.ids)
    shares = []
    for size in (2, 3):
        at = np.flatnonzero(row[size - 1 :] == row[: len(row) - size + 1]) if len(row) >= size else np.zeros(0, int)
        runs, _ = _distinct(spans.hashed(at, size), row[at], n_rows)
        shares.append(np.where(n_words >= size, runs / np.maximum(n_words - size + 1, 1), 1.0))
    again = np.r_[False, (words.ids[1:] == words.ids[:-1]) & (row[1:] == row[:-1])] if len(row) else np.zeros(0)
    columns = [
        np.log1p(n_words),
        np.log1p(n_bytes),
        length / some_words,
        np.where(n_words > 0, distinct / some_words, 1.0),
        np.bincount(row, again, n_rows) / some_words,
        *shares,
        top / some_words,
        *[_per_row(table[words.data], words.offsets) / some_bytes for table in _TABLES],
    ]
    return np.stack(columns, axis=1)


def statistics(texts: pa.Array) -> np.ndarray:
    """The features of each text, over all of it; an empty text has its own."""
    parts = [_statistics(words) for words in words_of(texts)]
    return np.concatenate(parts) if parts else np.zeros((0, len(FEATURES)))


def _fold(folds: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds


def trained(documents: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Forest:
    """Trees fitted on at most `rows` labelled rows outside of fold 0.

    Rows without an id or a label are left out. Several labels of an id count as the highest.
    """
    chosen = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
        .filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & (_fold(FOLDS) != 0))
        .groupBy("doc_id")
        .agg(F.max("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(rows)
    )

    @F.arrow_udf("array<double>")
    def features(texts: pa.Array) -> pa.Array:
        made = statistics(texts)
        return pa.FixedSizeListArray.from_arrays(pa.array(made.ravel()), made.shape[1]).cast(pa.list_(pa.float64()))

    # `rows` bounds both the broadcast and, by the second limit, what comes back.
    sample = (
        keyed(documents)
        .join(F.broadcast(chosen), "doc_id")
        .select("doc_id", "text_hash", "quality", features("text").alias("features"))
        .orderBy(F.xxhash64("doc_id"), "doc_id", "text_hash")
        .limit(rows)
        .select("quality", "features")
        .toArrow()
    )
    if not sample.num_rows:
        return fitted(np.zeros((0, len(FEATURES))), np.zeros(0))
    values = sample["features"].combine_chunks().flatten().to_numpy().reshape(sample.num_rows, -1)
    return fitted(values, sample["quality"].to_numpy().astype(float))


def quality_score(text: Column, forest: Forest) -> Column:
    """Score from 0 to 1 for each text; nulls count as empty."""

    @F.arrow_udf("double")
    def scores(texts: pa.Array) -> pa.Array:
        return pa.array(forest.score(statistics(texts)))

    return scores(F.coalesce(text.cast("string"), F.lit("")))


def scored(documents: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """Score of every document. Null and empty texts are scored as what they are, texts
    without words. Repeated rows each give a row; a row without an id is scored, and is not
    held out. Without labels, or with labels of one kind only, all scores are equal. Other
    columns are ignored.
    """
    forest = trained(documents, labels, rows)
    score = quality_score(F.col("text"), forest)
    return documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), score.alias("score")
    ).select(
        "doc_id",
        F.coalesce(_fold(FOLDS) == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= KEPT_SCORE).cast("int").alias("predicted"),
    )

