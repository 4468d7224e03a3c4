"""Repeated passages by a compacted De Bruijn graph of word k-mers.

The edges of the graph are the windows of WINDOW words. They are far more than the words a
shuffle should carry, so they meet as paths: the rarest-looking k-mer in a window (the one with
the smallest hash) is its anchor, and consecutive windows of a text with the same anchor are
one path. An edge or path is known by a 128-bit BLAKE2b digest of its words as they stand, so
two are the same only if their words are.

1. Anchors that only one document has belong to no repeated window; their paths are done.
2. Equal paths are joined to the first place that has them: one row settles all windows.
3. Where an anchor has paths that differ between documents, the graph branches. Only there
   the windows of first occurrences are written out as single edges and joined likewise.
4. Repeated edges and paths that stand side by side in a document, and whose first places
   stand side by side as well, have no branch between them. They are compacted into long spans,
   each with the coordinates of its source.
5. The words of every long span are compared with those at its source's coordinates, by a
   digest over the whole span, joined from there. Only then are they removed.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from boxmetrics.llm.common import keyed, small_or_merged, stored, with_results
from boxmetrics.llm.words import Spans, Words, words_of

WINDOW = 50
ANCHOR = 25

_PLACE_BITS = np.uint64(22)
_PATH = pa.struct(
    [("anchor", pa.int64()), ("h", pa.int64()), ("check", pa.int64()), ("start", pa.int32()), ("windows", pa.int32())]
)
_EDGE = pa.struct([("h", pa.int64()), ("check", pa.int64()), ("start", pa.int32())])
_DIGESTED = pa.struct([("source_start", pa.int32()), ("source_end", pa.int32()), ("digest", pa.binary())])


class Joined:
    """The words of a chunk with one space behind each, and digests of runs of them."""

    def __init__(self, words: Words) -> None:
        lengths = words.ends - words.starts
        self._begins = np.r_[0, np.cumsum(lengths + 1)]
        joined = np.full(self._begins[-1], 0x20, dtype=np.uint8)
        step = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        joined[np.repeat(self._begins[:-1], lengths) + step] = words.data[np.repeat(words.starts, lengths) + step]
        self._content = memoryview(joined.tobytes())

    def digests(self, start: np.ndarray, length: np.ndarray | int) -> bytes:
        """16 bytes for each run of words, end to end."""
        ends = self._begins[start + length] - 1
        content, made = self._content, hashlib.blake2b
        runs = zip(self._begins[start].tolist(), ends.tolist())
        return b"".join(made(content[a:b], digest_size=16).digest() for a, b in runs)

    def halves(self, start: np.ndarray, length: np.ndarray | int) -> list[np.ndarray]:
        """The digests as two columns of integers."""
        both = np.frombuffer(self.digests(start, length), dtype=np.int64).reshape(-1, 2)
        return [both[:, 0].copy(), both[:, 1].copy()]


def _sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Least of each `width` consecutive values, in log2(width) steps."""
    done = 1
    while 2 * done <= width:
        values = np.minimum(values[:-done], values[done:])
        done *= 2
    rest = width - done
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def _leftmost_least(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the leftmost least, by its high bits, of each `width` consecutive values.

    The low bits hold the place. They count from the first place of a block of values, and
    blocks overlap, so that a place fits into them at any number of values.
    """
    step = (1 << int(_PLACE_BITS)) - width + 1
    if step < 1:
        raise ValueError(f"{width} places do not fit into {_PLACE_BITS} bits")
    low = (np.uint64(1) << _PLACE_BITS) - np.uint64(1)
    found = np.empty(len(values) - width + 1, dtype=np.int64)
    for at in range(0, len(found), step):
        part = values[at : at + step + width - 1]
        ordered = (part & ~low) | np.arange(len(part), dtype=np.uint64)
        found[at : at + step] = at + (_sliding_least(ordered, width) & low).astype(np.int64)
    return found


def _lists(parts: list[tuple[np.ndarray, list[np.ndarray]]], rows: int, kind: pa.StructType) -> pa.Array:
    """One list of structs per row; each part has ascending rows and the columns."""
    if not parts:
        return pa.array([[]] * rows, pa.list_(kind))
    at = np.concatenate([part[0] for part in parts])
    columns = [np.concatenate([part[1][i] for part in parts]) for i in range(kind.num_fields)]
    offsets = np.searchsorted(at, np.arange(rows + 1)).astype(np.int32)
    arrays = [
        pa.array(column.view(np.int64) if column.dtype == np.uint64 else column, kind.field(i).type)
        for i, column in enumerate(columns)
    ]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(arrays, fields=list(kind)))


def paths_of(texts: pa.Array, window: int = WINDOW, anchor: int = ANCHOR) -> pa.Array:
    """The paths of each text: runs of consecutive windows that have their anchor in one place."""
    parts = []
    for words in words_of(texts):
        if len(words.ids) < window:
            continue
        spans = Spans(words.ids)
        places = np.arange(len(words.ids) - anchor + 1)
        kmers = spans.hashed(places, anchor)
        least = _leftmost_least(kmers, window - anchor + 1)
        row_of = words.rows()
        starts = np.arange(len(least))
        whole = row_of[: len(least)] == row_of[window - 1 :]
        starts, found = starts[whole], least[whole]
        if not len(starts):
            continue
        begins = np.flatnonzero(np.r_[True, (found[1:] != found[:-1]) | (np.diff(starts) != 1)])
        counts = np.diff(np.r_[begins, len(starts)])
        first = starts[begins]
        length = counts + window - 1
        row = row_of[first]
        columns = [
            kmers[found[begins]],
            *Joined(words).halves(first, length),
            (first - words.first[row]).astype(np.int32),
            counts.astype(np.int32),
        ]
        parts.append((row + words.row, columns))
    return _lists(parts, len(texts), _PATH)


def edges_of(texts: pa.Array, ranges: pa.Array, window: int = WINDOW) -> pa.Array:
    """Single windows of each text, for the (start, windows) ranges given with it."""
    wanted = ranges.flatten()
    starts = wanted.field("start").to_numpy(zero_copy_only=False).astype(np.int64)
    counts = wanted.field("windows").to_numpy(zero_copy_only=False).astype(np.int64)
    sizes = np.asarray(pa.compute.list_value_length(ranges).fill_null(0))
    of_row = np.r_[0, np.cumsum(sizes)]
    parts = []
    for words in words_of(texts):
        last = words.row + len(words.first) - 1
        mine = slice(of_row[words.row], of_row[last])
        row = np.repeat(np.arange(words.row, last), sizes[words.row : last])
        if not len(row):
            continue
        repeats = counts[mine]
        ends = np.cumsum(repeats)
        step = np.arange(ends[-1]) - np.repeat(ends - repeats, repeats)
        at = np.repeat(starts[mine], repeats) + step
        rows = np.repeat(row, repeats)
        order = np.lexsort((at, rows))
        at, rows = at[order], rows[order]
        place = at + words.first[rows - words.row]
        parts.append((rows, [*Joined(words).halves(place, window), at.astype(np.int32)]))
    return _lists(parts, len(texts), _EDGE)


def span_digests(texts: pa.Array, places: pa.Array) -> pa.Array:
    """Each text's places with the digest of the words from their start to their end."""
    made = []
    for text, spans in zip(texts.cast(pa.binary()), places):
        words = (text.as_py() or b"").split() if spans.is_valid and len(spans) else []
        for span in spans.as_py() or ():
            made.append(_digest(words[span["start"] : span["end"]]))
    sizes = np.asarray(pa.compute.list_value_length(places).fill_null(0))
    offsets = pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32))
    wanted = places.flatten()
    columns = [wanted.field("start"), wanted.field("end"), pa.array(made, pa.binary())]
    return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(columns, fields=list(_DIGESTED)))


def _digest(words: list[bytes]) -> bytes:
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest()


_SOURCE = ("source_id", "source_hash", "source_start")


def _first_place():
    """The place of the smallest id; of one id the smallest hash of a text, and there the first."""
    return F.min(F.struct("doc_id", "text_hash", "start")).alias("source")


def _taken(rows: DataFrame, end) -> DataFrame:
    """Spans of the rows whose first place is in a document with a smaller id."""
    return rows.filter("source.doc_id < doc_id").select(
        "doc_id",
        "text_hash",
        "start",
        end.alias("end"),
        F.col("source.doc_id").alias("source_id"),
        F.col("source.text_hash").alias("source_hash"),
        F.col("source.start").alias("source_start"),
    )


def repeated_spans(documents: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """Word spans [start, end) of keyed documents that a document with a smaller id has too.

    Rows are (doc_id, text_hash, start, end) and the coordinates (source_id, source_hash,
    source_start) of the same words; spans may overlap. Rows without an id are neither
    sources nor searched.
    """

    @F.arrow_udf("array<struct<anchor: bigint, h: bigint, check: bigint, start: int, windows: int>>")
    def paths(texts: pa.Array) -> pa.Array:
        return paths_of(texts, window, anchor)

    @F.arrow_udf("array<struct<h: bigint, check: bigint, start: int>>")
    def edges(texts: pa.Array, ranges: pa.Array) -> pa.Array:
        return edges_of(texts, ranges, window)

    # Both sides of each merge join are stored or come straight from a scan: a key that many
    # rows have is then split between tasks.
    named = documents.filter(F.col("doc_id").isNotNull())
    found = named.select("doc_id", "text_hash", F.inline(paths("text")))
    shared = found.groupBy("anchor").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
    shared = stored(shared.filter("low < high").select("anchor"), "shared")
    candidates = stored(found.join(shared.hint("merge"), "anchor"), "paths")

    path = ["anchor", "h", "check"]
    sources = stored(candidates.groupBy(*path).agg(_first_place()), "sources")
    branching = stored(
        sources.groupBy("anchor")
        .agg((F.min("source.doc_id") < F.max("source.doc_id")).alias("branches"))
        .filter("branches")
        .select("anchor"),
        "branching",
    )
    settled = candidates.join(sources.hint("merge"), path)
    whole = _taken(settled, F.col("start") + F.col("windows") + window - 1)
    open_paths = settled.filter("source.doc_id = doc_id").join(branching.hint("merge"), "anchor", "left_semi")
    ranges = stored(
        open_paths.groupBy("doc_id", "text_hash").agg(
            F.array_sort(F.collect_set(F.struct("start", "windows"))).alias("ranges")
        ),
        "ranges",
    )
    single = stored(
        _texts_of(named, ranges).select("doc_id", "text_hash", F.inline(edges("text", "ranges"))), "edges"
    )
    edge = ["h", "check"]
    firsts = single.groupBy(*edge).agg(_first_place(), F.max("doc_id").alias("high"))
    firsts = stored(firsts.filter("source.doc_id < high").drop("high"), "firsts")
    parted = _taken(single.join(firsts.hint("merge"), edge), F.col("start") + window)
    return whole.unionByName(parted)


def _texts_of(named: DataFrame, wanted: DataFrame) -> DataFrame:
    """The documents that `wanted` has a row for, once each, with its columns."""
    names = small_or_merged(wanted.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")))
    asked = named.join(names, (F.col("doc_id") == F.col("_id")) & (F.col("text_hash") == F.col("_hash")), "left_semi")
    return asked.distinct().join(wanted.hint("merge"), ["doc_id", "text_hash"])


def compacted(spans: DataFrame) -> DataFrame:
    """Spans that touch or overlap, in the document and at their source alike, as one."""
    apart = F.col("start") - F.col("source_start")
    rows = spans.distinct().withColumn("shift", apart)
    strand = ["doc_id", "text_hash", "source_id", "source_hash", "shift"]
    before = Window.partitionBy(*strand).orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    opens = F.coalesce(F.col("start") > F.max("end").over(before), F.lit(True))
    upto = Window.partitionBy(*strand).orderBy("start").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = rows.withColumn("opens", opens.cast("int")).withColumn("island", F.sum("opens").over(upto))
    return (
        numbered.groupBy(*strand, "island")
        .agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min("source_start").alias("source_start"))
        .select("doc_id", "text_hash", "start", "end", *_SOURCE)
    )


def with_source_digests(spans: DataFrame, documents: DataFrame) -> DataFrame:
    """Long spans with the digest of the words at their source's coordinates."""

    @F.arrow_udf("array<struct<source_start: int, source_end: int, digest: binary>>")
    def digests(texts: pa.Array, places: pa.Array) -> pa.Array:
        return span_digests(texts, places)

    long = stored(compacted(spans), "long")
    size = F.col("end") - F.col("start")
    places = long.select(
        F.col("source_id").alias("doc_id"),
        F.col("source_hash").alias("text_hash"),
        F.struct(F.col("source_start").alias("start"), (F.col("source_start") + size).alias("end")).alias("place"),
    ).distinct()
    ranges = stored(
        places.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_list("place")).alias("places")), "places"
    )
    named = documents.filter(F.col("doc_id").isNotNull())
    # The function's own list is exploded. Of an expression over it Spark would infer a filter,
    # and run the function a second time for that, in further workers of each executor.
    read = _texts_of(named, ranges).select(
        F.col("doc_id").alias("source_id"),
        F.col("text_hash").alias("source_hash"),
        F.inline(digests("text", "places")),
    )
    seen = stored(
        read.select(
            "source_id",
            "source_hash",
            "source_start",
            (F.col("source_end") - F.col("source_start")).alias("size"),
            "digest",
        ),
        "digests",
    )
    return long.withColumn("size", size).join(seen.hint("merge"), [*_SOURCE, "size"])


def without_spans(texts: pa.Array, starts: pa.Array, ends: pa.Array, digests: pa.Array) -> tuple[list, list, list]:
    """Number of words, number of removed ones and the kept words, for each text.

    A span is removed if its words have the digest given with it, that of its source.
    """
    all_words, removed, kept = [], [], []
    given = zip(starts.to_pylist(), ends.to_pylist(), digests.to_pylist())
    for text, (first, after, sources) in zip(texts.cast(pa.binary()), given):
        words = (text.as_py() or b"").split()
        if first:
            if any(_digest(words[a:b]) != source for a, b, source in zip(first, after, sources)):
                raise RuntimeError("a span differs from its source")
            change = np.zeros(len(words) + 1, dtype=np.int64)
            np.add.at(change, first, 1)
            np.add.at(change, after, -1)
            covered = np.cumsum(change[:-1]) > 0
            gone = int(covered.sum())
            words_kept = [word for word, cut in zip(words, covered.tolist()) if not cut]
        else:
            gone, words_kept = 0, words
        all_words.append(len(words))
        removed.append(gone)
        kept.append(b" ".join(words_kept))
    return all_words, removed, kept


def deduplicated(documents: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, *, texts: bool = False) -> DataFrame:
    """Every document without the words of windows that start in a document with a smaller id.

    Null and empty texts have no words. Repeated rows are judged alike, since an equal id is
    not a smaller one. A row without an id keeps all its words. With `texts` the kept words
    are returned as well. Other columns are ignored.
    """

    @F.arrow_udf("struct<n_words: bigint, n_removed: bigint, kept_sha256: string, kept_text: string>")
    def cleaned(texts_given: pa.Array, starts: pa.Array, ends: pa.Array, sources: pa.Array) -> pa.Array:
        all_words, removed, kept = without_spans(texts_given, starts, ends, sources)
        digests = [hashlib.sha256(text).hexdigest() for text in kept]
        shown = [text.decode() for text in kept] if texts else [None] * len(kept)
        return pa.StructArray.from_arrays(
            [
                pa.array(all_words, pa.int64()),
                pa.array(removed, pa.int64()),
                pa.array(digests, pa.string()),
                pa.array(shown, pa.string()),
            ],
            names=["n_words", "n_removed", "kept_sha256", "kept_text"],
        )

    rows = keyed(documents)
    spans = with_source_digests(repeated_spans(rows, window, anchor), rows)
    of_row = spans.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("start", "end", "digest")).alias("spans"))
    result = with_results(rows, stored(of_row, "spans").hint("merge")).select(
        "doc_id", cleaned("text", F.col("spans.start"), F.col("spans.end"), F.col("spans.digest")).alias("r")
    )
    columns = ["doc_id", "r.n_words", "r.n_removed", "r.kept_sha256"]
    return result.select(*columns, *(["r.kept_text"] if texts else []))
