"""Benchmark decontamination by a prefix-filtered set join.

An item is cut into windows of WINDOW words. A document contains a window only if it has all
its words, so the prefix that must match is one word; the rarest one in the corpus makes the
fewest candidates. A candidate is the place where the window would have to start; it is kept
if the window lies within the document, and only if all words agree.

All steps are DataFrame expressions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxmetrics.llm.common import KEYS_LIMIT_BYTES, keyed, small_or_merged, stored, with_results
from boxmetrics.operators.sizing import fits, row_bytes

WINDOW = 10
#: What the windows may take in memory to be sent to all executors; beyond it they are joined by shuffle.
WINDOWS_LIMIT_BYTES = 16 * 1024 * 1024
#: What their prefix words may take in memory to be sent there at once, if the windows do not fit.
SPOTS_LIMIT_BYTES = 64 * 1024 * 1024

#: Texts are searched in segments of so many words.
SEGMENT = 128

# What separates words, and the letters that are put in lower case.
_SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_SEPARATORS_OF_BOTH_CASES = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def words(text: Column) -> Column:
    parts = F.split(F.translate(text, _UPPER, _UPPER.lower()), _SEPARATORS, -1)
    # Only the first and the last part can be empty.
    return F.filter(parts, lambda part: part != "")


def word_count(text: Column) -> Column:
    """Number of words, for which the case of letters does not matter."""
    return F.size(F.filter(F.split(text, _SEPARATORS_OF_BOTH_CASES, -1), lambda part: part != "")).cast("long")


def item_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Distinct windows of all items with the items that have them.

    An item of fewer words is one window; one without words has none.
    """
    texts = items.select(
        F.col("item_id"), words(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("words")
    ).filter(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - window + 1, F.lit(1)))
    cut = F.transform(starts, lambda start: F.slice("words", start, window))
    return (
        texts.select("item_id", F.explode(cut).alias("window"))
        .groupBy("window")
        .agg(F.collect_set(F.col("item_id").cast("string")).alias("items"))
    )


def prefixed(windows: DataFrame, documents: DataFrame) -> DataFrame:
    """Windows with their rarest word, counted over all documents, and its place in them.

    Of several places the first is taken, and of equally rare words the smallest. The words of
    windows go to the documents while they fit; beyond that the words of each task are counted
    before they are shuffled, so that a frequent word is one row of a task.
    """
    vocabulary = windows.select(F.explode("window").alias("word")).distinct()
    seen = documents.select(F.explode_outer(words(F.col("text"))).alias("word"))
    if fits(vocabulary, KEYS_LIMIT_BYTES):
        counts = seen.join(F.broadcast(vocabulary), "word").groupBy("word").agg(F.count("*").alias("n"))
    else:
        counts = seen.groupBy("word").agg(F.count("*").alias("n")).join(vocabulary.hint("merge"), "word")
    # Both sides of the join are tables, so that a word of many windows can be split.
    counts = stored(counts, "word_counts")
    placed = windows.select("window", "items", F.posexplode("window").alias("place", "word"))
    rarest = placed.join(small_or_merged(counts), "word", "left").groupBy("window").agg(
        F.first("items").alias("items"),
        F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word", "place")).alias("prefix"),
    )
    # A window with a word that no document has cannot occur.
    return rarest.filter("prefix.n > 0").select(
        "window", "items", F.col("prefix.word").alias("prefix"), F.col("prefix.place").alias("place")
    )


def _each_word(documents: DataFrame, window: int) -> DataFrame:
    """Every word with the words of its segment, which each of its rows carries.

    A segment begins every SEGMENT words and goes on for a window beyond, so that each window
    lies whole in the one in which it starts, and a row stays small in a text of any length.
    """
    split = documents.select("doc_id", "text_hash", words(F.col("text")).alias("words"))
    begins = F.sequence(F.lit(0), F.greatest(F.size("words") - 1, F.lit(0)), F.lit(SEGMENT))
    cut = F.transform(
        begins,
        lambda begin: F.struct(begin.alias("begin"), F.slice("words", begin + 1, SEGMENT + window - 1).alias("words")),
    )
    # Outer, since the inner form would split every text once more to drop the empty ones.
    segments = split.select("doc_id", "text_hash", F.explode_outer(cut).alias("part"))
    segments = segments.select("doc_id", "text_hash", "part.begin", "part.words")
    return segments.select("doc_id", "text_hash", "begin", "words", F.posexplode_outer("words").alias("at", "word"))


def _starts_here(start: Column, length: Column) -> Column:
    return (start >= 0) & (start < SEGMENT) & (start + length <= F.size("words"))


def occurrences(documents: DataFrame, prefixes: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, text_hash, start, length, items) for each place where a window occurs.

    The windows themselves are sent to the documents.
    """
    met = _each_word(documents, window).join(F.broadcast(prefixes), F.col("word") == F.col("prefix"))
    start, length = F.col("at") - F.col("place"), F.size("window")
    cut = F.slice("words", start + 1, length)
    same = F.when(_starts_here(start, length), cut == F.col("window")).otherwise(F.lit(False))
    return met.filter(same).select(
        "doc_id", "text_hash", (F.col("begin") + start).alias("start"), length.alias("length"), "items"
    )


def shuffled_occurrences(
    documents: DataFrame, prefixes: DataFrame, window: int = WINDOW, limit: int = SPOTS_LIMIT_BYTES
) -> DataFrame:
    """The same for more windows than can be sent to the documents.

    Only the prefix words go there, each with a bit for every (place, length) that its windows
    have. What is shuffled are candidates: the words that a window would have, if it has its
    prefix here. They are joined to the windows by all words, so each occurrence is found by
    its own prefix and no other. Prefix words beyond the limit are sent in several passes.
    """
    # Stored, so that no grouping lies below the join and a frequent window can be split.
    wanted = stored(prefixes, "windows")
    spot = F.struct("place", F.size("window").alias("length"))
    spots = wanted.groupBy("prefix").agg(F.collect_set(spot).alias("spots"))
    # A word has at most as many spots as there are places in windows of all lengths.
    size = F.octet_length("prefix") + F.lit(row_bytes(2)) + F.size("spots") * row_bytes(2)
    passes = max(1, -(-(spots.agg(F.sum(size.cast("long")).alias("bytes")).first()["bytes"] or 0) // limit))
    each = _each_word(documents, window)
    parts = []
    for number in range(passes):
        own = spots.filter(F.pmod(F.xxhash64("prefix"), F.lit(passes)) == number)
        met = each.join(F.broadcast(own), F.col("word") == F.col("prefix"))
        fitting = F.filter("spots", lambda spot: _starts_here(F.col("at") - spot["place"], spot["length"]))
        cut = F.transform(
            fitting,
            lambda spot: F.struct(
                (F.col("begin") + F.col("at") - spot["place"]).alias("start"),
                spot["place"].alias("place"),
                F.slice("words", F.col("at") - spot["place"] + 1, spot["length"]).alias("window"),
            ),
        )
        parts.append(
            met.select("doc_id", "text_hash", "word", F.explode(cut).alias("cut")).select(
                "doc_id", "text_hash", "word", "cut.*"
            )
        )
    candidates = reduce(DataFrame.unionByName, parts)
    met = candidates.join(wanted.withColumnRenamed("prefix", "word").hint("merge"), ["window", "word", "place"])
    return met.select("doc_id", "text_hash", "start", F.size("window").alias("length"), "items")


def contamination(
    documents: DataFrame,
    items: DataFrame,
    window: int = WINDOW,
    limit: int = WINDOWS_LIMIT_BYTES,
    spots_limit: int = SPOTS_LIMIT_BYTES,
) -> DataFrame:
    """Words of every document that lie in a window of an item, with its key.

    Null and empty texts have no words, on both sides. Repeated rows each give a row, and
    rows without an id are searched like others. Items without an id count by their text but
    are not listed. Other columns are ignored.
    """
    rows = keyed(documents)
    windows = item_windows(items, window)
    # A window is at most `window` words; its size is measured as one joined text.
    broadcast = fits(
        windows.select(F.array_join("window", "  ").alias("text"), F.array_join("items", "  ").alias("ids")), limit // 4
    )
    prefixes = prefixed(windows, rows)
    if broadcast:
        hits = occurrences(rows, prefixes, window)
    else:
        hits = shuffled_occurrences(rows, prefixes, window, spots_limit)
    found = hits.groupBy("doc_id", "text_hash").agg(
        F.collect_set(F.struct("start", "length")).alias("places"),
        F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"),
    )
    ordered = F.array_sort("places")
    ends = F.transform(ordered, lambda place: place["start"] + place["length"])
    # A place covers what lies beyond the furthest end before it; ends may be out of order.
    covered = F.aggregate(
        F.arrays_zip(ordered.alias("place"), ends.alias("end")),
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("sum")),
        lambda state, item: F.struct(
            F.greatest(state["end"], item["end"]).alias("end"),
            (
                state["sum"]
                + F.greatest(item["end"] - F.greatest(state["end"], item["place"]["start"]), F.lit(0))
            ).alias("sum"),
        ),
        lambda state: state["sum"],
    )
    found = found.select(
        "doc_id",
        "text_hash",
        covered.cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.array_join(F.array_sort("items"), ",").alias("item_ids"),
    )
    counted = rows.select("doc_id", "text_hash", word_count(F.col("text")).alias("n_words"))
    zero = F.lit(0).cast("long")
    return with_results(counted, found).select(
        "doc_id",
        "text_hash",
        "n_words",
        F.coalesce("n_hit", zero).alias("n_hit"),
        F.coalesce("n_items", zero).alias("n_items"),
        F.sha2(F.coalesce("item_ids", F.lit("")), 256).alias("items_sha256"),
        (F.coalesce("n_hit", zero) > 0).alias("contaminated"),
    )
