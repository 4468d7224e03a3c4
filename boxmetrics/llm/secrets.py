"""Secret scans with linking of credentials that come in several parts.

Assignments, access ids and long hex strings are reported wherever they stand. Many real
credentials consist of parts that mean nothing alone: an identifier, a secret string and the
endpoint they open. Such weak candidates are reported only if a complementary part lies in
the same scope: between the two are at most SCOPE code points.

All steps are DataFrame expressions. Java's regular expressions give the matches, and the
lengths of the pieces between them, added up in a window, their places. Matches are rows, so the
work grows with their number and not with its square.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boxmetrics.llm.common import KEY, keyed, stored, with_results

SCOPE = 200
LEAST_ASSIGNED = 6

# The three kinds, in the order in which they are listed.
KEYWORDS = (
    "[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]"
    "|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]"
)
ASSIGN = rf"""(?:{KEYWORDS})["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+"""
ASSIGNED = rf"""^(?:{KEYWORDS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
# A shorter match of either kind lies in a run that holds no longer one.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
BASE_KINDS = ("assign", "access", "hex")

# Weak candidates, by the part of a credential each may be: upper-case names, strings of
# mixed characters, and addresses of services.
WEAK = {
    "identifier": r"(?<![A-Za-z0-9_])[A-Z][A-Z0-9]{11,}(?![A-Za-z0-9_])",
    "string": r"(?<![A-Za-z0-9+/])(?=[A-Za-z+/]*[0-9])(?=[a-z0-9+/]*[A-Z])(?=[A-Z0-9+/]*[a-z])[A-Za-z0-9+/]{20,}",
    "endpoint": r"""(?:https?|ftp|s3|gs|jdbc|postgres|mysql|redis|mongodb|amqp)://[^\x20\x09-\x0D"'<>]+""",
}
COMPLEMENTS = {
    "identifier": ("string", "endpoint"),
    "string": ("identifier", "endpoint"),
    "endpoint": ("identifier", "string"),
}
PART_OF_BASE = {"access": "identifier", "hex": "string", "assign": "string"}

_PIECES = "array<struct<gap: bigint, hit: bigint, kept: boolean>>"
_SPAN = "array<struct<start: bigint, rank: int, end: bigint, kind: string>>"


def pieces(text: Column, pattern: str, value: str | None = None) -> Column:
    """For each match, leftmost first: the lengths of what is before it and of itself.

    `value` is a pattern whose group must have LEAST_ASSIGNED characters or more; a match
    that fails is still passed over.
    """
    found = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
    between = F.split(text, pattern, -1)

    def piece(gap: Column, hit: Column) -> Column:
        kept = F.length(F.regexp_extract(hit, value, 1)) >= LEAST_ASSIGNED if value else F.lit(True)
        return F.struct(F.length(gap).cast("long").alias("gap"), F.length(hit).cast("long").alias("hit"), kept.alias("kept"))

    made = F.zip_with(F.slice(between, 1, F.size(found)), found, piece)
    return F.when(text.rlike(pattern), made).otherwise(F.expr(f"cast(array() as {_PIECES})"))


def scanned(documents: DataFrame) -> DataFrame:
    """(doc_id, text_hash, start, end, rank, kind) of base spans, and of weak candidates that
    overlap none of them. Repeated documents are looked at as one."""
    text = F.col("text")
    kinds = [("assign", ASSIGN, ASSIGNED), ("access", ACCESS, None), ("hex", HEX, None)]
    kinds += [(kind, pattern, None) for kind, pattern in WEAK.items()]
    every = F.array(
        *[
            F.struct(F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), pieces(text, pattern, value).alias("pieces"))
            for rank, (kind, pattern, value) in enumerate(kinds)
        ]
    )
    parted = documents.select(*KEY, F.explode(every).alias("of")).select(
        *KEY, "of.rank", "of.kind", F.posexplode("of.pieces").alias("place", "piece")
    )
    rows = parted.select(*KEY, "rank", "kind", "place", "piece.*").distinct()
    so_far = Window.partitionBy(*KEY, "rank", "kind").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("gap") + F.col("hit")).over(so_far)
    spans = (
        rows.withColumn("end", end)
        .filter("kept")
        .select(*KEY, (F.col("end") - F.col("hit")).alias("start"), "end", "rank", "kind")
    )
    # A base span that begins before a candidate or with it, and one that begins later.
    base = F.col("kind").isin(*BASE_KINDS)
    before, after = (Window.partitionBy(*KEY).orderBy(order) for order in (F.col("start").asc(), F.col("start").desc()))
    upto = F.max(F.when(base, F.col("end"))).over(before.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    onward = F.min(F.when(base, F.col("start"))).over(after.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    met = spans.withColumns({"upto": upto, "onward": onward})
    overlaps = F.coalesce(F.col("upto") > F.col("start"), F.lit(False)) | F.coalesce(F.col("onward") < F.col("end"), F.lit(False))
    return met.filter(base | ~overlaps).drop("upto", "onward")


def linked_candidates(spans: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Weak candidates with a complementary part within `scope`, of stored spans.

    Candidates and parts meet by interval join: places are cut into cells of the scope, and a
    part is known in all cells it touches and in the ones beside them. Per document, cell and
    part only the first start and the last end are carried, so no pairs are made, however
    many parts there are: in a cell beside a candidate's, one of the two decides, and a part
    in a cell of its own is always near.
    """
    part = F.col("kind")
    for kind, name in PART_OF_BASE.items():
        part = F.when(F.col("kind") == kind, F.lit(name)).otherwise(part)
    cells = F.sequence(F.floor(F.col("start") / scope), F.floor(F.col("end") / scope))
    places = spans.select("*", part.alias("part"), F.explode(cells).alias("cell"))
    extents = places.groupBy(*KEY, "part", "cell").agg(F.min("start").alias("first"), F.max("end").alias("last"))
    near = F.explode(F.array(F.col("cell") - 1, F.col("cell"), F.col("cell") + 1))
    reached = extents.select(
        F.col("doc_id").alias("_id"),
        F.col("text_hash").alias("_hash"),
        F.col("part").alias("_part"),
        near.alias("_cell"),
        "first",
        "last",
    )
    complement = F.lit(False)
    for kind, others in COMPLEMENTS.items():
        complement = complement | ((F.col("part") == kind) & F.col("_part").isin(*others))
    within = (F.col("first") <= F.col("end") + scope) & (F.col("last") >= F.col("start") - scope)
    return (
        places.filter(F.col("kind").isin(*WEAK))
        .join(
            reached,
            F.col("doc_id").eqNullSafe(F.col("_id"))
            & (F.col("text_hash") == F.col("_hash"))
            & (F.col("cell") == F.col("_cell"))
            & complement
            & within,
            "left_semi",
        )
        .select(*spans.columns)
        .distinct()
    )


def _listed(spans: Column) -> Column:
    named = F.transform(
        F.array_sort(spans),
        lambda span: F.concat_ws(":", span["kind"], span["start"].cast("string"), span["end"].cast("string")),
    )
    return F.array_join(named, ",")


def secrets(documents: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Spans of secrets in every document, in code points.

    Null and empty texts have none. Repeated rows each give a row, and rows without an id
    are scanned like others. Other columns are ignored.
    """
    rows = keyed(documents)
    spans = stored(scanned(rows), "spans")
    base = spans.filter(F.col("kind").isin(*BASE_KINDS))
    span = F.struct("start", "rank", "end", "kind")
    found = (
        base.unionByName(linked_candidates(spans, scope))
        .groupBy(*KEY)
        .agg(
            F.collect_list(F.when(F.col("kind").isin(*BASE_KINDS), span)).alias("base"),
            F.collect_list(span).alias("all"),
            *[F.count(F.when(F.col("kind") == kind, 1)).alias(f"n_{kind}") for kind in BASE_KINDS],
        )
    )
    nothing = F.expr(f"cast(array() as {_SPAN})")
    return with_results(rows.drop("text"), found).select(
        "doc_id",
        *[F.coalesce(f"n_{kind}", F.lit(0).cast("long")).alias(f"n_{kind}") for kind in BASE_KINDS],
        F.sha2(_listed(F.coalesce("base", nothing)), 256).alias("base_sha256"),
        _listed(F.coalesce("all", nothing)).alias("spans"),
    )
