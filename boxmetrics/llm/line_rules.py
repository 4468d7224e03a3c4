"""Line-first cleaning, then document rules.

Every line is judged by itself: lines of navigation, of boilerplate and of bare punctuation
are removed. A document that loses more than a share of its words this way is rejected, as
are documents that fail the base rules on length and repetition.

All steps are DataFrame expressions on one row; nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST_WORDS = 20
WINDOW = 8
MOST_REPEATED_PERCENT = 30
#: A document is rejected if removed lines hold more than this share of its words.
MOST_REMOVED_PERCENT = 50

# Fixed values of the base counts.
_SPACES = r"[\x20\x09-\x0D]+"
_SYMBOLS = r"[^#*$%&|<>]+"
# Line rules. Navigation: short entries between bars, arrows or bullets.
SEPARATED = "[|»›>•·]"
LEAST_BARS = 3
WORDS_PER_BAR = 4
#: A line is removed if more than this share of its characters are neither letters nor digits.
MOST_MARKS_PERCENT = 25
NOT_MARKS = r"[\p{L}\p{M}\p{N}\x20\x09-\x0D]+"
#: Phrases of boilerplate by language, as patterns of any case. They are whole words.
PHRASES = {
    "en": (
        "all rights reserved",
        "copyright",
        "licen[sc]ed? under",
        "terms of (use|service)",
        "privacy policy",
        "cookie policy",
        "use of cookies",
        "subscribe to",
        "sign (in|up) (to|for)",
        "log in to",
        "click here",
        "lorem ipsum",
        "enable javascript",
        "read more",
        "share (on|this)",
    ),
    "de": (
        "alle rechte vorbehalten",
        "datenschutz(erklärung|hinweise|bestimmungen)",
        "nutzungsbedingungen",
        "allgemeine geschäftsbedingungen",
        "impressum",
        "newsletter abonnieren",
        "jetzt (abonnieren|anmelden|registrieren)",
        "hier klicken",
        "klicken sie hier",
        "verwende(t|n) cookies",
        "cookie-(richtlinie|einstellungen)",
        "weiterlesen",
        "mehr (lesen|erfahren)",
        "lizenziert unter",
        "(artikel|beitrag|seite) teilen",
    ),
    "fr": (
        "tous droits réservés",
        "politique (de confidentialité|relative aux cookies)",
        "conditions (générales|d.utilisation)",
        "mentions légales",
        "cliquez ici",
        "lire la suite",
        "en savoir plus",
        "(abonnez|inscrivez|connectez)-vous",
        "utilis(e|ons) des cookies",
        "gestion des cookies",
        "activer javascript",
        "(publié|distribué)e? sous licence",
        "partager (sur|cet article|cette page)",
    ),
    "es": (
        "todos los derechos reservados",
        "política de (privacidad|cookies)",
        "términos (de uso|y condiciones|del servicio)",
        "condiciones de uso",
        "aviso legal",
        "ha(ga|z) clic",
        "leer más",
        "seguir leyendo",
        "suscr(íbete|íbase) a",
        "regístr(ate|ese) (en|para)",
        "iniciar sesión",
        "uso de cookies",
        "(habilit|activ)(ar|e) javascript",
        "bajo (la )?licencia",
        "compart(ir|e) (en|este|esta)",
    ),
}


def _any_case(pattern: str) -> str:
    """Each letter as a class of both cases, which all engines read alike."""
    both = []
    in_class = False
    for char in pattern:
        in_class = char == "[" or (in_class and char != "]")
        upper = char.upper()
        if upper == char or len(upper) > 1:
            both.append(char)
        else:
            both.append(char + upper if in_class else f"[{char}{upper}]")
    return "".join(both)


def boilerplate(phrases: dict[str, tuple[str, ...]] = PHRASES) -> str:
    """One pattern of the phrases in all languages."""
    listed = "|".join(_any_case(phrase) for of_language in phrases.values() for phrase in of_language)
    return rf"©|(^|[^\p{{L}}])({listed})($|[^\p{{L}}])"


BOILERPLATE = boilerplate()
#: A line longer than this is text even if it names a boilerplate phrase.
BOILERPLATE_WORDS = 30


def words(text: Column) -> Column:
    return F.filter(F.split(text, _SPACES, -1), lambda word: word != "")


def symbols(text: Column) -> Column:
    return F.length(F.regexp_replace(text, _SYMBOLS, "")).cast("long")


def _let(value: Column, body) -> Column:
    """`body` of a value that is computed once. Inside a lambda, an expression from outside
    would be computed again for every element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _covered(starts: Column, window: int) -> Column:
    """Words in windows that begin at the ascending starts."""
    return F.aggregate(
        starts,
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("sum")),
        lambda state, at: F.struct(
            (at + window).alias("end"),
            (state["sum"] + (at + window) - F.greatest(state["end"], at)).alias("sum"),
        ),
        lambda state: state["sum"],
    )


def repeated_words(parts: Column, window: int = WINDOW) -> Column:
    """Words within windows that occur twice or more in the text, the first included.

    `parts` must be a column, not an expression. Windows are equal if the 64-bit hashes over
    the hashes of their words are.
    """

    def hashed(hashes: Column) -> Column:
        places = F.sequence(F.lit(1), F.size(hashes) - window + 1)
        return F.transform(places, lambda at: F.xxhash64(F.slice(hashes, at, window)))

    def repeated(windows: Column) -> Column:
        placed = F.array_sort(F.transform(windows, lambda h, at: F.struct(h.alias("h"), (at + 1).alias("at"))))
        return _let(placed, neighbours)

    def neighbours(ordered: Column) -> Column:
        # In the order of the hashes, equal windows stand next to each other.
        met = F.zip_with(
            F.slice(ordered, 2, F.size(ordered)),
            F.slice(ordered, 1, F.size(ordered) - 1),
            lambda a, b: F.when(a["h"] == b["h"], F.array(a["at"], b["at"])),
        )
        starts = F.array_sort(F.array_distinct(F.flatten(F.filter(met, lambda pair: pair.isNotNull()))))
        return _covered(starts, window)

    # Most texts have no repeated window: comparing numbers of distinct hashes tells.
    counted = _let(
        F.transform(parts, lambda word: F.xxhash64(word)),
        lambda hashes: _let(
            hashed(hashes),
            lambda windows: F.when(F.size(F.array_distinct(windows)) < F.size(windows), repeated(windows)).otherwise(0),
        ),
    )
    return F.when(F.size(parts) <= window, F.lit(0)).otherwise(counted).cast("long")


def line_verdicts(lines: Column) -> Column:
    """For each line: its number of words and whether a rule removes it."""

    def measured(line: Column) -> Column:
        return F.struct(
            line.alias("line"),
            F.size(words(line)).alias("words"),
            (F.length(line) - F.length(F.regexp_replace(line, SEPARATED, ""))).alias("bars"),
            F.length(F.regexp_replace(line, NOT_MARKS, "")).alias("marks"),
            F.length(F.regexp_replace(line, _SPACES, "")).alias("size"),
        )

    def judged(line: Column) -> Column:
        navigation = (line["bars"] >= LEAST_BARS) & (line["bars"] * WORDS_PER_BAR >= line["words"])
        boilerplate = (line["words"] <= BOILERPLATE_WORDS) & line["line"].rlike(BOILERPLATE)
        bare = line["marks"] * 100 > line["size"] * MOST_MARKS_PERCENT
        removed = (line["words"] > 0) & (navigation | boilerplate | bare)
        return F.struct(line["words"].alias("words"), removed.alias("removed"))

    return F.transform(F.transform(lines, measured), judged)


def duplicate_lines(lines: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    filled = F.filter(lines, lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    return (F.size(filled) - F.size(F.array_distinct(filled))).cast("long")


def quality(documents: DataFrame, most_removed: int = MOST_REMOVED_PERCENT) -> DataFrame:
    """Counts and verdict for every document, with the text that its kept lines make.

    Null and empty texts have no words and are rejected as too short. Each input row gives
    one row, whatever its id; repeated rows get equal verdicts. Other columns are ignored.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), words(text).alias("parts")
    )
    lines = F.split("text", "\n", -1)
    verdicts = line_verdicts(lines)
    counted = rows.select(
        "doc_id",
        "text",
        F.size("parts").cast("long").alias("n_words"),
        F.length(F.regexp_replace("text", _SPACES, "")).cast("long").alias("word_chars"),
        symbols(F.col("text")).alias("n_symbols"),
        duplicate_lines(lines).alias("n_dup_lines"),
        repeated_words(F.col("parts")).alias("n_repeat_words"),
        verdicts.alias("verdicts"),
    )
    removed = F.aggregate(
        "verdicts",
        F.lit(0),
        lambda total, line: total + F.when(line["removed"], line["words"]).otherwise(0),
    )
    failed = (F.col("n_words") < LEAST_WORDS) | (
        F.col("n_repeat_words") * 100 > F.col("n_words") * MOST_REPEATED_PERCENT
    )
    judged = counted.select("*", removed.cast("long").alias("n_removed_words"), failed.alias("base_failed"))
    kept_lines = F.transform(
        F.filter(F.arrays_zip(F.split("text", "\n", -1).alias("line"), "verdicts"), lambda pair: ~pair["verdicts"]["removed"]),
        lambda pair: pair["line"],
    )
    return judged.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        (~F.col("base_failed") & (F.col("n_removed_words") * 100 <= F.col("n_words") * most_removed)).alias("kept"),
        "n_removed_words",
        F.array_join(kept_lines, "\n").alias("clean_text"),
    )
