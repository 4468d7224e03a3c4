"""Boilerplate in four languages, by the operator, by SQL and by plain reading."""

from __future__ import annotations

import duckdb
import pytest

from boxmetrics.llm import line_rules, sql

PROSE = "the river runs along the old wall and then turns to the sea where nets dry in the sun today"
REMOVED = [
    "All rights reserved.",
    "© 2024 by the authors",
    "2024© the authors",
    "(LICENCED UNDER the terms)",
    "ALLE RECHTE VORBEHALTEN",
    "Unsere DATENSCHUTZERKLÄRUNG finden",
    "Diese Seite verwendet Cookies",
    "Tous droits RÉSERVÉS",
    "«Conditions d’utilisation»",
    "Abonnez-vous maintenant",
    "TÉRMINOS y condiciones",
    "Suscríbete a la lista",
    "REGÍSTRATE para seguir",
]
KEPT = [
    "unsubscribe to the list",
    "the reimpressum of old books",
    "los extérminos de uso",
    "a copyrighted book",
    "a share onward and a licence",
    "Tous les droits sont réservés",
    f"{PROSE} {PROSE} all rights reserved",
]


@pytest.mark.parametrize("line", REMOVED + KEPT)
def test_patterns_by_plain_reading(line):
    import regex

    found = regex.search(line_rules.BOILERPLATE, line) is not None
    assert found == (line in REMOVED or line.endswith("all rights reserved"))


def test_lines_are_removed_as_in_sql(spark):
    texts = [f"{PROSE}\n{line}\n{PROSE[::-1]}" for line in REMOVED + KEPT]
    texts += [None, "", "ſhare this or clicK here K", "\n".join(REMOVED), "\n".join([PROSE, *REMOVED, *REMOVED])]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = line_rules.quality(frame)
    cleaned = {row["doc_id"]: row["clean_text"] for row in found.collect()}
    for at, line in enumerate(REMOVED + KEPT):
        lines = [PROSE, line, PROSE[::-1]] if line in KEPT else [PROSE, PROSE[::-1]]
        assert cleaned[at].split("\n") == lines
    verdicts = found.drop("clean_text")
    with duckdb.connect() as base:
        base.register("documents", frame.toArrow())
        wanted = base.execute(sql.op7())
        names = [column[0] for column in wanted.description]
        assert sorted(names) == sorted(verdicts.columns)
        assert sorted(wanted.fetchall()) == sorted(tuple(row) for row in verdicts.select(*names).collect())


def test_each_phrase_is_found_in_any_case():
    import regex

    for phrases in line_rules.PHRASES.values():
        for phrase in phrases:
            pattern = regex.compile(line_rules.boilerplate({"": (phrase,)}))
            plain = regex.sub(r"\(([^|()]*)\|?[^()]*\)\??", r"\1", phrase).replace("[sc]", "s").replace("d?", "d").replace("e?", "e")
            for text in (plain, plain.upper(), plain.title(), f"• {plain}"):
                assert pattern.search(text), (phrase, text)
            assert not pattern.search(f"x{plain}") and not pattern.search(f"{plain}x")
