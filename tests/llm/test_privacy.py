"""Personal data beyond the strict patterns: labelled spans, the model against plain sums, long texts."""

from __future__ import annotations

import random
import time

import numpy as np
import pytest

from boxmetrics.llm import privacy

SCHEMA = "doc_id long, text string"
FILLER = "the of and der und les des una para with from here there again value list".split()


def _card(rng, valid):
    while True:
        digits = "4" + "".join(rng.choices("0123456789", k=15))
        if privacy._luhn(digits) == valid:
            return digits


def _personal(rng):
    """A text that a span stands in, the span, and its kind."""
    name, host = rng.choice(["ann", "b.lee", "kim_2"]), rng.choice(["mail", "post-box", "web"])
    end = rng.choice(["com", "de", "fr", "org"])
    part = lambda: str(rng.randint(1, 254))
    number = f"{rng.randint(200, 999)}-{rng.randint(200, 999)}-{rng.randint(1000, 9999)}"
    quad = "[.]".join([str(rng.randint(1, 99)), part(), part(), part()])
    six = ":".join(f"{rng.randint(0, 65535):x}" for _ in range(8))
    card = _card(rng, True)
    return rng.choice(
        [
            (f"contact {{}} {rng.choice(FILLER)}", f"{name} [at] {host}.{end}", 0),
            (f"Kontakt: {{}}, {rng.choice(FILLER)}", f"{name} at {host} dot {end}", 0),
            ("from host {} again", quad, 1),
            ("server {} there", six, 1),
            ("card {} " + _card(rng, False), card, 2),
            ("tarjeta {} 123", card, 2),
            ("call {} here", number, 3),
            ("Telefon: {}.", number, 3),
        ]
    )


def _impersonal(rng):
    return rng.choice(
        [
            f"version {rng.randint(300, 999)}.1.{rng.randint(300, 999)}.2 of",
            f"order {_card(rng, False)} and",
            f"serial {_card(rng, False)}",
            f"page 2019-{rng.randint(10, 12)}-{rng.randint(10, 28)} list",
            f"table {rng.randint(10, 99)} {rng.randint(10, 99)} {rng.randint(10, 99)} {rng.randint(10, 99)} value",
            "meet at noon dot",
            "at 12:30:45 and 09:15:00",
        ]
    )


def _labelled(count, seed=4):
    rng, rows, wanted = random.Random(seed), [], set()
    for doc_id in range(count):
        text = ""
        for _ in range(rng.randint(1, 4)):
            text += " ".join(rng.choices(FILLER, k=rng.randint(12, 25))) + ".\n"
            if rng.random() < 0.5:
                frame, span, kind = _personal(rng)
                start = len(text) + frame.index("{")
                wanted.add((doc_id, kind, start, start + len(span)))
                text += frame.format(span)
            else:
                text += _impersonal(rng)
            text += "\n"
        rows.append((doc_id, text))
    # Plain personal data, which strict patterns find.
    for doc_id in range(count, 2 * count):
        kind = doc_id % 4
        span = ["ann@mail.com", "10.1.2.3", _card(rng, True), "+49 30 1234567"][kind]
        hint = ["e-mail", "address", "visa", "phone"][kind]
        rows.append((doc_id, f"the {hint} {span}\n"))
    return rows, wanted


def _added(listed):
    return {tuple(part.split(":")) for part in listed.split(",") if part}


@pytest.fixture(scope="module")
def found(spark):
    rows, wanted = _labelled(400)
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5)
    return rows, wanted, {row["doc_id"]: row for row in privacy.personal_data(frame).collect()}


def test_added_spans_are_right(found):
    rows, wanted, got = found
    made = {
        (doc_id, privacy.KINDS.index(kind), int(a), int(b))
        for doc_id, _ in rows[:400]
        for kind, a, b in _added(got[doc_id]["spans"])
    }
    assert len(wanted) > 300
    assert len(made & wanted) / len(made) >= 0.9, "precision"
    for kind in range(4):
        own = {span for span in wanted if span[1] == kind}
        assert len(made & own) / len(own) >= 0.9, privacy.KINDS[kind]


def test_spans_are_those_of_the_model(found):
    """The expression over votes and traits decides as the model does in Python."""
    rows, _, got = found
    cells = {}
    for _, text in rows:
        strict = privacy.strict_spans(text)
        for c in [*strict, *privacy.loose_spans(text, strict)]:
            cell = c.kind, privacy.votes(text, c), privacy.traits(text, c)
            cells[cell] = cells.get(cell, 0) + 1
    model = privacy.fitted([(kind, vote, n, seen) for (kind, vote, seen), n in sorted(cells.items())])
    for doc_id, text in rows:
        strict = privacy.strict_spans(text)
        loose = [c for c in privacy.loose_spans(text, strict) if model.keeps(c.kind, privacy.votes(text, c), privacy.traits(text, c))]
        every = sorted([*strict, *loose], key=lambda c: (c.start, c.kind))
        assert got[doc_id]["spans"] == ",".join(f"{privacy.KINDS[c.kind]}:{c.start}:{c.end}" for c in every)


def test_labelers_are_judged_by_kind():
    """A labeler that is right on one kind and random on another gets a say only on the first."""
    rng, cells = random.Random(2), {}
    for _ in range(20_000):
        kind, truth = rng.choice([2, 3]), rng.random() < 0.5
        right = 1 if truth else -1
        vote = (int(truth and rng.random() < 0.6), right if kind == 2 else rng.choice([-1, 1]), rng.choice([0, right]), right if rng.random() < 0.9 else -right)
        cells[kind, vote] = cells.get((kind, vote), 0) + 1
    patterns = sorted(cells)
    vote = np.array([v for _, v in patterns])
    chance = dict(zip(patterns, privacy.labelled(np.array([k for k, _ in patterns]), vote, np.array([float(cells[p]) for p in patterns]))))
    assert chance[2, (0, -1, 0, 1)] < 0.2 and chance[3, (0, -1, 0, 1)] > 0.5
    assert chance[2, (0, 1, 0, -1)] > 0.8 and chance[3, (0, 1, 0, -1)] < 0.5


def test_traits_and_weights_have_their_places():
    text = "x:(030) 12-34,"
    c = privacy.Candidate(3, 2, 13, False)
    assert privacy.traits(text, c) == (1, 1, 2, 1, 1)
    assert privacy.traits("a1b", privacy.Candidate(2, 1, 2, False)) == (0, 1, 0, 2, 2)
    size = sum(privacy._TRAIT_SIZES)
    last = tuple(n - 1 for n in privacy._TRAIT_SIZES)
    places = [place for kind in range(4) for values in ((0,) * 5, last) for place in privacy._trait_places(kind, values)]
    assert max(places) == 4 * size - 1 and min(places) == 0 and len(set(places)) == len(places)


def test_long_texts_take_linear_time():
    parts = ["7" * 400_000, "1 " * 200_000, "a:" * 200_000, "at " * 130_000, "a@" * 200_000, "12.34." * 70_000, "a" * 400_000 + " at x"]
    for text in (*parts, "\n".join(parts)):
        started = time.time()
        strict = privacy.strict_spans(text)
        for c in [*strict, *privacy.loose_spans(text, strict)][:1000]:
            privacy.votes(text, c), privacy.traits(text, c)
        assert time.time() - started < 20
