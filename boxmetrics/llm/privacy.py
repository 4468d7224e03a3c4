"""Personal data by weak supervision.

Candidates come from strict and from loose patterns. Labelers vote on each: the strict
pattern, a gazetteer, the words before it, and its shape. No labeler is trusted as such:
expectation-maximisation over the counts of vote patterns estimates how reliable each one is
for each kind, and a span classifier is trained on the probabilities that result. It sees the
kind, the votes but for that of the strict pattern, and traits of the span itself. Candidates
of the strict patterns always stay; the classifier decides about the others.

Counts of cells (kind, votes, traits) are all that reaches the driver: their number is bounded
by the labelers and traits, not by the data.
"""

from __future__ import annotations

import ipaddress
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxmetrics.llm.common import keyed, stored

KINDS = ("email", "ip", "card", "phone")
LABELERS = ("strict", "gazetteer", "context", "shape")
KEPT_CHANCE = 0.5
_ROUNDS = 60
#: How many candidates the reliabilities over all kinds count for in those of one kind.
_PRIOR = 20.0
_CONTEXT = 32

# The strict patterns.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9]){13,}+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
# Loose patterns: written-out addresses, addresses made unreadable to machines or of version 6,
# card numbers within longer runs of digits, and numbers without a country code.
_LOOSE_EMAIL = re.compile(
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}(?:\x20?[\[(](?:at|AT)[\])]\x20?|\x20(?:at|AT)\x20(?=[A-Za-z0-9-]{1,63}\x20(?:dot|DOT)\x20))"
    r"[A-Za-z0-9-]{1,63}(?:(?:\x20?(?:\.|[\[(](?:dot|DOT)[\])])\x20?|\x20(?:dot|DOT)\x20)[A-Za-z0-9-]{2,63}){1,4}"
)
_LOOSE_IP = re.compile(
    r"(?<![0-9A-Za-z.:])(?:[0-9]{1,3}(?:(?:\[\.\]|\(\.\)|\[dot\]|\(dot\))[0-9]{1,3}){3}|[0-9]{1,3}(?:\.[0-9]{1,3}){3})(?![0-9A-Za-z])"
    r"|(?<![0-9A-Za-z.:])(?=[0-9A-Fa-f]{0,4}:)[0-9A-Fa-f:]{6,39}(?![0-9A-Za-z:])"
)
_LOOSE_CARD = re.compile(
    r"(?<![0-9])(?:[0-9]{14,19}|4[0-9]{12}|[0-9]{4}(?:[\x20.-][0-9]{4}){3}|3[0-9]{3}[\x20.-][0-9]{6}[\x20.-][0-9]{4,5})(?![0-9])"
)
_LOOSE_PHONE = re.compile(r"(?<![0-9A-Za-z+.])\(?[0-9]{2,5}\)?(?:[\x20./-]{1,2}[0-9]{2,5}){2,4}(?![0-9A-Za-z])")
_NUMBER = re.compile(r"[0-9]")
_DIGITS = re.compile(r"[^0-9]")

# The gazetteer, fixed values: ends of addresses, calling codes of one and two digits, the first
# two digits of the codes with three, and how numbers of card issuers begin, with their lengths.
_DOMAIN_ENDS = frozenset(
    "com org net edu gov mil int info biz name pro io dev app co me tv ai cloud online site eu uk de fr es it at ch nl "
    "be lu dk se no fi is ie pt pl cz sk hu ro bg gr hr si rs ua by ru ee lv lt mt cy tr il sa ae eg ma za ng ke gh in "
    "pk bd lk cn jp kr tw hk sg my th vn id ph au nz ca us mx br ar cl pe uy ve ec bo py cr pa do cu example test".split()
)
_COUNTRY_CODES = frozenset(
    "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 "
    "90 91 92 93 94 95 98 21 22 23 24 25 26 29 35 37 38 42 50 59 67 68 69 80 85 87 88 96 97 99".split()
)
_ISSUERS = re.compile(
    r"4(?:[0-9]{12}|[0-9]{15}|[0-9]{18})|5[1-5][0-9]{14}|2(?:22[1-9]|2[3-9][0-9]|[3-6][0-9]{2}|7[01][0-9]|720)[0-9]{12}"
    r"|3[47][0-9]{13}|3(?:0[0-5]|[68][0-9])[0-9]{11}|(?:6011|64[4-9][0-9]|65[0-9]{2}|35[0-9]{2}|62[0-9]{2})[0-9]{12}"
)
# Words that come before personal data of a kind, and before other numbers.
_HINTS = {
    "email": re.compile(r"(?i)e-?mail|contact|write|mailto|reach|correo|escrib|courriel|écri|kontakt|schreib|erreich"),
    "ip": re.compile(r"(?i)\bip(?:v[46])?\b|address|host|server|client|from|login|dirección|servidor|adresse|serveur|anmeld"),
    "card": re.compile(r"(?i)card|visa|master|amex|credit|debit|pay|karte|kredit|zahl|carte|paie|tarjeta|pago"),
    "phone": re.compile(r"(?i)phone|\btel\b|call|mobile|cell|fax|dial|telefon|ruf|handy|llame|teléfono|móvil|appel|téléphone|portable"),
}
_OTHERS = re.compile(
    r"(?i)version|isbn|issn|doi|order|page|figure|table|section|invoice|serial|part|build|chapter|©|seite|tabelle|abschnitt|"
    r"rechnung|bestell|página|tabla|sección|factura|pedido|tableau|facture|commande"
)


@dataclass(frozen=True)
class Candidate:
    kind: int
    start: int
    end: int
    strict: bool


def _luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + place % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Each at sign with the run of allowed characters before it and a domain after it."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at) if start < at else None
        if domain:
            done = domain.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def strict_spans(text: str) -> list[Candidate]:
    """The spans that are always reported, by start and then kind."""
    found = []
    if "@" in text:
        found += [Candidate(0, a, b, True) for a, b in _emails(text)]
    if _NUMBER.search(text):
        for hit in _IP.finditer(text):
            if all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or 0) <= 255 for part in hit[0].split(".")):
                found.append(Candidate(1, *hit.span(), True))
        for hit in _CARD.finditer(text):
            digits = _DIGITS.sub("", hit[0])
            if len(digits) <= 19 and _luhn(digits):
                found.append(Candidate(2, *hit.span(), True))
        if "+" in text:
            for hit in _PHONE.finditer(text):
                if 10 <= len(_DIGITS.sub("", hit[0])) <= 15:
                    found.append(Candidate(3, *hit.span(), True))
    return sorted(found, key=lambda c: (c.start, c.kind))


def loose_spans(text: str, strict: list[Candidate]) -> list[Candidate]:
    """Further candidates that overlap no strict span and no earlier candidate."""
    found = []
    if "at" in text or "AT" in text:
        found += [Candidate(0, *hit.span(), False) for hit in _LOOSE_EMAIL.finditer(text)]
    if "." in text or "dot" in text or ":" in text:
        # Times of day are runs of digits and colons as well, but have neither a gap nor eight parts.
        found += [
            Candidate(1, *hit.span(), False)
            for hit in _LOOSE_IP.finditer(text)
            if ":" not in hit[0] or hit[0].count(":") == 7 or "::" in hit[0]
        ]
    if _NUMBER.search(text):
        found += [Candidate(2, *hit.span(), False) for hit in _LOOSE_CARD.finditer(text)]
        found += [
            Candidate(3, *hit.span(), False)
            for hit in _LOOSE_PHONE.finditer(text)
            if 8 <= len(_DIGITS.sub("", hit[0])) <= 15
        ]
    kept, taken = [], sorted((c.start, c.end) for c in strict)
    # The greatest end of the strict spans that begin before the end of a candidate decides.
    at, taken_upto, last = 0, 0, 0
    for candidate in sorted(found, key=lambda c: (c.end, c.start, c.kind)):
        while at < len(taken) and taken[at][0] < candidate.end:
            taken_upto = max(taken_upto, taken[at][1])
            at += 1
        if taken_upto <= candidate.start:
            kept.append(candidate)
    free = []
    for candidate in sorted(kept, key=lambda c: (c.start, c.kind)):
        if candidate.start >= last:
            free.append(candidate)
            last = candidate.end
    return free


def votes(text: str, candidate: Candidate) -> tuple[int, ...]:
    """1 for, -1 against and 0 for no opinion, by labeler."""
    kind, span = KINDS[candidate.kind], text[candidate.start : candidate.end]
    digits = _DIGITS.sub("", span)
    before = text[max(0, candidate.start - _CONTEXT) : candidate.start]
    gazetteer = 0
    if kind == "email":
        gazetteer = 1 if re.split(r"[^A-Za-z]+", span)[-1].lower() in _DOMAIN_ENDS else -1
    elif kind == "phone" and span[0] == "+":
        gazetteer = 1 if any(digits[:size] in _COUNTRY_CODES for size in (1, 2)) else -1
    elif kind == "ip" and ":" not in span:
        gazetteer = -1 if int(_DIGITS.split(span, maxsplit=1)[0]) in (0, 127, 255) else 1
    elif kind == "card":
        gazetteer = 1 if _ISSUERS.fullmatch(digits) else -1
    context = 1 if _HINTS[kind].search(before) else -1 if _OTHERS.search(before) else 0
    shape = 0
    if kind == "phone":
        shape = 1 if 9 <= len(digits) <= 13 else -1
        if re.fullmatch(r"(19|20)[0-9]{2}[./-][0-9]{1,2}[./-][0-9]{1,2}.*|[0-9]{1,2}[./-][0-9]{1,2}[./-](19|20)[0-9]{2}", span):
            shape = -1
    elif kind == "card":
        shape = 1 if len(digits) in (13, 14, 15, 16, 19) and _luhn(digits) else -1
    elif kind == "email":
        shape = 1 if 6 <= len(span) <= 64 else -1
    elif kind == "ip":
        shape = 1 if _is_address(span) else -1
    if kind != "ip" and len(set(digits)) == 1 and len(digits) > 1:
        shape = -1
    return (1 if candidate.strict else 0, gazetteer, context, shape)


def _is_address(span: str) -> bool:
    try:
        ipaddress.ip_address(span if ":" in span else ".".join(re.findall("[0-9]+", span)))
    except ValueError:
        return False
    return True


#: How many values each trait of a span has: length, kinds of characters, separators, neighbours.
_TRAIT_SIZES = (4, 4, 3, 4, 4)
_OPENING, _CLOSING = frozenset("([{<\"':=,;"), frozenset(")]}>\"'.,;:!?")


def traits(text: str, candidate: Candidate) -> tuple[int, ...]:
    """What the span looks like, and what stands beside it, as small numbers."""
    span = text[candidate.start : candidate.end]
    letters, digits = any(c.isalpha() for c in span), any(c.isdigit() for c in span)
    separators = sum(not c.isalnum() for c in span)
    return (
        min(len(span) // 8, 3),
        2 * letters + digits,
        0 if not separators else 1 if separators <= 3 else 2,
        _neighbour(text[candidate.start - 1 : candidate.start] if candidate.start else "", _OPENING),
        _neighbour(text[candidate.end : candidate.end + 1], _CLOSING),
    )


def _neighbour(character: str, usual: frozenset[str]) -> int:
    if not character or character.isspace():
        return 0
    return 1 if character in usual else 2 if character.isalnum() else 3


def _trait_places(kind: int, values: tuple[int, ...]) -> list[int]:
    """Where the weights of these traits are: each kind has its own."""
    starts = np.cumsum((0, *_TRAIT_SIZES))
    return [int(kind * starts[-1] + start + value) for start, value in zip(starts, values)]


def _no_traits() -> np.ndarray:
    return np.zeros(len(KINDS) * sum(_TRAIT_SIZES))


@dataclass(frozen=True)
class SpanModel:
    """Chance of a candidate being personal data, from its kind, votes and traits."""

    weights: np.ndarray
    of_traits: np.ndarray = field(default_factory=_no_traits)

    def log_odds(self, kind: int, vote: tuple[int, ...], values: tuple[int, ...] = ()) -> float:
        total = float(_features(kind, vote) @ self.weights)
        for place in _trait_places(kind, values):
            total += float(self.of_traits[place])
        return total

    def chance(self, kind: int, vote: tuple[int, ...], values: tuple[int, ...] = ()) -> float:
        return float(1.0 / (1.0 + np.exp(-self.log_odds(kind, vote, values))))

    def keeps(self, kind: int, vote: tuple[int, ...], values: tuple[int, ...] = ()) -> bool:
        return self.log_odds(kind, vote, values) >= np.log(KEPT_CHANCE / (1 - KEPT_CHANCE))


def _features(kind: int, vote: tuple[int, ...]) -> np.ndarray:
    """The kind, and for and against by labeler; whether a span is strict is not told, as
    that is what decides for the others."""
    kinds = [float(kind == k) for k in range(len(KINDS))]
    sides = [float(value == side) for value in vote[1:] for side in (1, -1)]
    return np.array([1.0, *kinds, *sides])


@dataclass(frozen=True)
class Reliability:
    """How often candidates are personal data, and how labelers vote on those and on others."""

    share: float
    hit: np.ndarray
    miss: np.ndarray


def _reliability(vote: np.ndarray, weight: np.ndarray, truth: np.ndarray, prior: Reliability, strength: float) -> Reliability:
    size = strength + weight.sum()
    chances = []
    for mass, before in ((weight * truth, prior.hit), (weight * (1 - truth), prior.miss)):
        counts = np.stack([np.bincount(vote[:, labeler], mass, 3) for labeler in range(len(LABELERS))]) + strength * before
        chances.append(counts / counts.sum(axis=1, keepdims=True))
    return Reliability(float(((weight * truth).sum() + strength * prior.share) / size), *chances)


def _chances(vote: np.ndarray, found: Reliability) -> np.ndarray:
    odds = np.full(len(vote), np.log((found.share + 1e-6) / (1 - found.share + 1e-6)))
    for labeler in range(len(LABELERS)):
        odds += np.log(found.hit[labeler] / found.miss[labeler])[vote[:, labeler]]
    return 1.0 / (1.0 + np.exp(-np.clip(odds, -30, 30)))


def labelled(kind: np.ndarray, vote: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Chance of each vote pattern being personal data, by expectation-maximisation.

    Labelers are taken as independent given the truth; each has its own chances of voting for,
    against or not at all in both cases. They are first estimated over all kinds; then each kind
    has its own, which start from those as if _PRIOR candidates had shown them.
    """
    vote = vote + 1
    # More votes for than against is where the truth is first looked for.
    truth = 1.0 / (1.0 + np.exp(-(vote - 1).sum(axis=1).astype(float)))
    even = np.full((len(LABELERS), 3), 1 / 3)
    pooled = Reliability(0.5, even, even)
    flat = pooled
    for _ in range(_ROUNDS):
        pooled = _reliability(vote, count, truth, flat, 1.5)
        truth = _chances(vote, pooled)
    for number in np.unique(kind):
        own = np.flatnonzero(kind == number)
        for _ in range(_ROUNDS):
            truth[own] = _chances(vote[own], _reliability(vote[own], count[own], truth[own], pooled, _PRIOR))
    return truth


def fitted(patterns: list[tuple]) -> SpanModel:
    """From (kind, votes, count) or (kind, votes, count, traits): the truth by
    expectation-maximisation over the votes, then a classifier of spans.

    Without candidates nothing is kept.
    """
    if not patterns:
        return SpanModel(np.r_[-10.0, np.zeros(len(KINDS) + 2 * (len(LABELERS) - 1))])
    count = np.array([float(p[2]) for p in patterns])
    truth = labelled(np.array([p[0] for p in patterns]), np.array([p[1] for p in patterns]), count)
    plain = np.stack([_features(p[0], p[1]) for p in patterns])
    shown = np.zeros((len(patterns), len(_no_traits())))
    for row, p in enumerate(patterns):
        shown[row, _trait_places(p[0], p[3] if len(p) > 3 else ())] = 1.0
    features = np.c_[plain, shown]
    weights = np.zeros(features.shape[1])
    weight = count / count.sum()
    # Traits must show more than votes before they count.
    ridge = np.diag(np.r_[np.full(plain.shape[1], 1e-3), np.full(shown.shape[1], 1e-2)])
    for _ in range(30):
        chance = 1.0 / (1.0 + np.exp(-(features @ weights)))
        gradient = features.T @ (weight * (chance - truth)) + ridge @ weights
        curve = (features * (weight * chance * (1 - chance))[:, None]).T @ features + ridge
        weights = weights - np.linalg.solve(curve, gradient)
    return SpanModel(weights[: plain.shape[1]], weights[plain.shape[1] :])


_SPANS = "array<struct<kind: int, start: bigint, end: bigint, strict: boolean, votes: array<int>, traits: array<int>>>"


def candidates(text: Column) -> Column:
    """All candidates of each text with their votes, by start and then kind."""

    @F.arrow_udf(_SPANS)
    def found(texts: pa.Array) -> pa.Array:
        rows = []
        for text in texts.to_pylist():
            strict = strict_spans(text)
            every = sorted([*strict, *loose_spans(text, strict)], key=lambda c: (c.start, c.kind))
            rows.append(
                [
                    {
                        "kind": c.kind,
                        "start": c.start,
                        "end": c.end,
                        "strict": c.strict,
                        "votes": list(votes(text, c)),
                        "traits": list(traits(text, c)),
                    }
                    for c in every
                ]
            )
        kind = pa.struct(
            [
                ("kind", pa.int32()),
                ("start", pa.int64()),
                ("end", pa.int64()),
                ("strict", pa.bool_()),
                ("votes", pa.list_(pa.int32())),
                ("traits", pa.list_(pa.int32())),
            ]
        )
        return pa.array(rows, pa.list_(kind))

    return found(text)


def trained(found: DataFrame) -> SpanModel:
    """The model for the candidates of all rows. Equal vote patterns are counted in Spark."""
    cells = (
        found.select(F.inline("spans"))
        .groupBy("kind", "votes", "traits")
        .agg(F.count("*").alias("n"))
        .orderBy("kind", "votes", "traits")
        .collect()
    )
    return fitted([(row["kind"], tuple(row["votes"]), row["n"], tuple(row["traits"])) for row in cells])


def _kept(spans: Column, model: SpanModel) -> Column:
    """Strict spans, and the others that the classifier accepts.

    The log-odds of each kind and vote are a table; those of traits are added to them.
    """
    sides = (-1, 0, 1)
    table = F.array(
        *[
            F.lit(model.log_odds(kind, (0, a, b, c)))
            for kind in range(len(KINDS))
            for a in sides
            for b in sides
            for c in sides
        ]
    )
    of_traits = F.array(*[F.lit(float(value)) for value in model.of_traits])
    starts = [int(n) for n in np.cumsum((0, *_TRAIT_SIZES))]

    def keeps(span: Column) -> Column:
        side = [F.element_at(span["votes"], number) + 1 for number in (2, 3, 4)]
        odds = F.element_at(table, ((span["kind"] * 3 + side[0]) * 3 + side[1]) * 3 + side[2] + 1)
        for number, start in enumerate(starts[:-1]):
            value = F.element_at(span["traits"], number + 1)
            odds = odds + F.element_at(of_traits, span["kind"] * starts[-1] + start + value + 1)
        return span["strict"] | (odds >= float(np.log(KEPT_CHANCE / (1 - KEPT_CHANCE))))

    return F.filter(spans, keeps)


def _listed(spans: Column) -> Column:
    names = F.array(*[F.lit(kind) for kind in KINDS])
    return F.array_join(
        F.transform(
            spans,
            lambda s: F.concat_ws(
                ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string")
            ),
        ),
        ",",
    )


def _same(number: int):
    return lambda value: value == number


def personal_data(documents: DataFrame) -> DataFrame:
    """Counts and spans of personal data for every document, in code points.

    Null and empty texts have none. Repeated rows each give a row, and rows without an id are
    searched like others. Other columns are ignored.
    """
    found = stored(keyed(documents).select("doc_id", candidates(F.col("text")).alias("spans")), "candidates")
    model = trained(found)
    strict = F.filter("spans", lambda span: span["strict"])
    return found.select(
        "doc_id",
        *[
            F.size(F.filter(strict["kind"], _same(number))).cast("long").alias(f"n_{kind}")
            for number, kind in enumerate(KINDS)
        ],
        F.sha2(_listed(strict), 256).alias("base_sha256"),
        _listed(_kept(F.col("spans"), model)).alias("spans"),
    )


def redacted(documents: DataFrame) -> DataFrame:
    """The documents with every span of personal data replaced by its kind in brackets.

    All columns stay. A null text stays null.
    """
    model = trained(stored(keyed(documents).select(candidates(F.col("text")).alias("spans")), "candidates"))

    @F.arrow_udf("string")
    def cleaned(texts: pa.Array) -> pa.Array:
        return pa.array([None if text is None else _redacted(text, model) for text in texts.to_pylist()], pa.string())

    return documents.withColumn("text", cleaned(F.col("text").cast("string")))


def _redacted(text: str, model: SpanModel) -> str:
    strict = strict_spans(text)
    every = [*strict, *[c for c in loose_spans(text, strict) if model.keeps(c.kind, votes(text, c), traits(text, c))]]
    parts, done = [], 0
    for c in sorted(every, key=lambda c: (c.start, c.kind)):
        if c.end <= done:
            continue
        parts += [text[done : max(c.start, done)], f"[{KINDS[c.kind]}]"]
        done = c.end
    return "".join([*parts, text[done:]])
