"""Personal data: regular expressions propose spans, checksums confirm them, nearby words adjust their score.

Four kinds (email, ip, card, phone) always stay where their rule holds. More kinds are proposed by patterns of their own,
confirmed by a checksum where the kind has one (mod 97, mod 23, mod 11,10, Luhn) or by its structure, and kept if their score
reaches THRESHOLD: a prior of the kind, more with a word of the kind nearby, less with a word that speaks against it.
Every pattern takes time linear in the text: runs are matched whole and never tried again from within. Texts are independent
of each other, so nothing is shuffled.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator
from math import log2
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import ship

#: Kinds whose spans always stay, in the order in which they are listed.
BASE = ("email", "ip", "card", "phone")
#: Score from which a span of another kind is kept, what a word nearby adds or takes, and the characters looked at before and after a span.
THRESHOLD, FOR, AGAINST, BEFORE, AFTER = 0.5, 0.3, 0.3, 48, 24
#: Lengths of account numbers by country (fixed values).
IBAN_LENGTHS = {
    "AD": 24, "AT": 20, "BE": 16, "BG": 22, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "EE": 20, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "GR": 27, "HR": 21,
    "HU": 28, "IE": 22, "IT": 27, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MT": 31, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "RO": 24, "SE": 24, "SI": 19, "SK": 24,
}
#: Check letters of Spanish identity numbers by remainder (fixed values).
DNI_LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE"

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_DIGITS = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NO_DIGIT = str.maketrans("", "", " -().+")
_WORD = re.compile(r"[^\W\d_]+")
SPAN = "struct<kind: string, start: long, end: long, score: double, base: boolean>"


def luhn(digits: str) -> bool:
    own, doubled = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, own)) + sum(2 * int(d) - 9 * (d > "4") for d in doubled)) % 10 == 0


def mod_97(account: str) -> bool:
    """Whether the number that the account makes, its first four characters moved to the end, leaves 1."""
    return int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97 == 1


def mod_11_10(digits: str) -> bool:
    product = 10
    for d in digits[:-1]:
        product = ((int(d) + product) % 10 or 10) * 2 % 11
    return (11 - product) % 10 == int(digits[-1])


def emails(text: str) -> Iterator[tuple[int, int]]:
    """A local part reaches back from its @ to the last other character or to the end of the match before."""
    at, done = text.find("@"), 0
    while at >= 0:
        if found := _DOMAIN.match(text, at + 1):
            start = at
            while start > done and ((c := text[start - 1]).isalnum() and c.isascii() or c in "._%+-"):
                start -= 1
            if start < at:
                yield start, found.end()
                done = found.end()
        done = max(done, at + 1)  # a later local part holds no @
        at = text.find("@", done)


def addresses(text: str) -> Iterator[tuple[int, int]]:
    """Four numbers at a time of each run of numbers and dots."""
    for run in _DOTTED.finditer(text):
        if run.group().count(".") < 3:
            continue
        parts, start = run.group().split("."), run.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            end = start + sum(map(len, four)) + 3
            if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in four):
                yield start, end
            start = end + 1


def cards(text: str) -> Iterator[tuple[int, int]]:
    for run in _DIGITS.finditer(text):
        digits = run.group().translate(_NO_DIGIT)
        if 13 <= len(digits) <= 19 and luhn(digits):
            yield run.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    if "+" in text:
        for run in _PHONE.finditer(text):
            if 9 <= len(run.group().translate(_NO_DIGIT)) <= 15:
                yield run.span()


_FOUND: dict[str, Callable[[str], Iterator[tuple[int, int]]]] = {"email": emails, "ip": addresses, "card": cards, "phone": phones}


class Kind(NamedTuple):
    """needs: characters one of which a text with such a span has; group 1 of the pattern is the span; confirmed gives its end or None."""

    name: str
    prior: float
    needs: str
    pattern: re.Pattern
    confirmed: Callable[[str], int | None]


def _whole(test: Callable[[str], bool]) -> Callable[[str], int | None]:
    return lambda span: len(span) if test(span) else None


def _iban(span: str) -> int | None:
    """The account number of its country's length at the beginning of span; capitals may follow after a space."""
    places = [k for k, c in enumerate(span) if c != " "]
    n = IBAN_LENGTHS.get(span[:2], 0)
    if not 0 < n <= len(places):
        return None
    end = places[n - 1] + 1
    return end if (end == len(span) or span[end] == " ") and mod_97(span[:end].replace(" ", "")) else None


def _ssn(span: str) -> bool:
    area, group, serial = span.split("-")
    return area not in ("000", "666") and area < "900" and group != "00" and serial != "0000"


def _nir(span: str) -> bool:
    digits = span.replace(" ", "")
    return 97 - int(digits[:13]) % 97 == int(digits[13:])


def _dni(span: str) -> bool:
    number, letter = span[:-1].rstrip("-"), span[-1]
    return DNI_LETTERS[int(str("XYZ".find(number[0])) + number[1:] if number[0] in "XYZ" else number) % 23] == letter


def _steuer_id(span: str) -> bool:
    """Eleven digits of which just one stands twice or three times among the first ten, and the check digit."""
    times = sorted(Counter(span[:10]).values(), reverse=True)
    return times[0] in (2, 3) and times[1] == 1 and mod_11_10(span)


def _entropy(span: str) -> bool:
    """Bits a character as in keys that a machine has made, or a mix of classes as in passwords."""
    counts, n = Counter(span).values(), len(span)
    bits = -sum(c / n * log2(c / n) for c in counts)
    classes = sum(any(test(c) for c in span) for test in (str.islower, str.isupper, str.isdigit, lambda c: not c.isalnum()))
    return bits >= 3 and classes >= 2


#: Kinds of our own, in the order in which they are listed after the others.
MORE = (
    Kind("iban", 0.8, "0123456789", re.compile(r"\b([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,32})(?![A-Za-z0-9])"), _iban),
    Kind("ssn", 0.5, "-", re.compile(r"(?<![0-9-])([0-9]{3}-[0-9]{2}-[0-9]{4})(?![0-9-])"), _whole(_ssn)),
    Kind("nir", 0.6, "12", re.compile(r"(?<![0-9])([12](?: ?[0-9]){14})(?! ?[0-9])"), _whole(_nir)),
    Kind("dni", 0.5, "-" + DNI_LETTERS, re.compile(r"\b([0-9XYZ][0-9]{7}-?[A-Z])\b"), _whole(_dni)),
    Kind("steuer_id", 0.3, "123456789", re.compile(r"(?<![0-9])([1-9][0-9]{10})(?![0-9])"), _whole(_steuer_id)),
    Kind("imei", 0.3, "0123456789", re.compile(r"(?<![0-9])([0-9]{15})(?![0-9])"), _whole(luhn)),
    Kind("secret", 0.6, ":=", re.compile(r"(?i)\b(?:token|secret|password|passwd|api[_-]?key|access[_-]?key)\b[\"']?\s{0,4}[:=]\s{0,4}[\"']([^\"'\s]{8,})[\"']"), _whole(_entropy)),
)
#: Words that speak for a kind, in lower case, and against any.
CONTEXT = {
    "email": "mail email contact write correo courriel kontakt",
    "ip": "ip host server address login adresse servidor",
    "card": "card visa mastercard amex credit debit carte karte tarjeta payment",
    "phone": "phone tel call mobile fax telefon téléphone teléfono móvil handy",
    "iban": "iban account bank konto compte cuenta transfer",
    "ssn": "ssn social security",
    "nir": "sécurité sociale nir insee",
    "dni": "dni nif nie identidad",
    "steuer_id": "steuer steuernummer identifikationsnummer idnr",
    "imei": "imei device handset phone",
    "secret": "token secret password passwd key login",
}
COUNTER = frozenset("example sample dummy isbn issn version order invoice part serial beispiel exemple ejemplo".split())
PRIORS = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6} | {k.name: k.prior for k in MORE}
_CONTEXT = {kind: frozenset(words.split()) for kind, words in CONTEXT.items()}


def scored(text: str, kind: str, start: int, end: int) -> float:
    near = {w.lower() for w in _WORD.findall(text[max(0, start - BEFORE) : start])} | {w.lower() for w in _WORD.findall(text[end : end + AFTER])}
    return round(min(1.0, max(0.0, PRIORS[kind] + FOR * (not near.isdisjoint(_CONTEXT[kind])) - AGAINST * (not near.isdisjoint(COUNTER)))), 2)


def spans_of(text: str) -> list[tuple[str, int, int, float, bool]]:
    """(kind, start, end, score, base) in code points, by kind and start. A span of our own that meets one before it in this order is left out."""
    out = [(kind, start, end, scored(text, kind, start, end), True) for kind, find in _FOUND.items() for start, end in find(text)]
    for kind in MORE:
        if not any(c in text for c in kind.needs):
            continue
        taken = _merged(out)
        starts = [a for a, _ in taken]
        for found in kind.pattern.finditer(text):
            start, length = found.start(1), kind.confirmed(found.group(1))
            if length is None:
                continue
            k = bisect_left(starts, start + length)
            if (not k or taken[k - 1][1] <= start) and (score := scored(text, kind.name, start, start + length)) >= THRESHOLD:
                out.append((kind.name, start, start + length, score, False))
    return out


def _merged(spans: list[tuple]) -> list[tuple[int, int]]:
    """Places that the spans cover, in order and apart."""
    out: list[tuple[int, int]] = []
    for _, start, end, *_ in sorted(spans, key=lambda s: s[1]):
        if out and start < out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def find_pii(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans): spans is an array of SPAN, by kind as BASE and MORE list them and then by start; end is exclusive.

    Places are code points. Spans of BASE kinds may overlap those of another kind. Null and empty texts have no spans; null
    ids stay null; repeated rows are judged alike; very long texts take time linear in their length. An empty table gives
    no rows. Other columns, whatever their names, are ignored.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, offsets = [], [0]
            for text in batch["text"].to_pylist():
                found += spans_of(text)
                offsets.append(len(found))
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.bool_())
            names = ("kind", "start", "end", "score", "base")
            columns = zip(*found, strict=True) if found else ([] for _ in kinds)
            spans = pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), spans)], names=["doc_id", "spans"])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return source.mapInArrow(run, f"doc_id long, spans array<{SPAN}>")


def redact_pii(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """docs with each span of its text replaced by its kind in brackets; where spans overlap, by the first kind at the first place.

    A null text stays null; all other columns stay as they are.
    """
    ship(docs.sparkSession)

    def clean(text: str | None) -> str | None:
        spans = spans_of(text) if text else []
        kinds = {}
        for kind, start, *_ in spans:
            kinds.setdefault(start, kind)
        done, parts = 0, []
        for start, end in _merged(spans):
            parts += [text[done:start], f"[{kinds[start].upper()}]"]
            done = end
        return text if not spans else "".join([*parts, text[done:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            texts = pa.array([clean(t) for t in batch.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([texts if k == at else c for k, c in enumerate(batch.columns)], names=batch.schema.names)

    return docs.withColumn(text_col, F.col(text_col).cast("string")).mapInArrow(run, docs.withColumn(text_col, F.col(text_col).cast("string")).schema)


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def pii_digests(found: DataFrame) -> DataFrame:
    """Per row of find_pii: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_more, least_score (null without spans)."""
    base = F.filter("spans", lambda s: s["base"])
    count = lambda kind: F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", *(count(k) for k in BASE), F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda s: ~s["base"])).cast("long").alias("n_more"), F.array_min(F.transform("spans", lambda s: s["score"])).alias("least_score"),
    )
