"""Licence scans: Aho-Corasick over words for notice phrases, over raw text for identifier tags.

A text's words are joined by single spaces, so that one automaton pass finds every notice phrase as whole words, however
they were spaced or punctuated. A second automaton finds identifier tags. What follows a tag, and notices that "and" or "or"
joins, are licence expressions: a shunting-yard parser puts them in postfix order and they are evaluated: "and" needs both
sides permitted, "or" one of them, "with" joins an exception to the licences that it belongs to. An expression ends where
its grammar ends, at the latest at the next tag or at the end of the line, so that a pass is linear in the text. Texts are
independent of each other, so nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import ship

#: Notice phrases of the contract: phrase, label (fixed values).
BASE_PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: Notice phrases of our own: phrase, label. Of phrases inside each other the longest counts.
MORE_PHRASES = (
    ("lesser general public license", "lgpl"),
    ("library general public license", "lgpl"),
    ("affero general public license", "agpl"),
    ("gnu gpl", "gpl"),
    ("gnu lgpl", "lgpl"),
    ("gnu agpl", "agpl"),
    ("gnu free documentation license", "gfdl"),
    ("bsd license", "bsd"),
    ("bsd style license", "bsd"),
    ("2 clause bsd", "bsd"),
    ("3 clause bsd", "bsd"),
    ("isc license", "isc"),
    ("zlib license", "zlib"),
    ("python software foundation license", "psf"),
    ("unicode license", "unicode"),
    ("artistic license", "artistic"),
    ("mozilla public license", "mpl"),
    ("eclipse public license", "epl"),
    ("eclipse distribution license", "bsd"),
    ("common development and distribution license", "cddl"),
    ("european union public licence", "eupl"),
    ("open software license", "osl"),
    ("server side public license", "sspl"),
    ("business source license", "busl"),
    ("elastic license", "elastic"),
    ("boost software license", "boost"),
    ("sil open font license", "ofl"),
    ("open database license", "odbl"),
    ("released into the public domain", "public-domain"),
    ("dedicated to the public domain", "public-domain"),
    ("free and unencumbered software released into the public domain", "unlicense"),
    ("do what the fuck you want to public license", "wtfpl"),
    ("creative commons zero", "cc0"),
    ("creative commons attribution", "cc-by"),
    ("creative commons attribution sharealike", "cc-by-sa"),
    ("creative commons attribution share alike", "cc-by-sa"),
    ("creative commons attribution noncommercial", "cc-by-nc"),
    ("creative commons attribution non commercial", "cc-by-nc"),
    ("creative commons attribution noderivatives", "cc-by-nd"),
    ("creative commons attribution noncommercial sharealike", "cc-by-nc-sa"),
    ("creative commons attribution noncommercial noderivatives", "cc-by-nc-nd"),
    ("cc0", "cc0"),
    ("cc by", "cc-by"),
    ("cc by sa", "cc-by-sa"),
    ("cc by nc", "cc-by-nc"),
    ("cc by nd", "cc-by-nd"),
    ("cc by nc sa", "cc-by-nc-sa"),
    ("cc by nc nd", "cc-by-nc-nd"),
    ("all rights reserved", "proprietary"),
    ("permission is hereby granted free of charge", "mit"),
    ("permission to use copy modify and or distribute this software", "isc"),
    ("redistribution and use in source and binary forms", "bsd"),
)
#: What stands before a licence expression, in lower case.
TAGS = ("spdx-license-identifier:", "license-expression:")
#: Words between two notices that join them.
JOINTS = {"and": "and", "and the": "and", "and or": "or", "or": "or", "or the": "or", "or under the": "or", "or at your option the": "or"}
_V = r"-\d+(?:\.\d+)*"
_LATER = r"(?:\+|-only|-or-later)?"
_PORT = r"(?:-[a-z]{2,3})?"
#: Whole identifiers in lower case, as patterns: pattern, label. Any other identifier is labelled other.
IDENTIFIERS = (
    (r"mit(?:-0|-cmu|-modern-variant)?|x11|expat", "mit"),
    (rf"apache{_V}\+?", "apache"),
    (r"0bsd|bsd-[1-4]-clause(?:-clear|-patent|-views|-modification|-lbnl)?|bsd-source-code", "bsd"),
    (r"isc", "isc"),
    (r"zlib|zlib-acknowledgement", "zlib"),
    (rf"bsl{_V}", "boost"),
    (r"unlicense", "unlicense"),
    (r"wtfpl", "wtfpl"),
    (rf"psf{_V}|python{_V}|cnri-python", "psf"),
    (r"postgresql|ntp|curl|icu|libpng(?:-2\.0)?|ncsa|w3c|openssl", "permissive"),
    (r"unicode-3\.0|unicode-dfs-20\d\d|unicode-tou", "unicode"),
    (rf"artistic{_V}(?:-perl|-cl8)?", "artistic"),
    (rf"ms-pl|afl{_V}|blueoak{_V}|upl{_V}|ecl{_V}|mulanpsl{_V}", "permissive"),
    (rf"cc0{_V}|cc-pddc|pddl{_V}", "cc0"),
    (rf"cc-by{_V}{_PORT}", "cc-by"),
    (rf"cc-by-sa{_V}{_PORT}", "cc-by-sa"),
    (rf"cc-by-nc{_V}{_PORT}", "cc-by-nc"),
    (rf"cc-by-nc-sa{_V}{_PORT}", "cc-by-nc-sa"),
    (rf"cc-by-nc-nd{_V}{_PORT}", "cc-by-nc-nd"),
    (rf"cc-by-nd{_V}{_PORT}", "cc-by-nd"),
    (rf"gpl{_V}{_LATER}", "gpl"),
    (rf"lgpl{_V}{_LATER}", "lgpl"),
    (rf"agpl{_V}{_LATER}", "agpl"),
    (rf"gfdl{_V}(?:-no-invariants|-invariants)?{_LATER}", "gfdl"),
    (rf"mpl{_V}(?:\+|-no-copyleft-exception)?", "mpl"),
    (rf"epl{_V}", "epl"),
    (rf"cddl{_V}", "cddl"),
    (rf"eupl{_V}", "eupl"),
    (rf"osl{_V}", "osl"),
    (rf"ofl{_V}(?:-no-rfn|-rfn)?", "ofl"),
    (rf"odbl{_V}", "odbl"),
    (rf"sspl{_V}", "sspl"),
    (rf"busl{_V}", "busl"),
    (rf"elastic{_V}", "elastic"),
)
#: Labels that permit any use; no other label does.
PERMITTED = frozenset("mit apache bsd isc zlib boost unlicense wtfpl psf permissive unicode artistic cc0 cc-by public-domain".split())
#: Whole exceptions in lower case, as patterns, and the labels of licences that they belong to: such a licence is permitted with it.
EXCEPTIONS = (
    (rf"(?:classpath|gcc|font|bison|autoconf|libtool|openvpn-openssl){'(?:-[a-z]+)?'}-exception(?:{_V})?", frozenset(("gpl", "lgpl", "agpl"))),
    (r"llvm-exception|swift-exception", frozenset(("apache",))),
)
#: Strength of evidence: of a notice phrase, of a tag whose expression parses.
PHRASE_WEIGHT, TAG_WEIGHT = 0.6, 0.9

_IDENTIFIERS = tuple((re.compile(pattern), label) for pattern, label in IDENTIFIERS)
_EXCEPTIONS = tuple((re.compile(pattern), labels) for pattern, labels in EXCEPTIONS)
_PRECEDENCE = {"or": 1, "and": 2, "with": 3}
#: A parenthesis, a slash (an "or" of old), or a name, which ends in no full stop; white space may stand before it.
_TOKEN = re.compile(r"[ \t]*+([()/]|[A-Za-z0-9](?:[A-Za-z0-9.+:_-]*[A-Za-z0-9+])?)")
#: A name that could be a licence though it isn't known, after an operator: other words end the expression before it.
_NAME = re.compile(r".*[0-9]|licenseref-|documentref-")
_GAPS = re.compile(b"  +")
_LINE_END = re.compile(r"[\r\n]|\*/|-->")
_FOLD = bytes(32 if b < 0x30 or 0x3A <= b <= 0x40 or 0x5B <= b <= 0x60 or 0x7B <= b <= 0x7F else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, expressions string, permitted boolean"


def label_of(name: str) -> str:
    name = name.lower()
    return next((label for pattern, label in _IDENTIFIERS if pattern.fullmatch(name)), "other")


def expression_at(text: str, start: int, stop: int) -> tuple[list[str], int]:
    """The tokens of the longest licence expression that begins at start and ends by stop, and its end; none if there is no such.

    One pass: it ends at the first token that cannot follow, and gives the tokens up to the last place where all
    parentheses were closed and no operand was missing.
    """
    tokens, complete, end, depth, operand_next = [], 0, start, 0, True
    while start < stop and (found := _TOKEN.match(text, start, stop)):
        token = found.group(1)
        word = "or" if token == "/" else token.lower()
        if word == "(" or word not in _PRECEDENCE and word != ")":
            if not operand_next:
                break
            if word != "(" and tokens and tokens[-1] in ("and", "or", "/") and label_of(word) == "other" and not _NAME.match(word):
                break
        elif operand_next or word == ")" and not depth:
            break
        depth += (word == "(") - (word == ")")
        operand_next = word in _PRECEDENCE or word == "("
        tokens.append(word if word in _PRECEDENCE else token)
        start = found.end()
        if not operand_next and not depth:
            complete, end = len(tokens), start
    return tokens[:complete], end


def to_postfix(expression: str | list[str]) -> list[str] | None:
    """The expression, or its tokens, in postfix order (shunting-yard); None if it is malformed."""
    if isinstance(expression, str):
        text, (expression, _) = expression, expression_at(expression, 0, len(expression))
        if not expression or re.sub(r"\s", "", text).lower().replace("/", "or") != "".join(expression).lower():
            return None
    out, stack = [], []
    for token in expression:
        if token in _PRECEDENCE:
            while stack and stack[-1] != "(" and _PRECEDENCE[stack[-1]] >= _PRECEDENCE[token]:
                out.append(stack.pop())
            stack.append(token)
        elif token == "(":
            stack.append(token)
        elif token == ")":
            while stack[-1] != "(":
                out.append(stack.pop())
            stack.pop()
        else:
            out.append(token)
    return out + stack[::-1] or None


def evaluate(postfix: list[str]) -> tuple[bool, set[str]]:
    """Whether the expression is permitted, and the labels of its licences. A label after an equals sign stands for its licence."""
    stack: list[tuple[bool, set[str], str]] = []
    for token in postfix:
        if token in _PRECEDENCE:
            (b, right, name), (a, left, _) = stack.pop(), stack.pop()
            if token == "with":
                belongs = next((labels for pattern, labels in _EXCEPTIONS if pattern.fullmatch(name)), frozenset())
                stack.append((a or bool(left) and left <= belongs, left, ""))
            else:
                stack.append((a and b if token == "and" else a or b, left | right, ""))
        else:
            label = token[1:] if token[0] == "=" else label_of(token)
            stack.append((label in PERMITTED, {label}, token.lower()))
    ok, labels, _ = stack.pop()
    return ok, labels


class Scanner:
    """One worker's automata."""

    def __init__(self, base: tuple, more: tuple):
        import ahocorasick

        self.phrases, self.tags = ahocorasick.Automaton(), ahocorasick.Automaton()
        found: dict[str, tuple[list, set]] = {}
        for phrases, of_base in ((base, True), (more, False)):
            for phrase, label in phrases:
                labels = found.setdefault(phrase, ([], set()))
                (labels[0].append if of_base else labels[1].add)(label)
        for phrase, (base_labels, labels) in found.items():
            text = f" {phrase} ".encode().decode("latin-1")
            self.phrases.add_word(text, (len(text), tuple(base_labels), tuple(labels)))
        for tag in TAGS:
            self.tags.add_word(tag, len(tag))
        self.phrases.make_automaton()
        self.tags.make_automaton()

    def _phrases(self, raw: bytes) -> tuple[str, list[tuple[int, int, tuple, tuple]]]:
        """The text as words between single spaces, and (start, end, base labels, own labels) of the phrases in it."""
        line = _GAPS.sub(b" ", b" " + raw.translate(_FOLD) + b" ").decode("latin-1")  # no list of words, however long the text
        return line, [(end - length + 1, end, of_base, own) for end, (length, of_base, own) in self.phrases.iter(line)]

    def _tagged(self, raw: bytes) -> tuple[list[list[str]], bytes]:
        """The expressions after tags, in postfix order, and the text without them."""
        lower = raw.lower().decode("latin-1")
        tags = [(end - length + 1, end + 1) for end, length in self.tags.iter(lower)] if "license-" in lower else []
        found, rest, done, stop = [], [], 0, 0
        for k, (_, start) in enumerate(tags):
            if stop < start:  # tags on one line share its end
                stop = line_end.start() if (line_end := _LINE_END.search(lower, start)) else len(lower)
            tokens, end = expression_at(lower, start, min(stop, tags[k + 1][0]) if k + 1 < len(tags) else stop)
            if tokens:
                found.append(to_postfix(tokens))
                rest.append(raw[done:start])
                done = end
        return found, b"\n".join([*rest, raw[done:]])

    def scan(self, raw: bytes) -> tuple:
        line, found = self._phrases(raw)
        base_at, base_labels = [], set()
        at, word = 0, 0
        for start, _, of_base, _ in found:
            if of_base:  # matches come by their ends; a longer one may begin before the one counted last
                word = word + line.count(" ", at, start) if start >= at else word - line.count(" ", start, at)
                at = start
                base_at += [word] * len(of_base)
                base_labels.update(of_base)
        tagged, rest = self._tagged(raw)
        shown, found = self._phrases(rest) if tagged else (line, found)  # names in an expression are no notices
        notices, reach = [], -1
        for start, end, of_base, own in sorted(found, key=lambda x: (x[0], -x[1])):
            if end > reach:  # else it lies inside a longer one
                notices.append((start, end, sorted({*of_base, *own})))
                reach = end
        expressions = self._joined(shown, notices) + tagged
        values = [evaluate(e) for e in expressions]
        labels = base_labels.union(*(own for _, own in values))
        score = 1 - (1 - PHRASE_WEIGHT) ** min(len(notices), 50) * (1 - TAG_WEIGHT) ** min(len(tagged), 50)
        return (
            line.count(" ") - 1,
            len(base_at),
            min(base_at, default=None),
            max(base_at, default=None),
            ",".join(sorted(base_labels)),
            ",".join(sorted(labels)),
            score,
            "; ".join(" ".join(e) for e in expressions).replace("=", "") or None,
            all(ok for ok, _ in values) if values else None,
        )

    @staticmethod
    def _joined(line: str, notices: list[tuple[int, int, list[str]]]) -> list[list[str]]:
        """Postfix expressions of notices: those with a joint between them make one, every other is one of its own."""
        out: list[list[str]] = []
        before = None
        for start, end, names in notices:
            own = [t for name in names for t in ("and", f"={name}")][1:]
            joint = None
            if before is not None and start - before < 40:
                joint = JOINTS.get(line[before : start + 1].strip())
            if joint:
                out[-1] += [joint, *own]
            else:
                out.append(own)
            before = end
        return [to_postfix(tokens) for tokens in out]


def scan_licenses(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", base: tuple = BASE_PHRASES, more: tuple = MORE_PHRASES) -> DataFrame:
    """Per row: SCHEMA. Words are counted from 0; base_labels and labels are distinct, sorted and comma-joined.

    score: 0 without evidence, and nearer to 1 with each phrase or tag. Of phrases inside each other the longest counts, but
    for the base columns, in which each counts. expressions: those of notices, then those after tags, in postfix order; what
    follows a tag counts as far as it is an expression, however long, up to the next tag or the end of the line.
    permitted: whether every expression is; null without one. Identifiers and exceptions count as whole names only. Null
    and empty texts have no words, empty labels and score 0; null ids stay null; repeated rows are judged alike; very long
    texts take a few times their size. An empty table gives no rows. Other columns are ignored, whatever their names.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(base, more)
        for batch in batches:
            rows = [scanner.scan(t) for t in batch["text"].cast(pa.binary()).to_pylist()]
            columns = list(zip(*rows, strict=True)) if rows else [()] * 9
            types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.string(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=[x.split()[0] for x in SCHEMA.split(", ")])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return source.mapInArrow(run, SCHEMA)
