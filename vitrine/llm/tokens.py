"""Token ids of whole texts, for the Python tasks of packing and token output.

A byte-pair tokenizer never merges across pre-tokens, so a text is cut at white space, where no pre-token of either
vocabulary reaches across, and each distinct chunk is encoded once per worker. Chunks of Latin letters go straight to the
tokenizer's BPE model; all others go through the whole tokenizer. The ids equal those of one call over the whole text,
strings of special tokens included. Long texts are joined in portions of chunks, so that no list holds all of them.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Callable
from itertools import islice

#: Unicode white space, as the pre-tokenizers define it (fixed values).
_WS = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_LATIN = "A-Za-z\\xaa\\xb5\\xba\\xc0-\\xd6\\xd8-\\xf6\\xf8-\\xff"
_DIGIT = "0-9\\xb2\\xb3\\xb9\\xbc-\\xbe"
#: A run of Latin letters that ends at a space, full stop, comma or line end is a pre-token; so is such a mark after it.
_PLAIN = f"[{_LATIN}]+(?=[ .,\\n]|\\Z)|(?<=[{_LATIN}])[.,](?=[ \\n]|\\Z)"
_KEEPS_SPACE = re.compile(f" ?{_PLAIN}| ?[^{_WS}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+")
_DROPS_SPACE = re.compile(f"{_PLAIN}|[^{_WS}]+")
#: Chunks for which the vocabulary's own pattern is applied here: printable Latin-1 without an apostrophe.
_SIMPLE = re.compile(" ?[!-&(-~\\xa1-\\xff]+")
_RUNS = re.compile(f" ?[{_LATIN}]+| ?[{_DIGIT}]+| ?[^{_LATIN}{_DIGIT} ]+")
_PARTS = re.compile(f"[{_LATIN}]+|[{_DIGIT}]|[^{_LATIN}{_DIGIT}]+")
#: A worker holds this many chunks at most, unless told otherwise (150 bytes each); beyond it the memory is emptied and filled anew.
MEMO_CHUNKS = 600_000
#: Marks that are one pre-token behind a word, before white space or the end; with an apostrophe they may not be.
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: Characters that Python counts as white space and the pre-tokenizers don't.
_NO_GAPS = "\x1c\x1d\x1e\x1f"
#: Chunks of a long text that are joined at once, and the characters from which a text counts as long.
PORTION, LONG = 100_000, 1_000_000


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


class _Memo(dict):
    """Ids by chunk; those of a new chunk are made when they are asked for. A word and the marks behind it are two chunks' ids."""

    def __init__(self, encode: Callable[[str], bytes]):
        self.encode = encode

    def __missing__(self, chunk: str) -> bytes:
        word = chunk.rstrip(_MARKS)
        if len(word) < len(chunk) and word.isalpha() and (word.isascii() or max(word) <= "\xff"):
            ids = (self.get(word) or self.encode(word)) + self[chunk[len(word) :]]  # a word that only marks follow takes no room of its own
        else:
            ids = self.encode(chunk)
        self[chunk] = ids
        return ids


class TextEncoder:
    """ids(text): the text's ids as little-endian unsigned 32-bit integers.

    special_as_text: whether strings of special tokens in a text are ordinary text; if not, they are those tokens, as in a
    plain call of the tokenizer.
    """

    def __init__(self, path: str, special_as_text: bool = False, most: int = MEMO_CHUNKS):
        from tokenizers import Tokenizer

        self.most = most
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # texts are cut at special tokens before
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        added = spec["added_tokens"]
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] or not t["special"] for t in added):
            raise ValueError("added tokens that depend on what stands around them")
        self.special = {} if special_as_text else {t["content"]: array("I", [t["id"]]).tobytes() for t in added}
        self.cut = re.compile("(" + "|".join(re.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")")
        self.drops_space = spec.get("normalizer") is not None
        self.pattern = _DROPS_SPACE if self.drops_space else _KEEPS_SPACE
        letters = byte_letters()
        self.model, self.letters, self.memo = self.tokenizer.model, [letters[b] for b in range(256)], _Memo(self._encode)
        self.packed = [array("I", [k]).tobytes() for k in range(self.tokenizer.get_vocab_size())]

    def _encode(self, chunk: str) -> bytes:
        tokenize, packed, letters = self.model.tokenize, self.packed, self.letters
        word = chunk.removeprefix(" ")
        if word.isascii() and word.isalpha():  # letters stand for themselves
            return b"".join([packed[t.id] for t in tokenize(word.lower() if self.drops_space else chunk.replace(" ", letters[32]))])
        if word.isalpha() and max(word) <= "\xff":
            parts = [word.lower() if self.drops_space else chunk]
        elif _SIMPLE.fullmatch(chunk):
            parts = _PARTS.findall(chunk.lower()) if self.drops_space else _RUNS.findall(chunk)
        else:
            return array("I", self.tokenizer.encode(chunk, add_special_tokens=False).ids).tobytes()
        return b"".join([packed[t.id] for p in parts for t in tokenize("".join([letters[b] for b in p.encode()]))])

    def _plain(self, text: str) -> bytes:
        if len(self.memo) > self.most:
            self.memo.clear()
        if len(text) < LONG:
            by_gaps = self.drops_space and not any(c in text for c in _NO_GAPS)
            return b"".join(map(self.memo.__getitem__, text.split() if by_gaps else self.pattern.findall(text)))
        found, out = (m.group() for m in self.pattern.finditer(text)), []
        while part := list(islice(found, PORTION)):
            out.append(b"".join(map(self.memo.__getitem__, part)))
            if len(self.memo) > self.most:
                self.memo.clear()
        return b"".join(out)

    def ids(self, text: str) -> bytes:
        if not any(t in text for t in self.special):
            return self._plain(text)
        return b"".join(self.special[part] if k % 2 else self._plain(part) for k, part in enumerate(self.cut.split(text)))


_encoders: dict[tuple[str, bool, int], TextEncoder] = {}


def encoder(path: str, special_as_text: bool = False, most: int = MEMO_CHUNKS) -> Callable[[str], bytes]:
    """The worker's encoder for this file, with a memory of so many chunks at most; it outlives a task where workers are reused."""
    key = path, special_as_text, most
    if key not in _encoders:
        _encoders[key] = TextEncoder(*key)
    return _encoders[key].ids


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
