"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes of a text.

Python tasks work on pages: the ids and byte ends, by both tokenizers, of each distinct word of about a megabyte of text, and
each text as its words' numbers in the page. Both tokenizers end at a lone space, so that a text's groups and links are those
of its words. A page's ends are merged in arrays: each distinct end closes the overlap of one token of A with one of B, which
is a link, and an end that both have closes a group besides. Texts then take their words' links and groups. A text has as many
groups as tokens less links.

Links are counted over the corpus by pair of ids. To hand the counts back to texts, the most frequent pairs, of which a fixed
number is broadcast, meet the links where they are; links of rare pairs, none of which is hot, are joined by a shuffle.
"""

from __future__ import annotations

import re
from array import array
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from functools import cache
from itertools import chain, count, islice, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import materialize, ship
from .tokens import TextEncoder, byte_letters, encoder

#: Pairs of ids that are broadcast at most (some 40 bytes each); the rest meet their links by a shuffle.
MOST_PAIRS = 1_000_000
#: Words whose ids a worker remembers at most, characters of a long text that are cut into words at once, words encoded in one call.
MEMO_WORDS, PORTION, TOGETHER = 500_000, 2_000_000, 10_000
#: A page ends with the text that takes it to so many characters or to so many distinct words, which take most of a worker's memory.
PAGE, PAGE_WORDS = 1_000_000, 50_000
_ODD_SPACE = re.compile(r"[^\S \n]")
_RUNS = re.compile(" +[^ ]*")
_ID_BITS = 32
TOKENS = "doc_id long, n_a long, n_b long, groups string, links array<long>"


class Pieces:
    """A sentencepiece model over runs of one or more spaces and the characters after them.

    No piece of the vocabulary has a space after another character, so that no merge reaches across a run's beginning;
    where a vocabulary has such pieces, whole texts are encoded at once.
    """

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(k) for k in range(self.model.get_piece_size())]
        self.bytes = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in names]
        self.whole = any(re.search("[^▁]▁", p) for p in names)
        self.space = self.model.piece_to_id("▁")

    def many(self, runs: list[str]) -> list[list[int]]:
        """Ids of each run, given without its first space, which the model adds. It adds none to nothing: that is a space alone."""
        return [ids or [self.space] for ids in self.model.encode(runs, num_threads=1)]

    def ids(self, text: str) -> bytes:
        if self.whole:
            return array("i", self.model.encode(text)).tobytes()
        found, out = (m.group()[1:] for m in _RUNS.finditer(" " + text)), []
        while part := list(islice(found, 100_000)):
            out += [array("i", ids).tobytes() for ids in self.many(part)]
        return b"".join(out)


def _by_rank(spec: dict, vocabulary: dict[str, int], entries: list[bytes]) -> Callable[[str], list[int]] | None:
    """A faster library's encoder with the same vocabulary, if ids follow the order of merges and the pre-tokenizer is the usual one."""
    import public_tokenizers
    import tiktoken

    before = spec["pre_tokenizer"] or {}
    merged = [vocabulary.get("".join(m if isinstance(m, list) else m.split(" ", 1)), -1) for m in spec["model"]["merges"]]
    usual = before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True) and spec.get("normalizer") is None
    special = {t["id"] for t in spec["added_tokens"]}
    if not usual or spec["model"].get("ignore_merges") or merged != sorted(set(merged)) or len(merged) + 256 != len(set(vocabulary.values()) - special):
        return None
    ranks = {entries[k]: k for k in vocabulary.values() if k not in special}
    return tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def joined_sides(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Ids and numbers of ids by word, of words one part after the other."""
    return np.concatenate([np.array([], np.int32), *(ids for ids, _ in parts)]), np.concatenate([np.array([], np.int64), *(n for _, n in parts)])


class Both:
    """One worker's tokenizers. code(word): A's ids, then B's as their complements, of a space and the word, as 32-bit integers."""

    def __init__(self, a_path: str, b_path: str):
        import json

        self.encoder: TextEncoder = encoder(a_path, special_as_text=True).__self__
        self.pieces, self.memo = Pieces(b_path), {}
        of_letter = {letter: b for b, letter in byte_letters().items()}
        with open(a_path, encoding="utf-8") as f:
            spec = json.load(f)
        vocabulary = spec["model"]["vocab"]
        self.a_bytes = [b""] * (1 + max(vocabulary.values()))
        for entry, k in vocabulary.items():
            self.a_bytes[k] = bytes(of_letter.get(c, 0) for c in entry)
        by_rank = _by_rank(spec, vocabulary, self.a_bytes)
        self.lossless = by_rank is not None  # it merges the bytes of what its pattern finds, so that nothing else than a gap can be lost
        self.of_many = by_rank or (lambda text: self.encoder.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids)
        self.begins = np.array([x.startswith(b" ") for x in self.a_bytes])
        self.a_lengths, self.b_lengths = (np.array([len(x) for x in table], np.int64) for table in (self.a_bytes, self.pieces.bytes))

    def _code(self, text: str, a: bytes, b: bytes) -> bytes:
        """Nothing for a text whose tokens don't give back its bytes."""
        a, b, want = array("i", a), array("i", b), (" " + text).encode()
        same = b"".join(map(self.a_bytes.__getitem__, a)) == want and b"".join(map(self.pieces.bytes.__getitem__, b)) == want
        return (a + array("i", [~k for k in b])).tobytes() if same else b""

    def code(self, text: str) -> bytes:
        return self._code(text, self.encoder.ids(" " + text), self.pieces.ids(text))

    def codes(self, words: list[str]) -> list[bytes]:
        """code of each word; new ones are encoded together. Long ones, and those with a space in them, are not remembered."""
        out = [self.memo.get(w) for w in words]
        missing = [k for k, code in enumerate(out) if code is None]
        plain = [w for w in map(words.__getitem__, missing) if len(w) <= 100 and " " not in w]
        if len(self.memo) + len(plain) > MEMO_WORDS:
            self.memo.clear()
        for k in range(0, len(plain), TOGETHER):
            self._learn(plain[k : k + TOGETHER])
        for k in missing:
            code = self.memo.get(words[k])
            out[k] = self.code(words[k]) if code is None else code
        return out

    def sides(self, words: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For A and for B the ids of all words, one after the other, and each word's number of them, none for a word without a code.

        A page's words differ and most of them are in no other page, so that none is remembered: those without a space in
        them and not too long are encoded together and stay in arrays.
        """
        found, start = ([], []), 0
        odd = [k for k, w in enumerate(words) if len(w) > 100 or " " in w]
        for stop in [*odd, len(words)]:
            for k in range(start, stop, TOGETHER):
                portion = words[k : min(k + TOGETHER, stop)]
                for out, side in zip(found, self._together(portion) or self._apart(self.codes(portion)), strict=True):
                    out.append(side)
            if stop < len(words):
                for out, side in zip(found, self._apart([self.code(words[stop])]), strict=True):
                    out.append(side)
            start = stop + 1
        return [joined_sides(out) for out in found]

    @staticmethod
    def _apart(codes: list[bytes]) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
        stream = np.frombuffer(b"".join(codes), np.int32)
        of_word = np.repeat(np.arange(len(codes)), [len(c) // 4 for c in codes])
        a = stream >= 0
        return (stream[a], np.bincount(of_word[a], minlength=len(codes))), (~stream[~a], np.bincount(of_word[~a], minlength=len(codes)))

    def _together(self, words: list[str]) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]] | None:
        """One call of each tokenizer; nothing where the tokens don't give back the words. Of A's tokens those that begin with a space begin a word."""
        joined = " " + " ".join(words)
        a = np.array(self.of_many(joined), np.int32)
        b_lists = self.pieces.many(words)
        b = np.fromiter(chain.from_iterable(b_lists), np.int32)
        want = joined.encode()
        same = lambda table, ids: b"".join(map(table.__getitem__, ids.tolist())) == want
        if int(self.a_lengths[a].sum()) != len(want) or not (self.lossless or same(self.a_bytes, a)) or not same(self.pieces.bytes, b):
            return None
        firsts = np.flatnonzero(self.begins[a])
        return (a, np.diff(firsts, append=len(a))), (b, np.fromiter(map(len, b_lists), np.int64, len(words)))

    def _learn(self, words: list[str]) -> None:
        both = self._together(words)
        if both is None:
            for word in words:
                self.memo[word] = self.code(word)
            return
        (a, n_a), (b, n_b) = both
        a_edges, b_edges = ([0, *np.cumsum(n).tolist()] for n in (n_a, n_b))
        for k, word in enumerate(words):
            self.memo[word] = a[a_edges[k] : a_edges[k + 1]].tobytes() + (~b[b_edges[k] : b_edges[k + 1]]).tobytes()

    def words(self, text: str) -> Iterator[list[str]]:
        """The words between spaces, a bounded number at a time; a text with a space beside white space is one word."""
        if self.pieces.whole or _ODD_SPACE.search(text) or text[0].isspace() or text[-1].isspace() or "  " in text or " \n" in text or "\n " in text:
            yield [text]
            return
        start = 0
        while (cut := text.find(" ", start + PORTION)) >= 0:
            yield text[start:cut].split(" ")
            start = cut + 1
        yield text[start:].split(" ")


_loaded: dict[tuple[str, str], Both] = {}


def both_of(a_path: str, b_path: str) -> Both:
    """The worker's tokenizers for these files, with an empty memory of words; they outlive a task where workers are reused."""
    if (a_path, b_path) not in _loaded:
        _loaded[a_path, b_path] = Both(a_path, b_path)
    _loaded[a_path, b_path].memo.clear()
    return _loaded[a_path, b_path]


class Page:
    """Texts as numbers of words, and the distinct words in order of their numbers."""

    def __init__(self, both: Both):
        self.both, self.number = both, defaultdict(count().__next__)
        self.ids, self.docs, self.texts, self.size = [], [], [], 0

    def add(self, doc_id: int | None, text: str) -> None:
        number = self.number
        parts = [np.array([number[w] for w in part], np.int32) for part in self.both.words(text)] if text else [np.array([], np.int32)]
        self.ids.append(doc_id)
        self.docs.append(np.concatenate(parts))
        self.texts.append(text)
        self.size += len(text) + 100

    def batch(self) -> pa.RecordBatch:
        both = self.both
        found = both.sides(list(self.number))
        bad = found[0][1] == 0
        if bad.any():  # the tokens of a whole text may give back its bytes though those of a word don't
            wholes = []
            for k, (text, numbers) in enumerate(zip(self.texts, self.docs, strict=True)):
                if len(numbers) and bad[numbers].any():
                    whole = both.code(text) if len(numbers) > 1 else b""
                    self.docs[k] = np.array([len(bad) + len(wholes)] if whole else [], np.int32)
                    wholes += [whole] if whole else []
            found = [joined_sides([side, more]) for side, more in zip(found, both._apart(wholes), strict=True)]
        sides, sizes = [], []
        for (ids, per_word), table in zip(found, (both.a_lengths, both.b_lengths), strict=True):
            upto = np.concatenate([[0], np.cumsum(per_word)])
            sums = np.concatenate([[0], np.cumsum(table[ids])])
            ends = sums[1:] - np.repeat(sums[upto[:-1]], per_word)
            sides += [pa.ListArray.from_arrays(pa.array(upto, pa.int32()), pa.array(x, pa.int32())) for x in (ids, ends)]
            sizes.append(per_word)
        n = [pa.array([int(s[d].sum()) for d in self.docs], pa.int64()) for s in sizes]
        offsets = pa.array(np.concatenate([[0], np.cumsum([len(d) for d in self.docs])]), pa.int32())
        numbers = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(self.docs), pa.int32()))
        docs = pa.StructArray.from_arrays([pa.array(self.ids, pa.int64()), *n, numbers], ["doc_id", "n_a", "n_b", "words"])
        words = pa.StructArray.from_arrays(sides, ["a", "a_ends", "b", "b_ends"])
        one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
        return pa.RecordBatch.from_arrays([one(docs), one(words)], names=["docs", "words"])


@cache
def _shown(most: int, mark: str) -> np.ndarray:
    """Each id below most in decimal with the mark behind it, as eight bytes with zeros at the end."""
    if most > 10**7:
        raise ValueError("ids of more than seven digits")
    return np.array([f"{k}{mark}" for k in range(most)], "S8").view(np.uint64)


@cache
def _size(most: int) -> np.ndarray:
    """How many bytes of these each takes."""
    return np.array([len(str(k)) + 1 for k in range(most)], np.int64)


def _texts_of_words(a: np.ndarray, b: np.ndarray, last_a: np.ndarray, last_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The groups' text, each group with a semicolon behind it, and how many bytes of it each token of A and of B takes.

    last_a, last_b: the places of the tokens that close the groups. In the text a group's tokens of B follow those of A.
    """
    begins_a, begins_b = (np.append(0, last + 1)[:-1] for last in (last_a, last_b))
    places = np.arange(len(a)) + np.repeat(begins_b, last_a + 1 - begins_a), np.arange(len(b)) + np.repeat(last_a + 1, last_b + 1 - begins_b)
    shown, sizes = np.empty(len(a) + len(b), np.uint64), []
    for ids, last, place, mark in zip((a, b), (last_a, last_b), places, "|;", strict=True):
        most = 1 << int(ids.max(initial=0)).bit_length()
        shown[place] = _shown(most, ",")[ids]
        shown[place[last]] = _shown(most, mark)[ids[last]]
        sizes.append(_size(most)[ids])
    letters = shown.view(np.uint8)
    return letters[letters != 0], *sizes


def _edges(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes)])


def align_page(page: pa.RecordBatch) -> pa.RecordBatch:
    """TOKENS of a page's texts."""
    docs, words = (page[c].flatten() for c in ("docs", "words"))
    of_word = np.arange(len(words) + 1) << _ID_BITS
    (a, a_upto), (b, b_upto) = ((words.field(c).values.to_numpy(), words.field(c).offsets.to_numpy()) for c in "ab")
    # an end as its word's number above and the byte offset in it below, so that all of a page are in ascending order
    a_ends, b_ends = (np.repeat(of_word[:-1], np.diff(upto)) + words.field(c).values.to_numpy() for c, upto in (("a_ends", a_upto), ("b_ends", b_upto)))
    ends = np.sort(np.concatenate([a_ends, b_ends]), kind="stable")
    ends = ends[np.diff(ends, prepend=-1) > 0]
    i, j = np.searchsorted(a_ends, ends), np.searchsorted(b_ends, ends)  # the tokens whose overlap it closes
    links = pa.LargeListArray.from_arrays(np.searchsorted(ends, of_word), a[i].astype(np.int64) << _ID_BITS | b[j])
    both = a_ends[i] == b_ends[j]
    text, *sizes = _texts_of_words(a, b, i[both], j[both])
    upto = sum(_edges(size)[edges] for size, edges in zip(sizes, (a_upto, b_upto), strict=True))
    texts = pa.Array.from_buffers(pa.large_binary(), len(words), [None, pa.py_buffer(upto), pa.py_buffer(text)])

    found, starts = docs.field("words").values, docs.field("words").offsets.to_numpy()
    links, texts = links.take(found), texts.take(found)
    edges = _edges(pc.binary_length(texts).to_numpy())[starts].tolist()
    whole = memoryview(texts.buffers()[2] or b"")
    groups = pa.array([bytes(whole[x : max(x, y - 1)]) for x, y in pairwise(edges)], pa.string())  # without the last semicolon
    of_docs = pa.ListArray.from_arrays(pa.array(links.offsets.to_numpy()[starts], pa.int32()), links.values)
    return pa.RecordBatch.from_arrays([*map(docs.field, ("doc_id", "n_a", "n_b")), groups, of_docs], names=["doc_id", "n_a", "n_b", "groups", "links"])


def pages(both: Both, texts: Iterable[tuple[int | None, str]]) -> Iterator[pa.RecordBatch]:
    """Pages of (doc_id, text), one at a time: of a page only its arrays are left when it is given."""
    page = Page(both)
    for doc_id, text in texts:
        page.add(doc_id, text)
        if page.size >= PAGE or len(page.number) >= PAGE_WORDS:
            full, page = page.batch(), Page(both)
            yield full
            del full
    if page.ids:
        yield page.batch()


def tokenise(docs: DataFrame, a_path: str, b_path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """TOKENS of texts: how many A and B find, groups as text, links as pairs of ids in one long, A's above.

    None for a null or empty text and for one whose tokens don't give back its bytes.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = both_of(a_path, b_path)
        texts = ((doc_id, text.as_py()) for batch in batches for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True))
        yield from map(align_page, pages(both, texts))
        both.memo.clear()

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return source.mapInArrow(run, TOKENS)


def aligned(tokens: DataFrame) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, groups, links) of TOKENS."""
    n_groups = F.col("n_a") + F.col("n_b") - F.size("links")  # each end but those of groups closes one token, those close two, and each closes a link
    return tokens.select("doc_id", "n_a", "n_b", n_groups.alias("n_groups"), "groups", "links")


def pair_counts(links: DataFrame) -> DataFrame:
    """(pair, n, best) of rows with links: how often each pair is linked, and whether no pair of its B id is linked more often."""
    counted = materialize(links.select(F.explode("links").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n")), "pairs")
    b = F.col("pair").bitwiseAND(F.lit((1 << _ID_BITS) - 1))
    most = counted.groupBy(b.alias("b")).agg(F.max("n").alias("most"))  # a row for each id of B's vocabulary at most
    return counted.join(F.broadcast(most), b == F.col("b")).select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def _frequent(pairs: DataFrame, most: int) -> int:
    """The least power of two so that at most so many pairs are linked that often."""
    sizes = {r["power"]: r["n"] for r in pairs.groupBy(F.floor(F.log2("n")).alias("power")).agg(F.count(F.lit(1)).alias("n")).collect()}  # at most 63
    total, power = 0, 63
    while power > 0 and total + sizes.get(power - 1, 0) <= most:
        power -= 1
        total += sizes.get(power, 0)
    return 1 << power if power else 0


def link_sums(links: DataFrame, pairs: DataFrame, most: int = MOST_PAIRS) -> DataFrame:
    """(row, n_best, count_sum) of (row, links): how many of a row's links are best, and the sum of their counts."""
    each = links.select("row", F.explode("links").alias("pair"))
    cut = _frequent(pairs, most)
    summed = lambda df: df.groupBy("row").agg(F.sum(F.col("best").cast("long")).alias("n_best"), F.sum("n").alias("count_sum"))
    frequent = F.broadcast(pairs.filter(F.col("n") >= cut))
    out = summed(each.join(frequent, "pair"))
    if cut:
        rare = each.join(frequent, "pair", "left_anti").join(pairs.filter(F.col("n") < cut).hint("shuffle_hash"), "pair")
        out = out.unionByName(summed(rare)).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return out


def align(docs: DataFrame, a_path: str, b_path: str, **columns: str) -> DataFrame:
    """Per row: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 (of the groups as text).

    A null or empty text, and one whose tokens don't give back its bytes, has zeros and an empty digest. Null ids stay null;
    repeated rows give repeated results, and their links count as often; very long texts are cut into words, or are one word
    where a space stands beside other white space. An empty table gives no rows. Other columns, whatever their names, are
    ignored.
    """
    rows = aligned(tokenise(docs, a_path, b_path, **columns))
    digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("")
    rows = rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "n_a", "n_b", "n_groups", F.size("links").cast("long").alias("n_links"), digest.alias("groups_sha256"), "links")
    found = materialize(rows, "links")
    sums = link_sums(found.select("row", "links"), materialize(pair_counts(found), "counts"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    return found.drop("links").join(sums, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")
