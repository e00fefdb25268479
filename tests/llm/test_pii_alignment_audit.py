"""Personal data, alignment of tokenizers and the audit of filters against brute force."""

import hashlib
import itertools
import random
import re
import subprocess
import sys
import time
from collections import Counter

import duckdb
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from vitrine.llm import alignment, filteraudit, pii
from vitrine.llm.tokens import byte_letters, public_path

ODD = "doc_id long, text string, lang string, spans string, words string, a string, part string"


def docs(spark, pairs, parts=3):
    return spark.createDataFrame([(*(p if len(p) == 3 else (*p, "en")), "x", "y", "z", "w") for p in pairs], ODD).repartition(parts)


# personal data

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_base(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text):
            digits = [int(c) for c in m.group() if c in "0123456789"]
            total = sum(d if k % 2 == 0 else sum(divmod(2 * d, 10)) for k, d in enumerate(reversed(digits)))
            good = {"email": True, "ip": kind == "ip" and all(int(p) < 256 for p in m.group().split(".")), "card": 12 < len(digits) < 20 and total % 10 == 0, "phone": 8 < len(digits) < 16}
            if good[kind]:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


PARTS = ["a", "b@", "@", "c.d", ".", "-", "+", "1", "4111 1111 1111 1111", "12", "255", "256", "007", " ", "(", ")", "é", "@x.y", "%", "_", "+49 30 1234567", "1.2.3.4"]


def test_base_spans_are_those_of_the_plain_patterns(spark):
    rng = random.Random(5)
    texts = [None, "", *("".join(rng.choices(PARTS, k=rng.randint(1, 40))) for _ in range(3000)), "a@b.c " * 30_000]
    got = pii.pii_digests(pii.find_pii(docs(spark, [*enumerate(texts), (3, "a@b.c")]))).collect()
    assert len(got) == len(texts) + 1
    for r in got:
        if r["doc_id"] == 3:
            continue
        base = brute_base(texts[r["doc_id"]] or "")
        assert r["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in BASE] == [sum(b.startswith(k) for b in base) for k in BASE]
        spans = r["spans"].split(",") if r["spans"] else []
        assert [s for s in spans if s.split(":")[0] in BASE] == base and len(spans) == len(base) + r["n_more"]


@pytest.mark.parametrize(
    ("text", "kind", "found"),
    [
        ("Konto DE89 3704 0044 0532 0130 00 AB", "iban", "DE89 3704 0044 0532 0130 00"),
        ("GB82WEST12345698765432.", "iban", "GB82WEST12345698765432"),
        ("GB82WEST12345698765433.", "iban", None),  # fails mod 97
        ("my ssn: 123-45-6789", "ssn", "123-45-6789"),
        ("666-45-6789", "ssn", None),
        ("order 123-45-6789", "ssn", None),  # a word against it
        ("DNI 12345678Z", "dni", "12345678Z"),
        ("DNI 12345678A", "dni", None),
        ("Steuernummer 86095742719", "steuer_id", "86095742719"),
        ("86095742719", "steuer_id", None),  # no word for it
        ('token = "f3ef4d6b2755a36d7d9c25bd72c4d5f67e061fda"', "secret", "f3ef4d6b2755a36d7d9c25bd72c4d5f67e061fda"),
        ('password: "aaaaaaaaaaaa"', "secret", None),
    ],
)
def test_more_kinds(text, kind, found):
    assert [text[a:b] for k, a, b, *_ in pii.spans_of(text) if k == kind] == ([found] if found else [])


def test_scores_follow_the_words_nearby():
    score = lambda text: pii.spans_of(text)[0][3]
    assert score("call +1 555 123 4567") > score("+1 555 123 4567") > score("version +1 555 123 4567")


@pytest.mark.parametrize("unit", ["a", "1", "1.", "1 ", "+1 ", "a@", "A", "AB12 ", "AB12A1 ", "token='", "a.b-"])
def test_a_very_long_text_takes_linear_time(unit):
    began = time.time()
    pii.spans_of(unit * (1_000_000 // len(unit)))
    assert time.time() - began < 15


def test_redaction_keeps_rows_and_columns(spark):
    rows = docs(spark, [(1, "write to a@b.example.com or +49 30 1234567."), (2, None), (3, ""), (3, "none")])
    got = {(r["doc_id"], r["text"]) for r in pii.redact_pii(rows).collect()}
    assert got == {(1, "write to [EMAIL] or [PHONE]."), (2, None), (3, ""), (3, "none")}
    assert pii.redact_pii(rows).columns == rows.columns and pii.find_pii(rows.limit(0)).count() == 0


# alignment


def brute_tokens(texts):
    """Per text the (id, start, end) of both tokenizers, by plain calls over whole texts."""
    a_model = Tokenizer.from_file(public_path("byte_bpe_50k.json"))
    a_model.encode_special_tokens = True
    b_model = sentencepiece.SentencePieceProcessor(model_file=public_path("piece_bpe_32k.model"))
    of_letter = {c: b for b, c in byte_letters().items()}
    out = []
    for text in texts:
        want = (" " + (text or "")).encode()
        a = [(k, bytes(of_letter[c] for c in a_model.id_to_token(k))) for k in a_model.encode(" " + (text or ""), add_special_tokens=False).ids]
        pieces = [(k, b_model.id_to_piece(k)) for k in b_model.encode(text or "")]
        b = [(k, bytes([int(p[3:5], 16)]) if re.fullmatch("<0x..>", p) else p.replace("▁", " ").encode()) for k, p in pieces]
        if not text or any(b"".join(x for _, x in side) != want for side in (a, b)):
            out.append(([], []))
            continue
        sides = []
        for side in (a, b):
            ends = list(itertools.accumulate(len(x) for _, x in side))
            sides.append([(k, e - len(x), e) for (k, x), e in zip(side, ends, strict=True)])
        out.append(tuple(sides))
    return out


def brute_align(texts):
    tokens = brute_tokens(texts)
    links = [[(i, j) for i, s, e in a for j, t, f in b if s < f and t < e] for a, b in tokens]
    counts = Counter(p for of in links for p in of)
    most = Counter()
    for (_, j), n in counts.items():
        most[j] = max(most[j], n)
    out = []
    for (a, b), of in zip(tokens, links, strict=True):
        groups, start = [], 0
        for end in sorted({e for *_, e in a} & {e for *_, e in b}):
            groups.append("|".join(",".join(str(k) for k, s, e in side if start <= s and e <= end) for side in (a, b)))
            start = end
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""
        out.append((len(a), len(b), len(groups), len(of), sum(counts[p] == most[p[1]] for p in of), sum(counts[p] for p in of), digest))
    return out


ALIGNED = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
PIECES = ["the", "Straße", " ", "  ", "\n", "\t", "naïve", "<|endoftext|>", "<s>", "</s>", "<0x41>", "▁", "日本語", "🎉", "don't", "1234", "...", "é", " ", " ", "\x00", "x" * 30, "http://a.b/c?d=1", "ing", "pre"]


def test_alignment(spark):
    rng = random.Random(9)
    texts = [None, "", " ", "a", "a b c", "the same text again", "the same text again", "▁", "a  b ", " lead", "tab\tnew\n line"]
    texts += ["".join(rng.choices(PIECES, k=rng.randint(1, 30))) for _ in range(250)] + [" ".join(rng.choices(PIECES[:1] + PIECES[6:7] + PIECES[12:], k=40)) for _ in range(150)]
    got = {r["doc_id"]: tuple(r[c] for c in ALIGNED) for r in alignment.align(docs(spark, list(enumerate(texts))), public_path("byte_bpe_50k.json"), public_path("piece_bpe_32k.model")).collect()}
    assert len(got) == len(texts)
    for k, want in enumerate(brute_align(texts)):
        assert got[k] == want, texts[k]


def test_rare_pairs_by_a_shuffle_and_small_pages(spark, monkeypatch):
    rng = random.Random(2)
    words = ["alpha", "beta", "gamma", "naïveté", "Überraschung", "tokenizers"]
    rows = docs(spark, [(k, " ".join(rng.choices(words, k=30))) for k in range(60)])
    paths = public_path("byte_bpe_50k.json"), public_path("piece_bpe_32k.model")
    want = sorted(alignment.align(rows, *paths).collect())
    links = alignment.aligned(alignment.tokenise(rows, *paths)).select(F.col("doc_id").alias("row"), "links")
    pairs = alignment.pair_counts(links)
    assert sorted(alignment.link_sums(links, pairs, most=3).collect()) == sorted((r["doc_id"], r["n_best"], r["count_sum"]) for r in want)
    assert alignment.align(rows.limit(0), *paths).count() == 0


def test_alignment_of_a_very_long_text(spark):
    text = " ".join(f"word{k % 977}" for k in range(1_000_000))
    got = alignment.aligned(alignment.tokenise(docs(spark, [(1, text), (2, " " * 200_000)]), public_path("byte_bpe_50k.json"), public_path("piece_bpe_32k.model")))
    rows = {r["doc_id"]: r for r in got.select("doc_id", "n_a", "n_b", "n_groups", F.size("links").alias("n")).collect()}
    assert all(r["n"] == r["n_a"] + r["n_b"] - r["n_groups"] for r in rows.values()) and rows[1]["n_a"] > 2_000_000


# audit


def brute_audit(rows, labels):
    good, toxic = ({k for k, *flags in labels if flags[at] == 1} for at in (0, 1))
    least = {}
    for k, t, _ in rows:
        k = -(2**63) if k is None else k
        least[t or ""] = min(least.get(t or "", k), k)
    failed = []
    for k, t, lang in rows:
        t = t or ""
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", t) if w]
        tests = (len(words) < 100, 100 * len(set(words)) < 80 * len(words), 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), bool(re.search(r"[#$%&*|]", t)), k is not None and k > least[t])
        failed.append((lang or "", {f for f, bad in zip("ABCDE", tests, strict=True) if bad}, k is not None and k in good, k is not None and k in toxic))
    out = {}
    for part in {p for p, *_ in failed}:
        own = [r[1:] for r in failed if r[0] == part]
        for order in itertools.permutations("ABCDE"):
            gone = set()
            for step, f in enumerate(order, 1):
                here = [r for r in own if f in r[0] and not r[0] & gone]
                gone.add(f)
                fails = sum(f in r[0] for r in own)
                out[part, "".join(order), step] = [sum(not r[0] & gone for r in own), len(here), fails - len(here), sum(r[0] == {f} for r in own), sum(r[1] for r in here), sum(r[2] for r in here)]
    for (part, order, step), row in out.items():
        f = order[step - 1]
        row.append(sum(r[1] for (p, o, s), r in out.items() if p == part and o[s - 1] == f))
    return {key: tuple(row) for key, row in out.items()}


def test_audit(spark):
    rng = random.Random(4)
    words = ["alpha", "Beta", "GAMMA", "dé", "#x", "a|b", "ÉÀ"]
    texts = [None, "", "A", "ÀÉ", *(" ".join(rng.choices(words, k=rng.randint(1, 6))) for _ in range(20)), " ".join(f"w{k}" for k in range(150)), " ".join(f"w{k % 60}" for k in range(150)), "x " * 300_000]
    rows = [(k % 37 if k % 11 else None, rng.choice(texts), rng.choice(["en", "de", None])) for k in range(200)]
    labels = [(k, rng.randint(0, 1), rng.randint(0, 1)) for k in range(0, 60, 2)] + [(4, 1, None), (None, 1, 1)]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {(r["part"], r["filter_order"], r["step"]): tuple(r)[3:] for r in filteraudit.filter_audit(docs(spark, rows), table).collect()}
    assert got == brute_audit(rows, labels)
    assert filteraudit.filter_audit(docs(spark, rows).limit(0), table).count() == 0


def test_audit_equals_its_sql(spark, data):
    from vitrine.llm import QUERIES

    connection = duckdb.connect()
    for name in ("documents", "labels"):
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM '{data}/{name}.parquet'")
    want = connection.sql(filteraudit.ORACLE).df()
    got = QUERIES["op13_filter_audit"](spark, data).toPandas()[list(want.columns)]
    assert sorted(got.itertuples(index=False, name=None)) == sorted(want.itertuples(index=False, name=None))


@pytest.mark.parametrize("n", range(1, 7))
def test_neighbour_swaps_visit_every_order_once(n):
    order = list(range(n))
    seen = [tuple(order)]
    for k in filteraudit.neighbour_swaps(n):
        order[k], order[k + 1] = order[k + 1], order[k]
        seen.append(tuple(order))
    assert sorted(seen) == sorted(itertools.permutations(range(n)))


def test_tokenizers_are_loaded_once_a_worker():
    """A second task of a worker finds them loaded, with an empty memory of words, and gives the same codes."""
    paths = public_path("byte_bpe_50k.json"), public_path("piece_bpe_32k.model")
    first = alignment.both_of(*paths)
    codes = first.codes(["hello", "wörld", "x1"])
    assert first.memo
    again = alignment.both_of(*paths)
    assert again is first and not again.memo and again.codes(["hello", "wörld", "x1"]) == codes


def test_pages_keep_words_in_arrays():
    """A page's words are encoded together without one of them being remembered; odd ones among them have the ids of plain calls."""
    both = alignment.both_of(public_path("byte_bpe_50k.json"), public_path("piece_bpe_32k.model"))
    texts = ["hello wörld x1 hello", "a  b c", "x" * 300 + " hello y", "bad \x85 x", "", "naïveté, don't"]
    page = alignment.Page(both)
    for k, text in enumerate(texts):
        page.add(k, text)
    (docs,), (words,) = page.batch().to_pydict().values()
    assert not both.memo
    for d, text, (a, b) in zip(docs, texts, brute_tokens(texts), strict=True):
        got = [[k for w in d["words"] for k in words[w][side]] for side in "ab"]
        assert got == [[k for k, *_ in a], [k for k, *_ in b]] and (d["n_a"], d["n_b"]) == (len(a), len(b)), text


def test_groups_and_links_of_a_page(spark):
    """Groups as text and links in order, by plain calls, with texts that have none; Spark's part has no lambda, which would be interpreted entry by entry."""
    paths = public_path("byte_bpe_50k.json"), public_path("piece_bpe_32k.model")
    texts = ["", "naïveté, don't", "a  b 日本語🎉", "bad \x85 x", "tokenizers tokenizers Überraschung", None]
    rows = alignment.aligned(alignment.tokenise(docs(spark, list(enumerate(texts))), *paths))
    assert "lambda" not in rows._jdf.queryExecution().optimizedPlan().toString()
    got = {r["doc_id"]: r for r in rows.collect()}
    for k, (a, b) in enumerate(brute_tokens(texts)):
        groups, start = [], 0
        for end in sorted({e for *_, e in a} & {e for *_, e in b}):
            groups.append("|".join(",".join(str(i) for i, s, e in side if start <= s and e <= end) for side in (a, b)))
            start = end
        links = [(i << 32) + j for i, s, e in a for j, t, f in b if s < f and t < e]
        assert (got[k]["groups"], got[k]["links"], got[k]["n_groups"]) == (";".join(groups), links, len(groups)), texts[k]
    page = alignment.Page(alignment.both_of(*paths))
    page.add(1, "")
    assert alignment.align_page(page.batch()).to_pylist() == [{"doc_id": 1, "n_a": 0, "n_b": 0, "groups": "", "links": []}]


def test_a_worker_needs_little_memory_beside_its_tokenizers():
    """Six million characters of texts, most of whose words differ, take a worker to 150 MB more than loading did at most; none of them are lost."""
    code = """
import random, re
from vitrine.llm import alignment
from vitrine.llm.tokens import public_path

most = lambda: int(re.search("VmHWM: *(.*) kB", open("/proc/self/status").read().replace("\\t", " "))[1]) // 1024
both, rng = alignment.both_of(public_path("byte_bpe_50k.json"), public_path("piece_bpe_32k.model")), random.Random(6)
syllables = ["ka", "lor", "mi", "ten", "su", "ver", "pon", "di"]
texts = ((k, " ".join("".join(rng.choices(syllables, k=3)) + str(rng.randrange(900)) for _ in range(200))) for k in range(3000))
before, rows = most(), 0
for page in map(alignment.align_page, alignment.pages(both, texts)):
    rows += len(page)
print(rows, most() - before)
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=alignment.__file__.rsplit("/", 3)[0])
    rows, more = map(int, out.stdout.split())
    assert rows == 3000 and more < 150, out.stdout


def test_pages_of_any_size_give_the_same(monkeypatch):
    rng, both = random.Random(3), alignment.both_of(public_path("byte_bpe_50k.json"), public_path("piece_bpe_32k.model"))
    texts = [(k, "".join(rng.choices(PIECES, k=rng.randint(0, 30)))) for k in range(200)] + [(None, "a b"), (7, "bad \x85 x")]
    found = []
    for size in (1, 2_000, 1_000_000):
        monkeypatch.setattr(alignment, "PAGE", size)
        found.append([row for page in map(alignment.align_page, alignment.pages(both, texts)) for row in page.to_pylist()])
    assert found[0] == found[1] == found[2] and [r["doc_id"] for r in found[0]] == [k for k, _ in texts]
