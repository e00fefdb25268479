"""Winnowing, licence scans, URL filters and the quality classifier against brute force."""

import hashlib
import math
import random
import re
import time
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from vitrine.llm import fingerprints, licenses, quality, urlfilter

ODD = "doc_id long, text string, bucket string, n_chars string, source string, page_id string, host string, url string"


def docs(spark, pairs, parts=3):
    return spark.createDataFrame([(k, t, "a", "b", "c", "d", "e", "f") for k, t in pairs], ODD).repartition(parts)


TEXTS = ["", None, "one", "two words", "a b c", "The  quick\tbrown fox. The quick brown fox. The quick brown fox.", " lead and trail ", "é ü ß " * 40, "same " * 500, "x" * 20_000, "same " * 500, " ".join(str(k * 7919 % 10007) for k in range(15_000))]



def turn(x, n):
    return (x << n | x >> (64 - n)) & (2**64 - 1)


def brute_winnow(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", (text or "").lower()) if w]
    hashes = [xxhash.xxh64_intdigest(w.encode(), 42) for w in words]
    if not words:
        return []
    if len(words) < 3:
        chained = 42
        for w in words:
            chained = xxhash.xxh64_intdigest(w.encode(), chained)
        grams = [chained]
    else:
        grams = [turn(hashes[k], 2) ^ turn(hashes[k + 1], 1) ^ hashes[k + 2] for k in range(len(words) - 2)]
    signed = lambda g: (g & ((1 << 34) - 1)) - ((g & (1 << 33)) << 1)
    grams = [signed(g) for g in grams]  # the lower 34 bits, the highest of them as a sign
    out = []
    for k in range(max(1, len(grams) - 7)):
        window = grams[k : k + 8]
        least = min(window)
        at = k + max(j for j, g in enumerate(window) if g == least)
        if (least & ((1 << 34) - 1), at) not in out:
            out.append((least & ((1 << 34) - 1), at))
    return out


def test_winnowing(spark):
    pairs = list(enumerate(TEXTS))
    got = {r["doc_id"]: r for r in fingerprints.compare_edits(docs(spark, pairs)).collect()}
    assert len(got) == len(pairs)
    for k, t in pairs:
        t, after = t or "", TEXTS[(k + 1) % len(TEXTS)] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        own, changed, other = (brute_winnow(x) for x in (t, edited, after))
        shown = lambda f: ",".join(f"{h:X}:{at}" for h, at in f)
        assert got[k]["fingerprint"] == shown(own) and got[k]["edited_fingerprint"] == shown(changed), k
        assert got[k]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and got[k]["n_chars"] == len(t)
        like = lambda a, b: len({h for h, _ in a} & {h for h, _ in b}) / len({h for h, _ in a} | {h for h, _ in b}) if a or b else 1.0
        assert got[k]["near_edited"] == pytest.approx(like(own, changed)) and got[k]["near_next"] == pytest.approx(like(own, other))


def test_winnowing_takes_as_many_partitions_as_rows_bytes_and_cores_ask_for(spark, monkeypatch):
    cores = spark.sparkContext.defaultParallelism
    parts = lambda rows, size: fingerprints._id_buckets(spark.range(rows).selectExpr("id AS doc_id", f"{size}L AS bytes"))[1:]
    assert parts(10_000, 2000)[1] == 4 * cores and parts(10_000, 2000)[0] >= 4 * cores
    assert parts(150, 10)[1] <= 4 * cores and parts(0, 0)[1] >= 1
    monkeypatch.setattr(fingerprints, "BUCKET_ROWS", 100)
    assert parts(100_000, 10)[1] == 125 and parts(100_000, 100_000)[1] == 625


def test_winnowing_of_a_very_long_text(spark):
    text = " ".join(f"w{k * k % 10007}" for k in range(1_500_000))
    got = {r["doc_id"]: r for r in fingerprints.compare_edits(docs(spark, [(1, text), (2, "w1 w2 w3")])).select("doc_id", "n_chars", "near_edited", F.length("fingerprint").alias("n")).collect()}
    assert got[1]["n_chars"] == len(text) and got[1]["n"] > 1_000_000 and 0.4 < got[1]["near_edited"] <= 1


def test_winnowing_over_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "BUCKET_ROWS", 5)
    rng = random.Random(1)
    ids = sorted(rng.sample(range(10**12), 150)) + [2**62]
    pairs = [(k, f"text of {k} " * rng.randint(1, 4)) for k in ids]
    rng.shuffle(pairs)
    text = dict(pairs)
    got = {r["doc_id"]: r["edited_sha256"] for r in fingerprints.compare_edits(docs(spark, pairs)).collect()}
    for k, after in zip(ids, ids[1:] + ids[:1], strict=True):
        half = len(text[k]) // 2
        assert got[k] == hashlib.sha256((text[k][: len(text[k]) - half] + text[after][:half]).encode()).hexdigest()


@pytest.mark.parametrize("most", [fingerprints.MOST_BROADCAST, 0])
def test_winnowing_of_hot_ids(spark, monkeypatch, most):
    """A third of the rows with one id and a third with none are dealt to many buckets; first rows by broadcast or by join."""
    monkeypatch.setattr(fingerprints, "BUCKET_ROWS", 5)
    monkeypatch.setattr(fingerprints, "MOST_BROADCAST", most)
    rng = random.Random(2)
    rows = [(rng.choice([None, 77, k]), f"text {rng.randint(0, 10**9)} of {k} " * rng.randint(1, 3)) for k in range(300)]
    hashes = {r["text"]: r["h"] for r in docs(spark, rows).select("text", F.xxhash64("text").alias("h")).collect()}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, hashes[r[1]]))
    want = []
    for (_, t), (_, after) in zip(order, order[1:] + order[:1], strict=True):
        want.append(hashlib.sha256((t[: len(t) - len(t) // 2] + after[: len(t) // 2]).encode()).hexdigest())
    found = fingerprints.with_next(docs(spark, rows).select("doc_id", "text"))
    assert found.filter("not beyond").groupBy("bucket").count().agg({"count": "max"}).first()[0] < 40
    assert sorted(r["edited_sha256"] for r in fingerprints.compare_edits(docs(spark, rows)).collect()) == sorted(want)


@pytest.mark.parametrize("words", [1, 2, 5, 6])
def test_hashes_of_any_run_length(spark, monkeypatch, words):
    monkeypatch.setattr(fingerprints, "K", words)
    monkeypatch.setattr(fingerprints, "WINDOW", 1)
    text = "a b c d e f g h a b c d"
    got = fingerprints.with_fingerprint(docs(spark, [(1, text)]), "text", "f").select(fingerprints.shown("f").alias("f")).first()["f"]
    hashes, want = [xxhash.xxh64_intdigest(w.encode(), 42) for w in text.split()], []
    for k in range(len(hashes) - words + 1):
        value = 0
        for h in hashes[k : k + words]:
            value = turn(value, 1) ^ h
        want.append(f"{value & ((1 << 34) - 1):X}:{k}")
    assert got == ",".join(want)


def test_winnowing_edges(spark):
    assert fingerprints.compare_edits(docs(spark, [])).count() == 0
    assert fingerprints.compare_edits(docs(spark, [(5, "alone here")])).first()["n_chars"] == 10
    assert fingerprints.compare_edits(docs(spark, [(None, "a"), (None, "a"), (1, "b"), (1, "b"), (1, "c")])).count() == 5


def brute_base(text):
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    at, labels = [], set()
    for phrase, label in licenses.BASE_PHRASES:
        own = phrase.split()
        for k in range(len(words)):
            if words[k : k + len(own)] == own:
                at.append(k)
                labels.add(label)
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


def test_license_scan(spark):
    rng = random.Random(3)
    bits = ["MIT", "License", "apache", "general", "public", "license", "é", "lesser", "x1", "mit license", "GNU Lesser General Public License"]
    texts = TEXTS + ["mit license mit license", "MIT-License", "mit licensed", "xmit license", "SPDX-License-Identifier: (MIT OR GPL-3.0-only) AND Apache-2.0\nx"]
    texts += ["".join(rng.choice(bits) + rng.choice([" ", "\n", "--", ". ", "'"]) for _ in range(rng.randint(0, 30))) for _ in range(200)]
    got = {r["doc_id"]: r for r in licenses.scan_licenses(docs(spark, list(enumerate(texts)))).collect()}
    for k, t in enumerate(texts):
        r = got[k]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == brute_base(t), t
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
    tagged = got[len(TEXTS) + 4]
    assert tagged["labels"] == "apache,gpl,mit" and tagged["permitted"] and tagged["score"] >= 0.9
    assert licenses.scan_licenses(docs(spark, [])).count() == 0
    long = licenses.scan_licenses(docs(spark, [(1, "w, " * 2_000_000 + "mit license\n" + "SPDX-License-Identifier: ISC\n" * 3), (None, "MIT License")])).collect()
    assert {(r["doc_id"], r["n_words"], r["first_word"]) for r in long} == {(1, 2_000_014, 2_000_000), (None, 2, 0)}


def test_license_expressions():
    value = lambda x: licenses.evaluate(licenses.to_postfix(x))[0]
    assert value("MIT or GPL-3.0 and GPL-2.0") and not value("(MIT or GPL-3.0) and GPL-2.0")
    assert value("GPL-2.0 WITH Classpath-exception-2.0 AND MIT") and not value("CC-BY-NC-4.0")
    for known in ("mit", "MIT-0", "Apache-2.0", "Apache-2.0+", "BSD-3-Clause", "0BSD", "ISC", "CC-BY-4.0", "BSL-1.0", "CC0-1.0"):
        assert value(known), known
    for other in ("MITNFA", "mitigated-source-1", "ISC-Proprietary", "Apache-2.0-proprietary", "SSPL-1.0 WITH LLVM-exception", "CC-BY-NC-4.0 WITH Classpath-exception-2.0", "GPL-3.0 WITH LLVM-exception", "permissive", "bsd-3-clause-no-military-license", "LicenseRef-MIT", "GPL-2.0 WITH Classpath-exception-2.0-none"):
        assert not value(other), other
    assert licenses.evaluate(licenses.to_postfix("MITNFA OR GPL-3.0-or-later OR MPL-2.0-no-copyleft-exception"))[1] == {"other", "gpl", "mpl"}
    for bad in ("", "MIT AND", "OR MIT", "(MIT", "MIT)", "MIT Apache-2.0", "()", "mit.", "apache-"):
        assert licenses.to_postfix(bad) is None


def test_license_expressions_of_any_length(spark):
    tag = "SPDX-License-Identifier:"
    cut = f"{tag}{' GPL-2.0-only OR' * 60}".ljust(len(tag) + 997) + "MIT"  # its first 1,000 bytes are an expression too
    texts = [f"x\n{cut} AND GPL-3.0-only\nMIT", f"{tag} ({' OR '.join(['GPL-2.0-only'] * 400)} OR MIT) AND Apache-2.0 */ AND GPL-2.0", f"{tag} MIT{' AND MIT' * 900}\r\n{tag} ISC", f"{tag} MIT{' OR MIT' * 900} {tag} ISC"]
    a, b, c, d = sorted(licenses.scan_licenses(docs(spark, list(enumerate(texts)))).collect(), key=lambda r: r["doc_id"])
    assert (a["labels"], a["permitted"], a["expressions"].split()[-3:]) == ("gpl,mit", False, ["gpl-3.0-only", "and", "or"]) and a["score"] >= 0.9
    assert (b["labels"], b["permitted"], len(b["expressions"].split())) == ("apache,gpl,mit", True, 803)
    assert (c["labels"], c["permitted"], len(c["expressions"].split())) == ("isc,mit", True, 1802)
    assert d["labels"] == "isc,mit" and d["expressions"].endswith("; isc")  # the first ends where the second's tag begins


def brute_value(tokens):
    """Recursive descent: (permitted, labels) of the tokens, which are a whole expression."""
    at = [0]

    def name():
        token = tokens[at[0]]
        at[0] += 1
        if token == "(":
            out = either()
            at[0] += 1
            return out
        label = {"mit": "mit", "isc": "isc", "gpl-2.0-only": "gpl", "apache-2.0": "apache", "cc-by-nc-4.0": "cc-by-nc", "sspl-1.0": "sspl"}.get(token, "other")
        permitted = label in ("mit", "isc", "apache")
        if at[0] < len(tokens) and tokens[at[0]] == "with":
            permitted = permitted or label == "gpl" and tokens[at[0] + 1] == "classpath-exception-2.0"
            at[0] += 2
        return permitted, {label}

    def both():
        out = name()
        while at[0] < len(tokens) and tokens[at[0]] == "and":
            at[0] += 1
            other = name()
            out = out[0] and other[0], out[1] | other[1]
        return out

    def either():
        out = both()
        while at[0] < len(tokens) and tokens[at[0]] == "or":
            at[0] += 1
            other = both()
            out = out[0] or other[0], out[1] | other[1]
        return out

    return either()


def random_expression(rng, depth=0):
    if depth > 3 or rng.random() < 0.4:
        found = [rng.choice(["mit", "isc", "gpl-2.0-only", "apache-2.0", "cc-by-nc-4.0", "sspl-1.0", "foo-1"])]
        return found + ["with", rng.choice(["classpath-exception-2.0", "llvm-exception", "no-exception-1"])] if rng.random() < 0.2 else found
    inner = [*random_expression(rng, depth + 1), rng.choice(["and", "or"]), *random_expression(rng, depth + 1)]
    return ["(", *inner, ")"] if rng.random() < 0.5 else inner


NOTICES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl", "lesser general public license": "lgpl", "cc by": "cc-by", "cc by nc": "cc-by-nc", "all rights reserved": "proprietary"}


def test_labels_score_and_permission_by_brute_force():
    rng = random.Random(8)
    scanner = licenses.Scanner(licenses.BASE_PHRASES, licenses.MORE_PHRASES)
    for _ in range(600):
        lines, labels, values, tags, notices = [], set(), [], 0, 0
        for _ in range(rng.randint(0, 4)):
            if rng.random() < 0.5:
                tokens = random_expression(rng)
                after = rng.choice(["", ". See the file", '",', " */", " see file", ")", " license-expression: mit"])
                lines.append(f"// {rng.choice(licenses.TAGS)} " + " ".join(tokens).replace("( ", "(") + after)
                values.append(brute_value(tokens))
                tags += 1
                if "expression:" in after:
                    values.append((True, {"mit"}))
                    tags += 1
            else:
                phrase = rng.choice(sorted(NOTICES))
                other = rng.choice(sorted(NOTICES)) if rng.random() < 0.4 else None
                joint = rng.choice(["or", "and", "xx"])
                lines.append(f"under the {phrase}" + (f" {joint} {other}" if other else "") + " zz")
                fine = [NOTICES[p] in ("mit", "apache", "cc-by") for p in (phrase, other) if p]
                names = {NOTICES[p] for p in (phrase, other) if p}
                values.append(((any if joint == "or" else all)(fine), names))
                notices += len(fine)
                labels |= {"gpl"} if "lesser" in phrase + str(other) else set()  # base ones stay
        got = scanner.scan("\n".join(lines).encode())
        labels = labels.union(*(own for _, own in values)) if values else labels
        shown = "\n".join(lines)
        assert set(filter(None, got[5].split(","))) == labels, shown
        assert got[8] == (all(ok for ok, _ in values) if values else None), shown
        assert got[6] == pytest.approx(1 - 0.4**notices * 0.1**tags), shown


@pytest.mark.parametrize("unit", ["license-expression:mit and ", "license-expression:(", "license-expression:mit/", "mit license or ", "cc by nc nd ", "("])
def test_one_line_of_a_megabyte(unit):
    began = time.time()
    scanner = licenses.Scanner(licenses.BASE_PHRASES, licenses.MORE_PHRASES)
    scanner.scan(b"license-expression:" + (unit * (1_000_000 // len(unit))).encode())
    assert time.time() - began < 10


URLS = ["http://A.Example.NET/en/x", "https://example.net/en", "http://net/", "http://net", "x", None, "", "http://b.example.com/de/?q#f", "a://x.org/fr/y", "http://fr.org:80/fr/", "s://spam-farm.example.org/en/", "s://xspam-farm.example.org", "http://h#a://b", "http://é.net/€/"]


def test_url_filter_equals_its_sql_and_the_join(spark):
    frame = pd.DataFrame({"page_id": range(len(URLS)), "url": URLS})
    rows = spark.createDataFrame(frame.where(frame.notna(), None), "page_id long, url string").withColumn("host", F.lit("odd"))
    connection = duckdb.connect()
    connection.register("pages", frame)
    want = {r[0]: r[1:] for r in connection.sql(f"SELECT page_id, host, path, rule, verdict, listed FROM ({urlfilter.oracle()})").fetchall()}
    assert {r["page_id"]: tuple(r)[1:] for r in urlfilter.judge(rows).collect()} == want
    listed = spark.createDataFrame([(h,) for h in urlfilter.BLOCKED] + [(None,), ("",), (urlfilter.BLOCKED[0],)], "host string")
    for most in (100, 2):  # by files, and in ranges of digests where the list is beyond the bound
        assert {r["page_id"]: tuple(r)[1:] for r in urlfilter.judge(rows, blocked=listed, most_entries=most).collect()} == want
    assert urlfilter.judge(rows.limit(0)).count() == 0


def test_url_filter_lists_pages_of_links(spark):
    """Addresses of pages are entries; the whole array and its ranges give what the SQL gives."""
    rng = random.Random(3)
    urls = [*(u for u in URLS if u), *(f"https://{rng.choice('abc')}.site{rng.randrange(40)}.xy/{rng.randrange(9)}?q={k}" for k in range(300)), None, None]
    frame = pd.DataFrame({"page_id": range(len(urls)), "url": urls, "html": [rng.choice(['<a href="/x">x</a>' * 9, "<p>" + "x" * 400 + '<a href="/x">', None, ""]) for _ in urls]})
    pages = spark.createDataFrame(frame.astype(object).where(frame.notna(), None), "page_id long, url string, html string")
    connection = duckdb.connect()
    connection.register("pages", frame)
    want = {r[0]: r[1:] for r in connection.sql(f"SELECT page_id, host, path, rule, verdict, listed FROM ({urlfilter.oracle(own=True)})").fetchall()}
    entries = urlfilter.link_lists(pages).union(spark.createDataFrame([(h,) for h in urlfilter.BLOCKED], "host string"))
    assert entries.count() > 50 and {v[3] for v in want.values()} == {"allow", "block"}
    for most in (1000, 7):  # one array; sixteen ranges or more
        assert {r["page_id"]: tuple(r)[1:] for r in urlfilter.judge(pages, blocked=entries, most_entries=most).collect()} == want
    assert urlfilter.judge(pages, blocked=entries.limit(0), most_entries=0).filter("listed is not null").count() == 0


def test_url_filter_of_long_and_odd_hosts(spark):
    """Hosts of 200 kB with and without dots, entries of many labels, empty entries: files and join agree with brute force."""
    many, long = "a." * 100_000, "x" * 200_000
    hosts = [many + "example.net", many + "b.c.d.e.f", long + ".b.c.d.e.f", "f", "e.f", "c.d.e.f", "..f", "example.net.", ".", long, ""]
    entries = ["b.c.d.e.f", "e.f", "", None, "..f", "x.y"]
    rows = spark.createDataFrame([(k, f"http://{h}/en/p") for k, h in enumerate(hosts)], "page_id long, url string")
    listed = spark.createDataFrame([(e,) for e in entries], "host string")
    fits = lambda h, e: bool(e) and bool(h) and (h == e or h.endswith("." + e))
    for most in (100, 2):
        got = {r["page_id"]: r for r in urlfilter.judge(rows, (("net", "/", "block"), ("example.net", "/en/", "allow"), ("", "/", "block"), ("net", "/", "allow")), listed, most_entries=most).collect()}
        for k, h in enumerate(hosts):
            hits = [e for e in entries if fits(h, e)]
            rule = "example.net/en/" if fits(h, "example.net") else None
            want = max(hits, key=len) if hits else None
            assert (got[k]["rule"], got[k]["listed"]) == (rule, want), (most, h[-20:])
            assert got[k]["verdict"] == ("allow" if rule or not hits else "block") and got[k]["host"] == h


def test_digest_collisions_are_told_apart(monkeypatch):
    monkeypatch.setattr(urlfilter.xxhash, "xxh64_intdigest", lambda raw, seed=0: len(raw))
    index = urlfilter.DigestArray.build(pa.array(["ab", "cd", "xyz"]), np.array([0, 1, 1]))
    assert index.find(["cd", "ab", "ef", "xyz"]).tolist() == [1, 0, -1, 1]


def brute_ratios(texts, fitted):
    """Mean log ratios of n-grams, bucket by bucket, without a document's own counts."""
    own = [Counter(int(b) for b in quality._buckets(np.frombuffer(t, np.uint8))) for t in texts]
    raw, target = sum(own, Counter()), sum((c for c, f in zip(own, fitted, strict=True) if f), Counter())
    out = []
    for c, f in zip(own, fitted, strict=True):
        n = sum(c.values())
        scale = (sum(target.values()) - n * f) / max(sum(raw.values()) - n, 1)
        out.append(sum(k * math.log((target[b] - k * f + 3) / ((raw[b] - k) * scale + 3)) for b, k in c.items()) / max(n, 1))
    return out


def test_mean_ratios_are_the_brute_force_ones(monkeypatch):
    rng = random.Random(4)
    texts = ["".join(rng.choice(["a", "bb", "é", "long" * 9, "\n", " "]) for _ in range(rng.choice([0, 1, 2, 3, 40]))).encode() for _ in range(60)]
    texts += [b"x" * 5000, b"", b"abcd", b"words of a text " * 300]
    fitted = np.array([rng.random() < 0.4 for _ in texts])
    for size in (quality.BATCH_BYTES, 64):  # in one portion, and in many, the longer texts in pieces
        monkeypatch.setattr(quality, "BATCH_BYTES", size)
        raw, target = np.zeros(quality.BUCKETS), np.zeros(quality.BUCKETS)
        for part in quality._portions(texts):
            bucket, owner = quality.ngrams(texts[part])
            np.add.at(raw, bucket.astype(int), 1)
            np.add.at(target, bucket[fitted[part][owner.astype(int)]].astype(int), 1)
        assert raw.sum() == sum(max(0, len(t) - 3) for t in texts)
        assert quality.mean_ratios(texts, fitted, target, raw) == pytest.approx(brute_ratios(texts, fitted))


def test_kept_rows_are_the_brute_force_draw(spark):
    """Counts, ratios, the curve, the noise and the cut, all computed anew from their definitions."""
    rng = random.Random(9)
    kinds = [[f"word{k} " for k in range(60)], [f"!!{k} " for k in range(30)]]
    texts = ["".join(rng.choice(kinds[k % 5 == 0 and rng.random() < 0.4]) for _ in range(rng.randint(1, 60))) for k in range(300)]
    rows = docs(spark, list(enumerate(texts)))
    label = {k: k % 5 > 0 for k in range(0, 300, 2)}
    labels = spark.createDataFrame([(k, int(g or k % 10 == 5), int(not g)) for k, g in label.items()], "doc_id long, quality int, toxic int")
    ratio = dict(enumerate(brute_ratios([t.encode() for t in texts], [label.get(k, False) for k in range(300)])))
    x, y = np.array([ratio[k] for k in label]), np.array([float(g) for g in label.values()])
    a, b = 0.0, 0.0
    for _ in range(200_000):  # plain descent on the same aim
        p = 1 / (1 + np.exp(-(a * x / x.std() + b)))
        a, b = a - 0.003 * (((p - y) * x / x.std()).sum() + quality.RIDGE * a), b - 0.003 * ((p - y).sum() + quality.RIDGE * b)
    weight = {k: a / x.std() * r + b for k, r in ratio.items()}
    noise = {r["doc_id"]: r["g"] for r in rows.select("doc_id", quality.gumbel(F.col("doc_id"), F.xxhash64("text"), 11).alias("g")).collect()}
    reached = sorted(weight[k] + noise[k] for k, g in label.items() if g)
    cut = reached[int(len(reached) * (1 - quality.KEEP_GOOD))]
    got = {r["doc_id"]: r for r in quality.classify(rows, labels).collect()}
    assert {k: got[k]["log_weight"] for k in weight} == pytest.approx(weight, rel=1e-3, abs=1e-3)
    assert {k for k, r in got.items() if r["kept"]} == {k for k in weight if weight[k] + noise[k] >= cut}
    most = {r["doc_id"] for r in quality.classify(rows, labels, share=0.3).filter("kept").collect()}
    assert most == set(sorted(weight, key=lambda k: -(weight[k] + noise[k]))[:90])
    assert most != set(sorted(weight, key=lambda k: -weight[k])[:90])  # noise decides, so it is a draw


@pytest.mark.parametrize("sf,most_low", [("sf0.01", 0.2), ("sf0.1", 0.1)])
def test_quality_on_labels(spark, sf, most_low):
    """A document's own counts are left out, so that labelled documents are judged as if they were held out."""
    folder = f"/root/testdata/{sf}"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    judged = quality.classify(spark.read.parquet(f"{folder}/documents.parquet"), labels).join(labels, "doc_id")
    kept = {tuple(r)[:2]: r["kept"] for r in judged.groupBy("quality", F.col("toxic")).agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()}
    assert kept[1, 0] >= 0.99 and kept[0, 0] <= most_low


def test_quality_classifier(spark):
    rng = random.Random(7)
    good = [f"word{k}" for k in range(60)]
    junk = [f"!!{k}" for k in range(30)]
    make = lambda bad: " ".join(rng.choice(junk if bad and rng.random() < 0.5 else good) for _ in range(60))
    pairs = [(k, make(k % 4 == 0)) for k in range(800)] + [(2000, ""), (2001, None), (2002, "\n "), (None, "word1 word2"), (3000, "word1 word2 " * 150_000), (3001, "!!1 !!2 " * 150_000)]
    labels = spark.createDataFrame([(k, int(k % 4 > 0), 0) for k in range(0, 800, 2)] + [(None, 1, 0), (4000, 1, None)], "doc_id long, quality int, toxic int")
    rows = quality.classify(docs(spark, pairs), labels)
    kept = {r["doc_id"] for r in rows.filter("kept").collect()}
    unseen = [k for k in range(1, 800, 2)]
    clean, bad = [k for k in unseen if k % 4], [k for k in range(0, 800, 4)]
    assert np.mean([k in kept for k in clean]) > 0.97 and np.mean([k in kept for k in bad]) < 0.05
    assert 3000 in kept and 3001 not in kept
    weights = {r["doc_id"]: r["log_weight"] for r in rows.collect()}
    assert weights[2000] == weights[2001] == weights[2002] and None in weights
    assert sorted(map(str, rows.collect())) == sorted(map(str, quality.classify(docs(spark, pairs, 2), labels).collect()))
    stay = quality.drop_rejected(docs(spark, pairs), labels)
    assert {r["doc_id"] for r in stay.collect()} == kept and stay.columns[:2] == ["doc_id", "text"]
    assert quality.classify(docs(spark, pairs), labels.limit(0)).filter("kept").count() == len(pairs)
    assert quality.classify(docs(spark, []), labels).count() == 0


def test_kth_largest(spark):
    rng = random.Random(8)
    values = [rng.choice([rng.gauss(0, 1), 0.5, 3.0]) for _ in range(3000)]
    rows = spark.createDataFrame([(v,) for v in values], "sample_key double")
    for k in (1, 10, 500, 2999):
        assert quality._kth_largest(rows, k) == sorted(values, reverse=True)[k - 1]
    assert quality._kth_largest(rows, 3000) is None and quality._kth_largest(rows, 0) == math.inf
