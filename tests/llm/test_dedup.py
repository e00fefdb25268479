"""Exact and near deduplication against brute force."""

import random

import numpy as np
import pytest
import xxhash

from vitrine.llm import components, exactdedup, simhash

ODD = "doc_id long, text string, row string, digest string, points string, fp string, block string, source string"


def docs(spark, pairs, parts=3):
    return spark.createDataFrame([(k, t, "a", "b", "c", "d", "e", "f") for k, t in pairs], ODD).repartition(parts)


def test_perfect_hash_is_minimal_and_checked():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 17, 5000):
        keys = rng.integers(0, 2**63, size=(n, 4), dtype=np.uint64)
        pilots = exactdedup.build_hash(keys)
        assert sorted(exactdedup.find_slots(keys, pilots, n)) == list(range(n))
        others = rng.integers(0, 2**63, size=(100, 4), dtype=np.uint64)
        slots = exactdedup.find_slots(others, pilots, n)
        assert ((slots >= 0) & (slots < n)).all()


def brute_exact(pairs):
    groups = {}
    for k, t in pairs:
        groups.setdefault("".join(c for c in t or "" if c not in " \t\n\v\f\r"), []).append((-len(t or ""), k))
    return {k: (min(g)[1], len(g)) for plain, g in groups.items() for _, k in g}


def test_exact_dedup(spark):
    rng = random.Random(2)
    pairs = [(k, rng.choice(["a b", "ab", " a\tb ", "c", "", None, "é é", "éé", "x" * 50_000]) if k % 3 else f"only {k}") for k in range(300)]
    rows = exactdedup.exact_dedup(docs(spark, pairs)).collect()
    assert {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in rows} == brute_exact(pairs)
    assert all(r["kept"] == (r["doc_id"] == r["keep_id"]) for r in rows)
    want = sorted(map(tuple, rows))
    from pyspark.sql import functions as F

    for history in (F.lit(False), F.lit(True), F.col("doc_id") % 2 == 0):
        assert sorted(map(tuple, exactdedup.exact_dedup(docs(spark, pairs), history).collect())) == want


def test_exact_dedup_of_repeated_rows_and_nulls(spark):
    rows = exactdedup.exact_dedup(docs(spark, [(1, "a"), (1, "a"), (None, "a"), (None, "b"), (2, "b")])).collect()
    assert sum(r["kept"] for r in rows) == 2
    assert {r["keep_id"] for r in rows} == {None}
    assert exactdedup.exact_dedup(docs(spark, [])).count() == 0
    kept = exactdedup.drop_copies(docs(spark, [(1, "a"), (1, "a"), (2, "a"), (3, "b")]))
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3] and kept.columns[0] == "doc_id"


def components_of(n, linked):
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        ra, rb = root(a), root(b)
        parent[max(ra, rb)] = min(ra, rb)
    return [root(x) for x in range(n)]


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randint(0, 150), rng.randint(0, 150)) for _ in range(90)] + [(k, k + 1) for k in range(200, 260)] + [(300, k) for k in range(301, 340)] + [(7, 7)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = components_of(400, edges)
    assert all(got.get(k, k) == want[k] for k in range(400))
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_print(text):
    words = (text or "").translate({c: c + 32 for c in range(65, 91)}).encode().split()
    grams = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_components(spark):
    rng = random.Random(4)
    vocabulary = [f"w{k}" for k in range(300)]
    base = [" ".join(rng.choices(vocabulary, k=200)) for _ in range(20)]
    pairs = []
    for k in range(200):
        words = rng.choice(base).split()
        for _ in range(rng.choice([0, 0, 1, 2])):
            words[rng.randrange(len(words))] = "ZZ"
        pairs.append((k, " ".join(words)))
    pairs += [(900, ""), (901, None), (902, " \n"), (903, "one"), (904, "One"), (905, "İ É x" * 3000)]
    prints = [brute_print(t) for _, t in pairs]
    linked = [(a, b) for a in range(len(pairs)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 2]
    want = components_of(len(pairs), linked)
    got = {r["doc_id"]: r for r in simhash.near_duplicates(docs(spark, pairs)).collect()}
    for k, (doc, _) in enumerate(pairs):
        assert got[doc]["fingerprint"] == f"{prints[k]:016x}"
        assert got[doc]["component_id"] == pairs[want[k]][0]
    assert simhash.near_duplicates(docs(spark, [])).count() == 0


def test_hashes_of_long_texts_in_portions(monkeypatch):
    rng = random.Random(8)
    texts = [" ".join(rng.choice(["a", "Bb", "é", "x" * 30, "\n"]) for _ in range(rng.choice([0, 1, 4, 5, 6, 200]))).encode() for _ in range(60)] + [b"  ", b"y" * 500, b"one " * 300_000]
    whole = [(simhash.shingle_hashes(t, 5), simhash.simhash(np.unique(simhash.shingle_hashes(t, 5)), 256)) for t in texts]
    for words in (3, 5):
        for t in texts[:60]:
            found = t.translate(simhash._LOWER).split()
            runs = [b" ".join(found[k : k + words]) for k in range(max(1, len(found) - words + 1))] if found else []
            assert simhash.shingle_hashes(t, words).tolist() == [xxhash.xxh64_intdigest(r, 42) for r in runs]
    monkeypatch.setattr(simhash, "PORTION", 7)
    monkeypatch.setattr(simhash, "BIT_ROWS", 3)
    for t, (hashes, fingerprint) in zip(texts[:-1], whole, strict=False):
        assert simhash.shingle_hashes(t, 5).tolist() == hashes.tolist()
        assert simhash.simhash(np.unique(hashes), 256) == fingerprint


CLASH = "doc_id long, text string, _id_key string, _text_hash string, _first string, n string, kept string, root string"


@pytest.mark.parametrize("most", [200_000, 0])
@pytest.mark.parametrize("drop", [exactdedup.drop_copies, simhash.drop_near_duplicates])
def test_dropping_with_nulls_repeats_and_clashing_names(spark, monkeypatch, drop, most):
    """Dropped rows by broadcast and by join; null ids and texts, repeated rows, columns named like our own."""
    from vitrine.llm import _shared

    monkeypatch.setattr(_shared, "MOST_BROADCAST", most)
    text = " ".join(f"w{k}" for k in range(40))
    rows = [(3, text), (3, text), (2, text + " "), (2, text + " "), (None, "only here"), (None, "only here"), (None, None), (5, ""), (7, "alone in this table"), (7, "another text of that id"), (8, text + " ")]
    frame = spark.createDataFrame([(k, t, "a", "b", "c", "d", "e", "f") for k, t in rows], CLASH).repartition(3)
    got = drop(frame)
    assert got.columns == frame.columns and {tuple(r)[2:] for r in got.collect()} == {("a", "b", "c", "d", "e", "f")}
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=str) == sorted([(None, "only here"), (None, None), (7, "alone in this table"), (7, "another text of that id"), (2, text + " ")], key=str)
    assert drop(frame.limit(0)).count() == 0


def test_a_hot_root_by_join_and_by_broadcast(spark, monkeypatch):
    rng = random.Random(11)
    edges = [(0, k) for k in range(1, 300)] + [(rng.randint(300, 400), rng.randint(300, 400)) for _ in range(60)] + [(k, k + 1) for k in range(500, 530)] + [(None, 4)]
    frame = spark.createDataFrame(edges, "a long, b long")
    want = components_of(600, [e for e in edges if e[0] is not None])
    for most in (200_000, 0):
        monkeypatch.setattr(components, "MOST_BROADCAST", most)
        got = {r["node"]: r["root"] for r in components.components(frame).collect()}
        assert all(got.get(k, k) == want[k] for k in range(600))


def test_large_blocks_are_tiled(spark, monkeypatch):
    """Fingerprints of one block by the hundred, in tiles of 16: no link is lost."""
    monkeypatch.setattr(simhash, "TILE", 16)
    rng = random.Random(5)
    prints = {rng.getrandbits(64) & ~0xFFFF | rng.choice([0, 1, 3, 0xFF, 0xFFFF]) for _ in range(40)}
    center = rng.getrandbits(64)
    prints |= {center ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for _ in range(400)}
    prints = sorted(prints)
    frame = spark.createDataFrame([(p.to_bytes(8, "big"), p.bit_count()) for p in prints], "fp binary, ones int")
    linked = [(a, b) for a in range(len(prints)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 2]
    got = {}
    for r in simhash.classes(frame, 2).collect():
        got.setdefault(bytes(r["root"]), set()).add(int.from_bytes(r["fp"], "big"))
    want = {}
    for k, r in enumerate(components_of(len(prints), linked)):
        want.setdefault(r, set()).add(prints[k])
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


@pytest.mark.parametrize("tile", [512, 4])
def test_near_duplicates_by_shingles(spark, monkeypatch, tile):
    monkeypatch.setattr(simhash, "TEXT_TILE", tile)
    rng = random.Random(6)
    vocabulary = [f"w{k}" for k in range(500)]
    pairs = []
    for k in range(12):
        words = rng.choices(vocabulary, k=120)
        for j in range(12):
            own = list(words)
            for _ in range(rng.choice([0, 1, 2, 4, 8, 20])):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            pairs.append((k * 100 + j, " ".join(own)))
    pairs += [(5000, ""), (5001, None), (5002, "short"), (5003, "short"), (5004, "a b c d e f"), (5005, "a b c d e g")]
    sets = []
    for _, t in pairs:
        words = (t or "").split()
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    near = lambda a, b: a == b or 5 * len(a & b) >= 4 * len(a | b) > 0
    want = components_of(len(pairs), [(a, b) for a in range(len(pairs)) for b in range(a) if near(sets[a], sets[b])])
    kept = sorted(r["doc_id"] for r in simhash.drop_near_duplicates(docs(spark, pairs)).collect())
    assert kept == sorted({pairs[w][0] for w in want})
    assert simhash.drop_near_duplicates(docs(spark, [])).count() == 0


def test_near_duplicates_at_the_bound_in_short_texts(spark):
    """Pairs of 6 to 30 words at a similarity of exactly 0.8 are found, though some differ in many bits; those below it are kept."""
    rng = np.random.default_rng(7)
    pairs, kept = [], []
    for words, more in [(8, 1)] * 200 + [(12, 2), (16, 3), (20, 4), (24, 5)] * 50:  # 4 of 5 to 20 of 25 common runs of five words
        own = [f"w{x}" for x in rng.integers(0, 2**40, words + more)]
        kept.append(len(pairs))
        pairs += [(len(pairs), " ".join(own[:words])), (len(pairs) + 1, " ".join(own))]
    for words in (6, 12, 29):  # a word in the middle: 0 of 5, 4 of 13 and 21 of 30 runs are common
        own = [f"w{x}" for x in rng.integers(0, 2**40, words + 1)]
        kept += [len(pairs), len(pairs) + 1]
        pairs += [(len(pairs), " ".join(own[:words])), (len(pairs) + 1, " ".join([*own[: words // 2], "x", *own[words // 2 :]]))]
    assert sorted(r["doc_id"] for r in simhash.drop_near_duplicates(docs(spark, pairs)).collect()) == kept


def test_near_rows_by_brute_force(spark):
    """Fingerprints of 256 bits meet in tiles of one side and of two; rows near none are left out."""
    rng = random.Random(12)
    rows = []
    for block in range(6):
        base = [rng.getrandbits(256) for _ in range(3)]
        for tile in range(3):
            for _ in range(rng.choice([1, 2, 150])):
                fp = rng.choice([*base, rng.getrandbits(256)]) ^ sum(1 << b for b in rng.sample(range(256), rng.choice([5, 40, 60])))
                rows.append((block, tile, 2 if block % 2 else rng.randint(0, 1), fp.to_bytes(32, "big")))
    far = lambda a, b: (int.from_bytes(a, "big") ^ int.from_bytes(b, "big")).bit_count() > 96
    meet = lambda r, s: r is not s and r[:2] == s[:2] and (r[2] == 2 or r[2] != s[2])
    want = sorted(r for r in rows if any(meet(r, s) and not far(r[3], s[3]) for s in rows))
    frame = spark.createDataFrame(rows, "block long, tile long, side int, fp binary")
    assert 0 < len(want) < len(rows)
    assert sorted((r[0], r[1], r[2], bytes(r[3])) for r in simhash.near_rows(frame, 96).collect()) == want


def test_fingerprints_decide_what_is_confirmed(spark, monkeypatch):
    """Near copies are linked by their fingerprints: with a radius of 0 no two different texts are."""
    rng = random.Random(13)
    pairs = []
    for k in range(20):
        words = [f"w{rng.randrange(10**9)}" for _ in range(100)]
        pairs += [(2 * k, " ".join(words)), (2 * k + 1, " ".join([*words, "more"]))]
    kept = lambda: sorted(r["doc_id"] for r in simhash.drop_near_duplicates(docs(spark, pairs)).collect())
    assert kept() == list(range(0, 40, 2))
    monkeypatch.setattr(simhash, "NEAR_RADIUS", 0)
    assert kept() == list(range(40))


def test_the_radius_holds_all_pairs_at_the_bound():
    """Of 4 of 5 shingles, the worst case at a similarity of 0.8, fingerprints stay well within the radius."""
    rng = np.random.default_rng(14)
    apart = []
    for hashes in rng.integers(0, 2**63, size=(2000, 5), dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, size=(2000, 5), dtype=np.uint64):
        a, b = (int.from_bytes(simhash.simhash(h, 256), "big") for h in (hashes[:4].copy(), hashes))
        apart.append((a ^ b).bit_count())
    assert 45 < np.mean(apart) < 51 and max(apart) < simhash.NEAR_RADIUS - 10
