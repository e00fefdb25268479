"""Search through postings gives the rows of the plain search and reads the blocks of candidates alone."""

import itertools
import random
import re
import time

import pytest

from vitrine.operators import postings
from vitrine.operators.search import matching

SCHEMA = "id long, text string, name string"
WORDS = ["Café", "cafe", "CAFÉ", "straße", "STRASSE", "œuvre", "oeuvre", "naïve", "ño", "abc", "ABCD", "xa_b", "100%", "a\x01bc", "éa", "日本", "İstanbul", "K", "ab"]
KEYWORDS = ["CAFÉ", "strasse", "oeuvre", "abc", "a_b", "ab", "ño abc", "日本"]


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(3)
    rows = [(k, " ".join(rng.choices(WORDS, k=rng.randint(0, 5))) if k % 13 else None, rng.choice(WORDS)) for k in range(300)]
    return spark.createDataFrame([*rows, (5, "abc again", None), (None, "ABC", "")], SCHEMA).repartition(4)


def ids(rows):
    return sorted((r["id"] is None, r["id"] or 0, str(r["text"])) for r in rows.collect())


@pytest.mark.parametrize("wildcards", [False, True])
def test_same_rows_as_the_plain_search(spark, table, wildcards):
    index = postings.build(table, ["text", "name"], id_col="id", block_rows=20)
    asked = KEYWORDS + (["str%se", "caf_%abc"] if wildcards else [])
    for word in asked:
        assert ids(postings.search(index, word, wildcards=wildcards)) == ids(matching(table, ["text", "name"], word, wildcards=wildcards)), word


def test_only_blocks_of_candidates_are_read(spark):
    rows = spark.range(2000).selectExpr("id", "concat('text ', id % 7, if(id = 777, ' needle', '')) AS text")
    index = postings.build(rows, ["text"], id_col="id", block_rows=100)
    found = postings.search(index, "Needle")
    assert [r["id"] for r in found.collect()] == [777]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^]]*_block#\d+ = \d+", plan)  # one block of some twenty
    assert index.rows().select("_block").distinct().count() >= 15


def test_lists_are_differences_within_a_block(spark):
    rows = spark.range(50).selectExpr("id", "if(id % 5 = 0, 'abcd', 'xyz') AS text")
    index = postings.build(rows, ["text"], id_col="id", block_rows=1000)
    assert {(r["gram"], tuple(r["steps"])) for r in index.postings().collect()} >= {("abc", (0, *[5] * 9)), ("bcd", (0, *[5] * 9))}
    assert postings.grams_of("ab") is None and postings.grams_of("Ça va") == [" va", "a v", "ca "]


def test_a_very_long_text(spark):
    rows = spark.createDataFrame([(1, "word " * 400_000 + "needle"), (2, "word")], "id long, text string")
    index = postings.build(rows, ["text"], id_col="id")
    assert [r["id"] for r in postings.search(index, "needle").collect()] == [1]


@pytest.mark.parametrize("block_rows", [70, 1000])
def test_lists_are_those_of_a_loop_over_the_rows(spark, table, block_rows):
    index = postings.build(table, ["text", "name"], id_col="id", block_rows=block_rows)
    want = {}
    for block, row, *texts in index.rows().select("_block", "_row", postings.folded("text"), postings.folded("name")).collect():
        for column, text in enumerate(texts):
            odd = text is not None and re.search(postings._ODD, text)
            for gram in {postings.ANY} if odd else {text[k : k + 3] for k in range(len(text or "") - 2)}:
                want.setdefault((gram, -1 if odd else column, block), set()).add(row)
    got = index.postings().collect()
    assert len(got) == len(want) and all(r["n"] == len(r["steps"]) for r in got)
    assert {(r["gram"], r["column"], r["_block"]): list(itertools.accumulate(r["steps"])) for r in got} == {k: sorted(v) for k, v in want.items()}


def test_texts_of_many_different_grams_are_posted_in_seconds(spark):
    rng = random.Random(4)
    rows = [(k, "".join(rng.choices("abcdefghijklmnopqrstuvwxyz     éü", k=20_000))) for k in range(100)]
    began = time.perf_counter()
    index = postings.build(spark.createDataFrame(rows, "id long, text string"), ["text"], id_col="id")
    took = time.perf_counter() - began
    assert index.postings().count() > 15_000
    assert took < 30


def test_two_columns_of_many_different_grams_are_searched_with_wildcards_in_seconds(spark):
    rng = random.Random(6)
    text = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz     éü", k=10_000))
    table = spark.createDataFrame([(k, text(), text()) for k in range(100)], SCHEMA).localCheckpoint()
    began = time.perf_counter()
    found = ids(postings.search(postings.build(table, ["text", "name"], id_col="id"), "a_bcd%ef", wildcards=True))
    took = time.perf_counter() - began
    assert found and found == ids(matching(table, ["text", "name"], "a_bcd%ef", wildcards=True))
    assert took < 30
