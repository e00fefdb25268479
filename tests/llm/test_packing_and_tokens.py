"""Packing and token output against the tokenizers library itself."""

import glob
import random
import zlib

import numpy as np
import pytest
from pyarrow import orc
from tokenizers import Tokenizer

from vitrine.llm import orctokens, packing, tokens
from vitrine.llm.tokens import encoder, public_path

TEXTS = ["", None, "one", "the the\n\n  the cat's <|endoftext|> 12 ½ naïve İstanbul Łódź\x1f\xa0", "word " * 9000, "x" * 5000, "the the\n\n  the", "the the\n\n  the", "a  b", "."]
ODD = "doc_id long, text string, length long, ids string, n_tokens string, sequence_id string, source string"


def docs(spark, texts=TEXTS):
    return spark.createDataFrame([(k if k != 9 else None, t, 7, "x", "y", "z", "s") for k, t in enumerate(texts)], ODD).repartition(2)


def expected(name, end):
    tokenizer = Tokenizer.from_file(public_path(name))
    return {k if k != 9 else None: np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, end], "<u4") for k, t in enumerate(TEXTS)}


@pytest.mark.parametrize("as_text", [False, True])
@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_chunked_ids_equal_the_whole(name, as_text, monkeypatch):
    tokenizer = Tokenizer.from_file(public_path(name))
    tokenizer.encode_special_tokens = as_text
    rng = np.random.default_rng(4)
    letters = [*"abcDE  é\n\t'sÀ,.!3²_ßĀ\x1f\xa0<|>ÿ­ÇµºiİΣς", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>"]
    own = encoder(public_path(name), as_text)
    for long in (tokens.LONG, 5):  # at once, and in portions
        monkeypatch.setattr(tokens, "LONG", long)
        monkeypatch.setattr(tokens, "PORTION", 3)
        assert own("a<|endoftext|> b " * 9) == np.array(tokenizer.encode("a<|endoftext|> b " * 9, add_special_tokens=False).ids, "<u4").tobytes()
    for t in ["".join(rng.choice(letters, rng.integers(0, 50))) for _ in range(3000)] + [t or "" for t in TEXTS]:
        assert own(t) == np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), t


def check_pieces(rows, ids, capacity, max_segments, max_loss, prompts=None):
    sequences, at = {}, {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        own = ids[r["doc_id"]]
        assert r["doc_tokens"] == len(own)
        assert r["ids_crc32"] == zlib.crc32(own[r["start"] : r["start"] + r["length"]].tobytes())
        held = sequences.setdefault(r["sequence_id"], [0, 0, 0])
        assert r["offset"] == held[0] and r["length"] > 0
        for k, v in enumerate((r["length"], 1, r["loss_tokens"])):
            held[k] += v
        at.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
    for doc, own in ids.items():
        place = 0
        for start, length in sorted(at[doc]):
            assert start == place
            place += length
        assert place == len(own)
    for tokens, segments, loss in sequences.values():
        assert tokens <= capacity and segments <= max_segments and loss <= max_loss
    return sequences


def test_packing_covers_every_token_once(spark):
    rows = packing.pack(docs(spark), public_path("byte_bpe_50k.json"), 1).collect()
    sequences = check_pieces(rows, expected("byte_bpe_50k.json", 1), 2048, 256, 2048)
    padding = sum(0 if n & (n - 1) == 0 else 2048 - n for n, _, _ in sequences.values())
    assert padding < 0.02 * sum(n for n, _, _ in sequences.values())
    again = packing.pack(docs(spark), public_path("byte_bpe_50k.json"), 1).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))


def test_packing_of_instructions_keeps_all_limits(spark, data):
    from pyspark.sql import functions as F

    turns = spark.read.parquet(f"{data}/conversations.parquet")
    pairs = turns.filter("role = 'assistant'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), "text", (F.col("turn") - 1).alias("turn"), "conv_id")
    asked = turns.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("prompt"))
    frame = pairs.join(asked, ["conv_id", "turn"])
    tokenizer = Tokenizer.from_file(public_path("byte_bpe_50k.json"))
    encode = lambda t: tokenizer.encode(t, add_special_tokens=False).ids
    ids = {r["doc_id"]: np.array([*encode(r["prompt"]), *encode(r["text"]), 1], "<u4") for r in frame.collect()}
    rows = packing.pack(frame, public_path("byte_bpe_50k.json"), 1, prompt_col="prompt", capacity=512, max_segments=3, max_loss=300).collect()
    check_pieces(rows, ids, 512, 3, 300)
    prompts = {r["doc_id"]: len(encode(r["prompt"])) for r in frame.collect()}
    loss = {}
    for r in rows:
        loss[r["doc_id"]] = loss.get(r["doc_id"], 0) + r["loss_tokens"]
    assert loss == {k: len(v) - prompts[k] for k, v in ids.items()}


def test_instruction_packing_is_bound_by_loss_and_segments(spark):
    from vitrine.llm.queries import instruction_packing

    folder = "/root/testdata/sf0.01"
    tokenizer = Tokenizer.from_file(public_path("byte_bpe_50k.json"))
    encode = lambda t: tokenizer.encode(t, add_special_tokens=False).ids
    turns = {(int(r["conv_id"]), int(r["turn"])): (r["role"], r["text"] or "") for r in spark.read.parquet(f"{folder}/conversations.parquet").collect()}
    ids, prompts = {}, {}
    for (c, t), (role, text) in turns.items():
        if role == "assistant":
            before = turns.get((c, t - 1), ("", ""))
            lead = encode(before[1]) if before[0] == "user" else []
            ids[c * (1 << 20) + t], prompts[c * (1 << 20) + t] = np.array([*lead, *encode(text), 1], "<u4"), len(lead)
    rows = instruction_packing(spark, folder).collect()
    sequences = check_pieces(rows, ids, 2048, 4, 1536)
    for r in rows:
        assert r["loss_tokens"] == r["length"] - min(r["length"], max(0, prompts[r["doc_id"]] - r["start"]))
    assert max(n for n, _, _ in sequences.values()) > 2000  # nearly full by tokens
    assert any(s == 4 and n < 2048 and loss < 1536 for n, s, loss in sequences.values())  # by segments
    assert any(loss == 1536 and n < 2048 and s < 4 for n, s, loss in sequences.values())  # by loss


def test_many_empty_documents(spark):
    frame = spark.createDataFrame([(k, "") for k in range(1000)], "doc_id long, text string").coalesce(1)
    rows = packing.pack(frame, public_path("byte_bpe_50k.json"), 1).collect()
    assert len(rows) == 1000 and max(r["offset"] for r in rows) == 255


def test_orc_round_trip(spark, tmp_path):
    path = str(tmp_path / "tokens")
    orctokens.write_tokens(docs(spark), path, public_path("word_bpe_49k.json"), 2)
    want = expected("word_bpe_49k.json", 2)
    order = sorted(want, key=lambda k: (k is not None, k))
    got = {r["doc_id"]: r for r in orctokens.token_digests(spark, path).collect()}
    place = 0
    for k in order:
        assert (got[k]["start"], got[k]["n_tokens"], got[k]["ids_crc32"]) == (place, len(want[k]), zlib.crc32(want[k].tobytes()))
        place += len(want[k])
    assert [r["ids"] for r in orctokens.read_tokens(spark, path).filter("doc_id = 3").collect()] == [list(map(int, want[3]))]


def test_orc_of_repeated_ids_starts_where_the_file_has_them(spark, tmp_path):
    """A third of the rows with one id, a third with none, repeated rows: starts are the places in the files, without gaps."""
    path, rng = str(tmp_path / "tokens"), random.Random(1)
    rows = [(rng.choice([None, 7, k]), "w " * rng.randint(0, 40)) for k in range(300)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        orctokens.write_tokens(frame, path, public_path("word_bpe_49k.json"), 2)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    got = sorted(map(tuple, orctokens.token_digests(spark, path).select("start", "n_tokens", "doc_id", "ids_crc32").collect()), key=lambda r: r[0])
    assert sorted(str(r[2]) for r in got) == sorted(str(k) for k, _ in rows)
    assert [r[0] for r in got] == [sum(r[1] for r in got[:k]) for k in range(len(got))]
    assert [(r[2] is not None, r[2] or 0) for r in got] == sorted((k is not None, k or 0) for k, _ in rows)
    files = sorted(glob.glob(f"{path}/*.orc"), key=lambda f: (len(f), f))
    stored = [(d, zlib.crc32(np.array(i, "<u4").tobytes())) for f in files for d, i in zip(*(orc.read_table(f)[c].to_pylist() for c in ("doc_id", "ids")), strict=True)]
    assert [(r[2], r[3]) for r in got] == stored and len(files) > 1


def test_orc_files_have_stripes_indexes_and_bloom_filters(spark, tmp_path):
    path, rng = str(tmp_path / "tokens"), random.Random(2)
    frame = spark.createDataFrame([(3 * k, " ".join(str(rng.randint(0, 10**6)) for _ in range(60))) for k in range(8000)], "doc_id long, text string").coalesce(1)
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        orctokens.write_tokens(frame, path, public_path("word_bpe_49k.json"), 2, stripe_bytes=200_000)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    (name,) = glob.glob(f"{path}/*.orc")
    file = orc.ORCFile(name)
    assert file.nstripes > 1 and file.nrows == 8000 and file.row_index_stride == orctokens.ROW_INDEX
    assert sum(file.read_stripe(k).num_rows for k in range(file.nstripes)) == 8000
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    reader = jvm.org.apache.orc.OrcFile.createReader(jvm.org.apache.hadoop.fs.Path(name), jvm.org.apache.orc.OrcFile.readerOptions(conf))
    kinds, encodings = set(), set()
    for stripe in reader.getStripes():
        footer = reader.rows().readStripeFooter(stripe)
        kinds |= {(s.getColumn(), s.getKind().toString()) for s in footer.getStreamsList()}
        encodings |= {c.getKind().toString() for c in footer.getColumnsList()}
    assert (1, "ROW_INDEX") in kinds and (1, "BLOOM_FILTER_UTF8") in kinds and "DIRECT_V2" in encodings  # the second form of run lengths
    got = orctokens.read_tokens(spark, path).filter("doc_id = 3000")
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,3000)]" in got._jdf.queryExecution().toString() and got.count() == 1


def test_empty_tables(spark, tmp_path):
    assert packing.pack(docs(spark, []), public_path("byte_bpe_50k.json"), 1).count() == 0
    orctokens.write_tokens(docs(spark, []), str(tmp_path / "none"), public_path("word_bpe_49k.json"), 2)
    assert orctokens.token_digests(spark, str(tmp_path / "none")).count() == 0


def test_instructions_with_nulls_repeats_and_empty_tables(spark):
    from vitrine.llm.queries import instructions

    rows = [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 1, "assistant", "x"), (1, 1, "assistant", "x"), (1, 1000, "assistant", None), (2, 0, "assistant", "y"), (2, 1, None, "z"), (None, 1, "assistant", "n")]
    table = spark.createDataFrame([(*r, "p", "d") for r in rows], "conv_id long, turn long, role string, text string, prompt string, doc_id string")
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["prompt"], r["text"]) for r in instructions(table).collect())
    one = 1 << 20
    assert got == [(False, one + 1, "a", "x"), (False, one + 1, "a", "x"), (False, one + 1000, None, ""), (False, 2 * one, None, "y"), (True, 0, None, "n")]
    assert instructions(table.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_words_with_marks_are_remembered(name):
    """Every chunk of a text is in memory after its first occurrence, a word with a mark behind it too, with the ids of a plain call."""
    made = tokens.TextEncoder(tokens.public_path(name))
    text = "Hello, World. Grüße, hello, x1. Été. World.\nHELLO, ... a.b. don't, 3."
    want = made.tokenizer.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(made.ids(text), "<u4").tolist() == want
    chunks = text.split() if made.drops_space else made.pattern.findall(text)
    assert all(c in made.memo for c in chunks)
    assert np.frombuffer(made.ids(text), "<u4").tolist() == want


def test_a_word_before_marks_takes_no_room_of_its_own():
    """Of words with marks behind them only whole chunks and the marks are in memory, with the ids of a plain call."""
    made = tokens.TextEncoder(tokens.public_path("word_bpe_49k.json"))
    text = "wow!! Grüße*** x***, don't! éa's. no'. so.'' |ab| hm...? Été\u2026 ok_- $$$"
    assert np.frombuffer(made.ids(text), "<u4").tolist() == made.tokenizer.encode(text, add_special_tokens=False).ids
    assert {"wow!!", "!!", "Grüße***", "***"} <= set(made.memo) and not {"wow", "Grüße", "x"} & set(made.memo)
    other = tokens.TextEncoder(tokens.public_path("byte_bpe_50k.json"))
    assert np.frombuffer(other.ids(text), "<u4").tolist() == other.tokenizer.encode(text, add_special_tokens=False).ids
