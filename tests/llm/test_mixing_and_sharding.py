"""Mixing, compaction and the pipeline."""

import math
import random
import re
import threading

import pytest
from pyspark.sql import functions as F

from vitrine.llm import compaction, mixing

ODD = "doc_id long, text string, source string, n_chars long, target string, size string, s string, edge string, taken string, rank string, p string"


def docs(spark, rows, parts=3):
    return spark.createDataFrame([(k, t, s, len(t or ""), "a", "b", "c", "d", "e", "f", "g") for k, t, s in rows], ODD).repartition(parts)


def count(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def brute_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weights = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    left, out, free = 1.5 * sum(sizes.values()), {}, set(order)
    while free:
        total = sum(weights[s] for s in free)
        over = [s for s in free if left * weights[s] / total > 2 * sizes[s]]
        if not over:
            return out | {s: left * weights[s] / total for s in free}
        for s in over:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
            free.remove(s)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_mix(spark, seed):
    rng = random.Random(seed)
    sources = ["a", "B", "é", "zz", "", None][: 2 + seed]
    rows = [(k, rng.choice(["", None, " \t", "w " * rng.randint(1, 90), "  lead w\n" * rng.randint(1, 30)]), rng.choice(sources + ["a"] * 4)) for k in range(400)]
    rows += [(None, "null id", "a"), (7, "again one two", "a"), (7, "again one two", "a")]
    got = mixing.mix(docs(spark, rows)).collect()
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + count(t)
    want, taken = brute_targets(sizes), {}
    assert len(got) == len(rows)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    for s, n in taken.items():
        assert abs(n - want[s]) <= 3
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs(spark, rows, 5)).collect()))


def brute_draw(docs, rest, u):
    """{place: words} of a Pareto draw of rest words from docs (place, id, size); u: random number of an id."""
    free, left = [d for d in docs if d[2]], rest
    sure = []
    while (over := [d for d in free if left / sum(x[2] ** 2 for x in free) * d[2] > 1]) and left:
        over = [d for d in over if d[2] == max(x[2] for x in over)]
        sure += over
        left -= sum(d[2] for d in over)
        free = [d for d in free if d not in over]
    scale = left / sum(d[2] ** 2 for d in free) if free else 0
    odds = lambda x: x / (1 - x)
    ranked = [(0.0, d) for d in sure] + [(odds(u[d[1]]) / odds(scale * d[2]), d) for d in free if left]
    out = {}
    for _, (place, _, size) in sorted(ranked):
        out[place] = min(size, rest)
        rest -= out[place]
    return out


def test_the_draw_is_the_pareto_draw(spark):
    rng = random.Random(21)
    rows = [(k, "w " * rng.choice([0, 1, 3, 20, 90, 400, rng.randint(1, 700)]), rng.choice("abcccccd")) for k in range(500)] + [(900 + k, "w " * 9000, "a") for k in range(2)]
    got = {r["doc_id"]: r for r in mixing.mix(docs(spark, rows)).collect()}
    ids = docs(spark, rows).select("doc_id", mixing.rank_uniform(F.col("doc_id"), 7).alias("u"))
    u = {r["doc_id"]: r["u"] for r in ids.collect()}
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + count(t)
    drawn = 0
    for source, target in brute_targets(sizes).items():
        own = [(k, k, count(t)) for k, t, s in rows if s == source]
        copies = int(target // sizes[source])
        extra = brute_draw(own, int(target - copies * sizes[source]), u)
        for k, _, size in own:
            assert got[k]["taken"] == pytest.approx(copies * size + extra.get(k, 0), abs=1), (source, k)
        drawn += 0 < sum(v > 0 for v in extra.values()) < sum(d[2] > 0 for d in own)
    assert drawn  # somewhere a part of the documents is drawn


def test_mixed_documents_of_nulls_and_nothing(spark):
    rows = [(None, "null id", "a"), (1, None, "a"), (2, "b c", None), (2, "b c", None), (3, "", "b"), (4, "long " * 300_000, "b")]
    frame = mixing.mixed_documents(docs(spark, rows))
    taken = {}
    for r in mixing.mix(docs(spark, rows)).collect():
        taken[r["doc_id"]] = taken.get(r["doc_id"], 0) + r["taken"]
    got = {}
    for r in frame.collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + count(r["text"])
    assert got == {k: v for k, v in taken.items() if v} and 1 not in got
    assert mixing.mixed_documents(docs(spark, [])).count() == 0 and frame.columns == docs(spark, rows).columns


def test_mixed_documents_take_what_mix_says(spark):
    rng = random.Random(9)
    rows = [(k, f"  d{k} " + "w\t" * rng.randint(0, 50), rng.choice("abc")) for k in range(200)]
    want = {r["doc_id"]: r["taken"] for r in mixing.mix(docs(spark, rows)).collect() if r["taken"]}
    frame = mixing.mixed_documents(docs(spark, rows))
    got, texts = {}, {k: t for k, t, _ in rows}
    for r in frame.collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + count(r["text"])
        assert r["n_chars"] == len(r["text"]) and texts[r["doc_id"]].split()[: count(r["text"])] == r["text"].split()
    assert got == want and frame.columns == docs(spark, rows).columns


def test_empty_mix(spark):
    assert mixing.mix(docs(spark, [])).count() == 0
    assert mixing.mix(docs(spark, [(1, "", "a"), (2, None, None)])).agg({"taken": "sum"}).first()[0] == 0


def key(frame):
    return sorted(str((r["doc_id"], r["text"])) for r in frame.collect())


def some_rows(rng, n, longest=3000):
    letters = "abcdefghijklmnopqrstuvwxyz "
    return [(k if k % 50 else None, rng.choice(["", None, "".join(rng.choices(letters, k=rng.randint(1, longest)))]), "s") for k in range(n)]


def brute_plan(shards, target):
    """{shard: run} of (shard, bytes, tier)."""
    out, tiers = {}, {}
    for s in sorted(shards):
        if s[1] * 2 <= target:
            tiers.setdefault(s[2], []).append(s)
    for tier, own in tiers.items():
        total, before = sum(s[1] for s in own), 0
        parts, runs = max(1, math.floor(total / target + 0.5)), {}
        for name, size, _ in own:
            runs.setdefault(math.floor((before + size / 2) * parts / total), []).append(name)
            before += size
        for part, names in runs.items():
            out |= {name: f"{tier}-{part}" if len(names) > 1 else None for name in names}
    return out


def test_compaction_plan_is_the_brute_force_one(spark, tmp_path):
    rng = random.Random(5)
    shards = [(f"s{k:03d}", rng.choice([rng.randint(1000, 4000), rng.randint(10_000, 60_000), rng.randint(60_000, 300_000)]), rng.randint(0, 3)) for k in range(200)]
    table = compaction.ShardedTable(spark, str(tmp_path / "t"), target_bytes=200_000)
    rows = spark.createDataFrame([(s, b, 1, t) for s, b, t in shards], "shard string, bytes long, rows long, tier int")
    table._commit(rows, 1, rows.schema)
    assert {r["shard"]: r["run"] for r in table.plan().collect()} == brute_plan(shards, 200_000)


def test_compaction_keeps_rows_reaches_the_target_and_rests(spark, tmp_path):
    rows = some_rows(random.Random(1), 6000)
    target = 200_000
    table = compaction.ShardedTable(spark, str(tmp_path / "t"), target_bytes=target)
    for k in range(5):
        table.append(docs(spark, rows[k::5], 4))
    before, shards = table.version(), table.manifest().count()
    after = table.compact()
    assert after > before and table.manifest().count() < shards
    assert key(table.read()) == key(docs(spark, rows)) == key(table.read(before))
    now = table.manifest().collect()
    assert sum(r["rows"] for r in now) == 6000
    small = [r["tier"] for r in now if r["bytes"] * 2 < target]
    assert len(small) == len(set(small)) < len(now) and all(r["bytes"] <= 1.5 * target for r in now)
    assert table.compact() == after and [r["shard"] for r in table.manifest().collect()] == [r["shard"] for r in now]
    table.vacuum()
    assert key(table.read(before)) == key(docs(spark, rows))  # young folders stay
    table.vacuum(older_than=0)
    assert key(table.read()) == key(docs(spark, rows))


def test_two_writers_of_one_version(spark, tmp_path):
    """Both read version 1 and commit version 2 at the same time: one does, the other fails loudly, again and again."""
    table = compaction.ShardedTable(spark, str(tmp_path / "t"))
    table.append(docs(spark, [(1, "a", "s")], 1))
    for now in range(1, 6):
        failed, held, schema = [], table.manifest(now).drop("version"), table.schema()
        start = threading.Barrier(2)

        def write(k, now=now, held=held, schema=schema, start=start, failed=failed):
            start.wait()
            try:
                table._commit(held.withColumn("tier", F.lit(k)), now + 1, schema)
            except RuntimeError as e:
                failed.append((k, str(e)))

        writers = [threading.Thread(target=write, args=(k,)) for k in range(2)]
        [w.start() for w in writers]
        [w.join() for w in writers]
        assert len(failed) == 1 and "another writer" in failed[0][1]
        assert table.version() == now + 1 and table.manifest().first()["tier"] == 1 - failed[0][0]
    assert table.read().count() == 1


def test_an_append_in_flight_survives_a_vacuum(spark, tmp_path):
    table = compaction.ShardedTable(spark, str(tmp_path / "t"))
    table.append(docs(spark, [(1, "a", "s")], 1))
    docs(spark, [(2, "b", "s")], 1).write.parquet(str(tmp_path / "t" / "data" / "flight"))
    table.vacuum()
    assert (tmp_path / "t" / "data" / "flight").exists()


def test_compaction_of_little(spark, tmp_path):
    table = compaction.ShardedTable(spark, str(tmp_path / "t"))
    assert table.version() == 0
    table.append(docs(spark, [], 1))
    assert table.read().count() == 0 and table.compact() == 1
    table.append(docs(spark, [(1, "a", "s")], 1))
    assert table.compact() == table.version() == 2
    table.append(docs(spark, [], 1))
    assert table.read().count() == 1
    with pytest.raises(ValueError, match="columns"):
        table.append(spark.range(1))


def test_compacted(spark, tmp_path):
    rows = some_rows(random.Random(3), 400, 300) + [(1, "again", "s"), (1, "again", "s"), (2, "long " * 500_000, None)]
    frame = docs(spark, rows).withColumnRenamed("target", "_shard").withColumnRenamed("size", "_batch").withColumnRenamed("s", "_path")
    got = compaction.compacted(frame, str(tmp_path / "t"), target_bytes=100_000).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(k) for k, _, _ in rows)
    shards = {}
    for r in got:
        shards.setdefault((r["shard"], r["shard_rows"]), []).append(r["doc_id"])
    assert all(len(ids) == n for (_, n), ids in shards.items()) and len({s for s, _ in shards}) == len(shards)
    none = compaction.compacted(docs(spark, []), str(tmp_path / "none"))
    assert none.count() == 0 and none.columns == ["doc_id", "shard", "shard_rows", "shard_bytes", "tier", "version"]


def test_pipeline(spark, data):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    documents = spark.read.parquet(f"{data}/documents.parquet")
    docs, names = documents, [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality classifier", "exact dedup", "SimHash near-dedup", "mixing sources to target weights", "packing"]
    from vitrine.llm._shared import materialize

    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, materialize(stage(spark, docs, data), "stage")
        assert docs.columns == documents.columns
        if not name.startswith("mixing"):
            assert docs.exceptAll(before).isEmpty()
        if name == "exact dedup":
            plain = [re.sub(r"[\x20\x09-\x0D]", "", r["text"]) for r in docs.collect()]
            assert len(set(plain)) == len(plain) == len({re.sub(r"[\x20\x09-\x0D]", "", r["text"]) for r in before.collect()})
    last = corpus_pipeline.STAGES[-1][1](spark, docs, data)
    assert {r["doc_id"] for r in last.collect()} == {r["doc_id"] for r in docs.collect()}
    total = corpus_pipeline.run(spark, data).agg({"length": "sum"}).first()[0]
    assert total == last.agg({"length": "sum"}).first()[0]
