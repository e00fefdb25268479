"""Streams give what the same operator gives over the whole table."""

import datetime
import os
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from vitrine.operators import events, recsys, snapshots
from vitrine.sources.model import Model
from vitrine.streaming import behaviors


@pytest.fixture
def arrived(spark, data, tmp_path):
    """The events in three files, by time."""
    rows = spark.read.parquet(f"{data}/events.parquet").orderBy("ts")
    for k, part in enumerate(rows.randomSplit([1.0, 1.0, 1.0], 1)):
        part.coalesce(1).write.parquet(str(tmp_path / f"in{k}"))
    os.mkdir(tmp_path / "in")
    for k in range(3):
        for f in os.listdir(tmp_path / f"in{k}"):
            if f.endswith(".parquet"):
                os.rename(tmp_path / f"in{k}" / f, tmp_path / "in" / f"{k}-{f}")
    return str(tmp_path / "in")


START = datetime.datetime(2024, 1, 1)


def files(spark, folder, rows):
    """Rows (id, minutes, user, type, image) as one file each list, in the order of the lists."""
    os.makedirs(folder)
    for k, part in enumerate(rows):
        frame = [(i, START + datetime.timedelta(minutes=m), u, kind, 0.0, None if image is None else f'{{"k": {image}}}') for i, m, u, kind, image in part]
        spark.createDataFrame(frame, behaviors.EVENTS.replace("ts timestamp", "ts timestamp_ntz")).coalesce(1).write.parquet(f"{folder}-{k}")
        name = next(f for f in os.listdir(f"{folder}-{k}") if f.endswith(".parquet"))
        os.rename(f"{folder}-{k}/{name}", f"{folder}/{k}-{name}")
        os.utime(f"{folder}/{k}-{name}", (1_700_000_000 + k, 1_700_000_000 + k))
    return str(folder)


def jumbled(seed, n=600):
    """Events that arrive up to 50 minutes late, in four files; half of them of one image. The last file's are far later."""
    rng = random.Random(seed)
    kinds = ["view", "click", "error", "purchase", "signup", "other"]
    rows = [(k, k + rng.random(), rng.choice([1, 2, None]), rng.choice(kinds), rng.choice([7, 7, 7, 1, 2, None])) for k in range(n)]
    rows += [(10_000 + k, 300.0, 1, "purchase", 7) for k in range(5)]  # at one time
    rows.sort(key=lambda r: r[1] + rng.random() * 50)
    size = len(rows) // 4 + 1
    return rows, [rows[k : k + size] for k in range(0, len(rows), size)] + [[(-1, 1e5, 9, k, 999) for k in ("view", "click")]]


def run(stream, mode, name):
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)


def test_windows_equal_the_batch(spark, data, arrived):
    table = spark.read.parquet(f"{data}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    got = run(behaviors.windowed(behaviors.read_events(spark, arrived), "1 hour", "30 minutes", "100 days"), "complete", "windows")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, behaviors.windowed(table, "1 hour", "30 minutes").collect()))


def test_sessions_equal_the_batch(spark, data, arrived):
    table = spark.read.parquet(f"{data}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    got = run(behaviors.sessions(behaviors.read_events(spark, arrived), late="100 days"), "complete", "visits")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, behaviors.sessions(table).collect()))


def test_toggles_and_repeats(spark, data, arrived):
    got = run(behaviors.toggle_totals(behaviors.read_events(spark, arrived)), "update", "toggles")
    last = got.groupBy("user_id", "image_id", "kind").agg(F.max("requests").alias("requests"), F.max_by("active", "requests").alias("active"))
    want = events.toggle_state(Model(spark, data).behaviors()).select("user_id", "image_id", "kind", "requests", "active")
    assert sorted(map(tuple, last.collect())) == sorted(map(tuple, want.collect()))
    assert {r["kind"] for r in last.collect()} == {"LIKE", "FAVORITE"}
    twice = behaviors.read_events(spark, arrived)
    assert run(behaviors.without_repeats(twice.unionAll(twice), "100 days"), "append", "once").count() == spark.read.parquet(f"{data}/events.parquet").count()


def test_events_in_any_order_give_the_snapshot_of_the_whole_log(spark, tmp_path):
    """Toggles, counters and clamped scores; batches run twice change nothing, and no state is left behind."""
    rows, parts = jumbled(5)
    source = files(spark, tmp_path / "in", parts)
    for _ in range(2):
        stream = behaviors.in_event_order(behaviors.read_events(spark, source), "1 hour", shards=3)
        q = behaviors.keep_snapshot(stream, str(tmp_path / "out"), str(tmp_path / "check"))
        q.awaitTermination()
    got = behaviors.latest_snapshot(spark, str(tmp_path / "out"))
    kinds = "case event_type when 'view' then 'VIEW' when 'click' then 'CLICK' when 'error' then 'SHARE' when 'purchase' then 'LIKE' when 'signup' then 'FAVORITE' end as kind"
    log = spark.read.parquet(source).selectExpr("event_id as id", "ts", "user_id", kinds, "cast(get_json_object(props, '$.k') as long) as image_id").filter("kind is not null and image_id is not null and id >= 0").cache()
    as_set = lambda df: sorted(map(str, df.collect()))
    assert as_set(snapshots.scores(got)) == as_set(events.clamped_score(events.effects(log)).select("image_id", "hot_score", "events"))
    assert as_set(snapshots.counters(got)) == as_set(events.counters(log))
    assert as_set(snapshots.toggle_state(got).select("user_id", "image_id", "kind", "requests", "active")) == as_set(events.toggle_state(log).select("user_id", "image_id", "kind", "requests", "active"))
    batches = spark.read.parquet(str(tmp_path / "out" / "events"))
    assert batches.count() == log.count() == batches.select("id").distinct().count()
    spans = [tuple(r) for r in batches.groupBy("batch").agg(F.min("ts"), F.max("ts")).orderBy("batch").collect()]
    assert len(spans) > 2 and all(a[2] < b[1] for a, b in zip(spans, spans[1:]))


def test_exposures_of_the_stream_equal_those_of_the_table(spark, tmp_path):
    _, parts = jumbled(11, 600)
    source = files(spark, tmp_path / "in", parts)
    got = run(behaviors.exposures(behaviors.read_events(spark, source), "30 minutes"), "append", "exposed").filter("id >= 0")
    rows = [r for part in parts[:-1] for r in part]
    table = spark.read.parquet(source).selectExpr("event_id as id", "ts", "user_id", "upper(event_type) as kind", "cast(get_json_object(props, '$.k') as long) as image_id")
    batch = {r["id"]: r["click_id"] for r in recsys.exposures(table, 1800).filter("id >= 0").collect()}
    want = {}
    for i, at, user, kind, image in rows:
        if kind == "view":
            hits = [(m, c) for c, m, u, k, im in rows if k == "click" and None not in (u, im) and (u, im) == (user, image) and at <= m <= at + 30]
            want[i] = min(hits)[1] if hits else None
    assert batch == want and len({v for v in want.values() if v is not None}) > 10
    found = [(r["id"], r["click_id"]) for r in got.collect()]
    assert len(found) == len(want) and dict(found) == want


def test_clamped_totals_of_batches_in_order_equal_the_table(spark, data, tmp_path):
    deltas = events.effects(Model(spark, data).behaviors())
    rows = deltas.select("id", F.col("ts").cast("timestamp").alias("ts"), "image_id", (F.col("delta") * behaviors.SCALE).cast("long").alias("delta"))
    rows = rows.withColumn("part", F.ntile(3).over(Window.orderBy("ts", "id")))
    os.mkdir(tmp_path / "in")
    for k in range(3):
        rows.filter(F.col("part") == k + 1).drop("part").coalesce(1).write.parquet(str(tmp_path / f"part{k}"))
        name = next(f for f in os.listdir(tmp_path / f"part{k}") if f.endswith(".parquet"))
        os.rename(tmp_path / f"part{k}" / name, tmp_path / "in" / f"{k}-{name}")
        os.utime(tmp_path / "in" / f"{k}-{name}", (1_700_000_000 + k, 1_700_000_000 + k))
    stream = spark.readStream.schema("id long, ts timestamp, image_id long, delta long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = run(behaviors.clamped_totals(stream), "update", "scores")
    last = got.groupBy("image_id").agg(F.max_by("hot_score", "events").alias("hot_score"), F.max("events").alias("events"))
    assert sorted(map(tuple, last.collect())) == sorted(map(tuple, events.clamped_score(deltas).collect()))


def test_sink_is_idempotent(spark, arrived, tmp_path, data):
    for _ in range(2):
        behaviors.write_batches(behaviors.read_events(spark, arrived), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == spark.read.parquet(f"{data}/events.parquet").count()
