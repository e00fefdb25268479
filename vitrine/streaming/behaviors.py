"""The behaviour log as a stream: windows, sessions, duplicates, state, and an idempotent sink. An extension of our own."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import snapshots
from ..sources.model import KINDS

# tasks get the functions of this module by value, so that they need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Scores are whole numbers of ten-thousandths in a stream's state.
SCALE = 10_000
EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, folder: str, pattern: str = "*.parquet", files_per_trigger: int = 1) -> DataFrame:
    """Files of events as they arrive. Times are wall clock; watermarks need instants, so the session's zone is UTC."""
    stream = spark.readStream.schema(EVENTS.replace("ts timestamp", "ts timestamp_ntz"))
    return stream.option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_trigger).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def windowed(events: DataFrame, length: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Counts per window and type; works on streams and on tables."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    window = F.window("ts", length, slide) if slide else F.window("ts", length)
    return rows.groupBy(window.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Visits per user: a gap longer than this begins a new one."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


def without_repeats(events: DataFrame, late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def toggle_totals(events: DataFrame) -> DataFrame:
    """(user_id, image_id, kind, requests, active) of likes and favorites: a running count per key, kept by Spark itself."""
    rows = _as_behaviors(events).filter("kind in ('LIKE', 'FAVORITE')")
    counted = rows.groupBy("user_id", "image_id", "kind").agg(F.count(F.lit(1)).alias("requests"))
    return counted.withColumn("active", F.col("requests") % 2 == 1)


def _as_behaviors(events: DataFrame) -> DataFrame:
    """event_id, ts, user_id, kind, image_id of the raw events."""
    kind = F.element_at(F.create_map(*(F.lit(x) for pair in KINDS.items() for x in pair)), F.col("event_type"))
    return events.select(F.col("event_id").alias("id"), "ts", "user_id", kind.alias("kind"), F.get_json_object("props", "$.k").cast("long").alias("image_id"))


#: What waits for the watermark, column by column; at: microseconds of ts. Ids are text, as pandas makes doubles of longs with nulls.
_WAITING = "at array<long>, id array<string>, user_id array<string>, image_id array<long>, kind array<string>"


def in_event_order(events: DataFrame, late: str = "1 hour", shards: int = 200) -> DataFrame:
    """(id, ts, user_id, image_id, kind): each batch has the events that the watermark passed since the batch before.

    So all events of a batch are later than those of earlier batches, whatever order they arrived in, and an operator that
    takes a batch in the order (ts, id) gives what it gives over the whole table. Events that come more than late after
    the latest one are dropped, as a watermark does. An event waits in one of so many shards, dealt by the hash of its id:
    a hot user or image is in all of them, and a shard holds the events of the last late hours, then nothing. Events without
    time, image, or a kind that counts are left out.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        names = ["at", "id", "user_id", "image_id", "kind"]
        held = [pd.DataFrame({n: list(column) for n, column in zip(names, state.get)}, dtype=object)] if state.exists else []
        came = [b[names].astype(object) for b in batches]
        rows = pd.concat([*held, *came], ignore_index=True) if held or came else pd.DataFrame({n: [] for n in names}, dtype=object)
        passed = rows["at"].astype("int64") <= state.getCurrentWatermarkMs() * 1000
        rest = rows[~passed]
        if len(rest):
            state.update(tuple([None if pd.isna(v) else v for v in rest[n]] for n in names))
            state.setTimeoutTimestamp(int(rest["at"].min()) // 1000 + 1)
        elif state.exists:
            state.remove()
        yield rows[passed].astype({"at": "int64", "image_id": "int64"})

    rows = _as_behaviors(events.withWatermark("ts", late)).filter("kind is not null and image_id is not null and ts is not null")
    text = {"id": F.col("id").cast("string"), "user_id": F.col("user_id").cast("string")}
    keyed = rows.withColumns({"at": F.unix_micros("ts"), "shard": F.pmod(F.xxhash64("id"), F.lit(shards)), **text}).groupBy("shard")
    schema = "at long, id string, user_id string, image_id long, kind string"
    waited = keyed.applyInPandasWithState(step, schema, _WAITING, "append", GroupStateTimeout.EventTimeTimeout)
    return waited.select(F.col("id").cast("long"), F.timestamp_micros("at").cast("timestamp_ntz").alias("ts"), F.col("user_id").cast("long"), "image_id", "kind")


def keep_snapshot(ordered: DataFrame, target: str, checkpoint: str):
    """Advance the snapshot below target by each batch of in_event_order: toggles, counters and clamped scores so far.

    A batch's events are written before they are counted, and a batch that is run twice begins again from the snapshot
    before it. Of older snapshots the last one is kept.
    """
    spark = ordered.sparkSession

    def put(batch: DataFrame, number: int) -> None:
        folder = f"{target}/events/batch={number}"
        batch.write.mode("overwrite").parquet(folder)
        rows = spark.read.schema(batch.schema).parquet(folder)
        if rows.isEmpty():
            return
        known = [n for n in _numbers(spark, target) if n < number]
        before = snapshots.load(spark, f"{target}/state/batch={known[-1]}") if known else snapshots.empty(spark)
        last = rows.agg(F.max(F.to_date("ts"))).first()[0]
        _delete(spark, f"{target}/state/batch={number}")
        snapshots.save(snapshots.advance(before, rows, last), f"{target}/state/batch={number}")
        for n in known[:-1]:
            _delete(spark, f"{target}/state/batch={n}")

    return ordered.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_snapshot(spark: SparkSession, target: str) -> snapshots.Snapshot:
    known = _numbers(spark, target)
    return snapshots.load(spark, f"{target}/state/batch={known[-1]}") if known else snapshots.empty(spark)


def _numbers(spark: SparkSession, target: str) -> list[int]:
    """The batches with a whole snapshot, in order; keep_snapshot leaves two at most."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{target}/state/batch=*/cut/_SUCCESS")
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return sorted(int(f.getPath().getParent().getParent().getName().split("=")[1]) for f in found or [])


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def exposures(events: DataFrame, within: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(id, user_id, image_id, ts, click_id, clicked_at): every view once, with its user's first click on the image within that time.

    A join of two streams by time bounds, so that both sides' state ends with the watermark; views without a click come out
    with nulls when none can come any more. recsys.exposures gives the same over a table.
    """
    rows = _as_behaviors(events.withWatermark("ts", late))
    views = rows.filter("kind = 'VIEW'").drop("kind")
    clicks = rows.filter("kind = 'CLICK'").select(F.col("id").alias("click_id"), F.col("ts").alias("clicked_at"), F.col("user_id").alias("u"), F.col("image_id").alias("i"))
    bounds = F.col("clicked_at").between(F.col("ts"), F.col("ts") + F.expr(f"interval {within}"))
    joined = views.join(clicks, (F.col("user_id") == F.col("u")) & (F.col("image_id") == F.col("i")) & bounds, "left")
    first = joined.groupBy("id", "user_id", "image_id", "ts").agg(F.min(F.struct("clicked_at", "click_id")).alias("hit"))
    return first.select("id", "user_id", "image_id", "ts", "hit.click_id", "hit.clicked_at")


def clamped_totals(effects: DataFrame) -> DataFrame:
    """(image_id, events, hot_score) after each batch of effects (id, ts, image_id, delta in units of SCALE).

    State per image: the sum so far and the least one, whose difference is the score that may not fall below 0. Sums of a
    batch are added at once; effects count in the order (ts, id) within a batch, and batches as they arrive; keep_snapshot
    takes them in the order of events.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values(["ts", "id"])
        total, least, n = state.get if state.exists else (0, 0, 0)
        walk = total + rows["delta"].cumsum()
        total, least, n = int(walk.iloc[-1]), min(least, int(walk.min())), n + len(rows)
        state.update((total, least, n))
        yield pd.DataFrame({"image_id": [key[0]], "events": [n], "score": [total - least]})

    held = "total long, least long, n long"
    found = effects.groupBy("image_id").applyInPandasWithState(step, "image_id long, events long, score long", held, "update", GroupStateTimeout.NoTimeout)
    return found.select("image_id", "events", (F.col("score") / SCALE).cast("decimal(12,4)").alias("hot_score"))


def write_batches(stream: DataFrame, target: str, checkpoint: str):
    """Append each batch to a folder of its own number, so that a batch which is run twice is written once."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
