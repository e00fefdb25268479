"""State of the behaviour log kept in snapshots, so that only what came since has to be read.

Everything that the log leads to is a state that two stretches of the log combine: requests of a toggle add up, and their
parity is whether it is on; counts add up; of the clamped score's walk the sums add up, and the least sum is the lesser of
the first stretch's and of the first's sum and the second's least. The log lies in folders by day; a snapshot holds all days
before its cut, and the days from the cut on are the tail, which alone is read.
"""

from __future__ import annotations

import datetime
import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .events import TOGGLES, walk_sums, weighted

TOGGLE_STATE = "user_id long, image_id long, kind string, requests long, changed_at timestamp_ntz"
IMAGE_STATE = "image_id long, views long, shares long, likes long, favorites long, total decimal(22,4), least decimal(22,4), events long"
_COUNTS = {"views": ("VIEW", "CLICK"), "shares": ("SHARE",), "likes": ("LIKE",), "favorites": ("FAVORITE",)}


@dataclass
class Snapshot:
    """State of all days before cut: TOGGLE_STATE and IMAGE_STATE."""

    toggles: DataFrame
    images: DataFrame
    cut: datetime.date


def empty(spark: SparkSession) -> Snapshot:
    return Snapshot(spark.createDataFrame([], TOGGLE_STATE), spark.createDataFrame([], IMAGE_STATE), datetime.date.min)


def write_log(log: DataFrame, folder: str) -> None:
    """Append events (id, ts, user_id, image_id, kind) to the folders of their days."""
    log.select("id", "ts", "user_id", "image_id", "kind", F.to_date("ts").alias("day")).write.mode("append").partitionBy("day").parquet(folder)


def days(spark: SparkSession, folder: str, start: datetime.date, stop: datetime.date | None = None) -> DataFrame:
    """The log's days from start on and before stop; no other day's files are read."""
    date = lambda d: F.lit(d.isoformat()).cast("date")
    rows = spark.read.parquet(folder).filter(F.col("day") >= date(start))
    return rows if stop is None else rows.filter(F.col("day") < date(stop))


def advance(before: Snapshot, tail: DataFrame, cut: datetime.date) -> Snapshot:
    """The snapshot after tail, whose events (id, ts, user_id, image_id, kind) are all later than before's and earlier than cut.

    A toggle's sign needs how often it was requested before, which the snapshot has; a hot image is split into days as in
    clamped_score. Events of unknown kinds change nothing; without image or user they count as the full run counts them.
    """
    key = ["user_id", "image_id", "kind"]
    same = lambda a, b: (a["user_id"].eqNullSafe(b["u"])) & (a["image_id"].eqNullSafe(b["i"])) & (a["kind"] == b["k"])
    order = Window.partitionBy(*key).orderBy("ts", "id")
    flips = tail.filter(F.col("kind").isin(*TOGGLES)).withColumn("n", F.row_number().over(order))
    known = before.toggles.select(F.col("user_id").alias("u"), F.col("image_id").alias("i"), F.col("kind").alias("k"), "requests")
    turned = flips.join(known, same(flips, known), "left").withColumn("on", (F.col("n") + F.coalesce("requests", F.lit(0))) % 2 == 1)
    steps = turned.select("id", "ts", "image_id", "kind", F.when(F.col("on"), 1).otherwise(-1).alias("step"))
    plain = tail.filter(~F.col("kind").isin(*TOGGLES)).select("id", "ts", "image_id", "kind", F.lit(1).alias("step"))
    moved = weighted(plain.unionByName(steps))

    requests = flips.groupBy(*key).agg(F.count(F.lit(1)).alias("requests"), F.max("ts").alias("changed_at"))
    toggles = before.toggles.unionByName(requests).groupBy(*key).agg(F.sum("requests").alias("requests"), F.max("changed_at").alias("changed_at"))

    counted = moved.groupBy("image_id").agg(*(F.sum(F.when(F.col("kind").isin(*kinds), F.col("step")).otherwise(0)).alias(name) for name, kinds in _COUNTS.items()))
    walked = walk_sums(moved)
    new = counted.join(walked.withColumnRenamed("image_id", "w"), F.col("image_id").eqNullSafe(F.col("w"))).drop("w")
    both = before.images.withColumn("part", F.lit(0)).unionByName(new.select(*before.images.columns).withColumn("part", F.lit(1)))
    first = lambda c: F.coalesce(F.sum(F.when(F.col("part") == 0, F.col(c))), F.lit(0).cast("decimal(22,4)"))
    least = F.least(F.min(F.when(F.col("part") == 0, F.col("least"))), first("total") + F.min(F.when(F.col("part") == 1, F.col("least"))))  # of nulls the other
    sums = [F.sum(c).cast("long").alias(c) for c in (*_COUNTS, "events")]
    images = both.groupBy("image_id").agg(*sums, F.sum("total").cast("decimal(22,4)").alias("total"), least.cast("decimal(22,4)").alias("least"))
    return Snapshot(toggles, images.select(*before.images.columns), cut)


def save(snapshot: Snapshot, folder: str) -> None:
    """Write to a new folder; the cut comes last, so that a snapshot without it is none."""
    for name in ("toggles", "images"):
        getattr(snapshot, name).write.parquet(f"{folder}/{name}")
    spark = snapshot.images.sparkSession
    spark.createDataFrame([(json.dumps({"cut": snapshot.cut.isoformat()}),)], "value string").coalesce(1).write.text(f"{folder}/cut")


def load(spark: SparkSession, folder: str) -> Snapshot:
    cut = json.loads(spark.read.text(f"{folder}/cut").first()["value"])["cut"]
    return Snapshot(spark.read.schema(TOGGLE_STATE).parquet(f"{folder}/toggles"), spark.read.schema(IMAGE_STATE).parquet(f"{folder}/images"), datetime.date.fromisoformat(cut))


def toggle_state(snapshot: Snapshot) -> DataFrame:
    return snapshot.toggles.withColumn("active", F.col("requests") % 2 == 1)


def counters(snapshot: Snapshot) -> DataFrame:
    """As events.counters gives for the whole log."""
    held = lambda c, name: F.greatest(F.lit(0).cast("long"), F.col(c)).alias(name)
    return snapshot.images.select("image_id", F.col("views").alias("view_count"), F.col("shares").alias("share_count"), held("likes", "like_count"), held("favorites", "favorite_count"))


def scores(snapshot: Snapshot) -> DataFrame:
    """As events.clamped_score gives for the whole log."""
    score = F.col("total") - F.least(F.lit(0).cast("decimal(22,4)"), F.col("least"))
    return snapshot.images.select("image_id", score.cast("decimal(12,4)").alias("hot_score"), "events")
