"""Recommendation, as the roadmap plans it: recall channels, mixing, rates, ranking. Weights are our own."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _placed(rows: DataFrame, k: int, *order: Column) -> DataFrame:
    """The first k rows as (id, place); each task keeps k of them."""
    return rows.orderBy(*order).limit(k).withColumn("place", F.row_number().over(Window.orderBy(*order))).select("id", "place")


def same_tags(images: DataFrame, tagged: DataFrame, liked: DataFrame, k: int) -> DataFrame:
    """(id, place): images that share most tags (image_id, tag_id) with the liked ones (id), which are left out."""
    mine = tagged.join(liked.select(F.col("id").alias("image_id")), "image_id", "left_semi").select("tag_id").distinct()
    shared = tagged.join(mine, "tag_id", "left_semi").select("image_id", "tag_id").distinct().groupBy(F.col("image_id").alias("id")).agg(F.count(F.lit(1)).alias("shared"))
    return _placed(shared.join(liked, "id", "left_anti").join(images, "id"), k, F.desc("shared"), F.desc("hot_score"), F.asc("id"))


def like_the_last(images: DataFrame, log: DataFrame, k: int) -> DataFrame:
    """(id, place): the nearest ids to that of the last event of log (image_id, ts, id), hottest first among equally near ones."""
    last = log.agg(F.max_by("image_id", F.struct("ts", "id")).alias("seed"))
    rows = images.join(F.broadcast(last), F.col("id") != F.col("seed")).withColumn("distance", F.abs(F.col("id") - F.col("seed")))
    return _placed(rows, k, F.asc("distance"), F.desc("hot_score"), F.asc("id"))


def by_interest(images: DataFrame, bound: DataFrame, weights: DataFrame, k: int, topics: int = 10) -> DataFrame:
    """(id, place): images by the summed weight of their topics (image_id, topic_id) among a user's heaviest ones.

    weights: image_id and delta of the user's events; a topic weighs what the events on its images add up to.
    """
    own = bound.join(weights, "image_id").groupBy("topic_id").agg(F.sum("delta").alias("weight"))
    heaviest = own.orderBy(F.desc("weight"), "topic_id").limit(topics)
    summed = bound.join(F.broadcast(heaviest), "topic_id").groupBy(F.col("image_id").alias("id")).agg(F.sum("weight").alias("weight"))
    return _placed(summed.join(images, "id"), k, F.desc("weight"), F.asc("id"))


def behavior_rates(log: DataFrame) -> DataFrame:
    """Per image of log (image_id, kind, duration): exposures, clicks, details, likes, favorites and the mean dwell in whole units.

    A view without a click after it counts as an exposure like any other; dwell is that of views with a duration.
    """
    count = lambda kind: F.sum(F.when(F.col("kind") == kind, 1).otherwise(0))
    dwell = F.sum(F.when(F.col("kind") == "VIEW", F.col("duration"))) / F.count(F.when(F.col("kind") == "VIEW", F.col("duration")))
    return log.groupBy("image_id").agg(count("VIEW").alias("exposures"), count("CLICK").alias("clicks"), count("LIKE").alias("likes"), count("FAVORITE").alias("favorites"), F.floor(dwell).alias("dwell"))


def exposures(log: DataFrame, within: int = 1800) -> DataFrame:
    """(id, user_id, image_id, ts, click_id, clicked_at): every view with its user's first click on the image within so many seconds.

    Both ends count, and of clicks at one time the least id. Time is cut into spans of that many seconds, and a click goes to
    its span and to the one before: a view finds it by one sort of its span, without pairs, and a user and image with a
    third of all events are dealt by time. Views without user, image or time have no click.
    """
    seconds = F.timestamp_diff("SECOND", F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00")), F.col("ts").cast("timestamp_ntz"))
    rows = log.filter("kind in ('VIEW', 'CLICK')").select("id", "ts", "user_id", "image_id", (F.col("kind") == "VIEW").alias("view"), F.floor(seconds / within).alias("span"))
    views = rows.filter("view")
    clicks = rows.filter("not view").withColumn("span", F.explode(F.array("span", F.col("span") - 1)))
    back = Window.partitionBy("user_id", "image_id", "span").orderBy(F.desc("ts"), "view", F.desc("id"))
    hit = F.last(F.when(~F.col("view"), F.struct(F.col("id").alias("click_id"), F.col("ts").alias("clicked_at"))), ignorenulls=True)
    found = views.unionByName(clicks).withColumn("hit", hit.over(back.rowsBetween(Window.unboundedPreceding, Window.currentRow))).filter("view")
    known = F.col("user_id").isNotNull() & F.col("image_id").isNotNull()
    held = F.when(known & (F.col("hit.clicked_at") <= F.col("ts") + F.make_dt_interval(secs=F.lit(within))), F.col("hit"))
    return found.select("id", "user_id", "image_id", "ts", held["click_id"].alias("click_id"), held["clicked_at"].alias("clicked_at"))


#: What interaction_rates gives beside the image.
RATES = ["liked", "shared", "clicked"]


def interaction_rates(log: DataFrame) -> DataFrame:
    """(image_id, liked, shared, clicked): logarithms of what views led to, one of two views added so that few views say little."""
    count = lambda *kinds: F.sum(F.when(F.col("kind").isin(*kinds), 1).otherwise(0))
    rate = lambda *kinds: F.log((count(*kinds) + 1) / (count("VIEW") + 2))
    return log.groupBy("image_id").agg(rate("LIKE", "FAVORITE").alias("liked"), rate("SHARE").alias("shared"), rate("CLICK").alias("clicked"))


def interaction_trials(log: DataFrame, cut: str, within: int = 1800) -> DataFrame:
    """(image_id, RATES, exposures, hits): rates of an image before the cut, and from it on its views and those with a click in time.

    So a rate never knows the clicks that it is to foretell. Images seen first after the cut have null rates.
    """
    at = F.lit(cut).cast("timestamp_ntz")
    later = exposures(log.filter(F.col("ts") >= at), within).groupBy("image_id").agg(F.count(F.lit(1)).alias("exposures"), F.count("click_id").alias("hits"))
    return later.join(interaction_rates(log.filter(F.col("ts") < at)), "image_id", "left")


def mix_channels(channels: dict[str, DataFrame], seen: DataFrame, size: int) -> DataFrame:
    """(id, channel, turn, slot): channels (id, place) dealt in turn, without seen ids; an id counts in its first turn.

    Turn n has the n-th of each channel, channels in the order given.
    """
    every = reduce(DataFrame.unionByName, (c.select("id", "place", F.lit(k).alias("c"), F.lit(name).alias("channel")) for k, (name, c) in enumerate(channels.items())))
    left = every.join(seen.select("id"), "id", "left_anti")
    first = F.row_number().over(Window.partitionBy("id").orderBy("place", "c"))
    once = left.withColumn("n", first).filter("n = 1").withColumn("turn", F.row_number().over(Window.partitionBy("c").orderBy("place")))
    shown = once.orderBy("turn", "c").limit(size)
    return shown.withColumn("slot", F.row_number().over(Window.orderBy("turn", "c"))).select("id", "channel", "turn", "slot")


def click_rates(log: DataFrame) -> DataFrame:
    """Per image: views, clicks and clicks per thousand views, rounded down; null without views."""
    count = lambda kind: F.sum(F.when(F.col("kind") == kind, 1).otherwise(0))
    rows = log.groupBy("image_id").agg(count("VIEW").alias("views"), count("CLICK").alias("clicks"))
    return rows.withColumn("per_mille", F.when(F.col("views") > 0, F.floor(F.col("clicks") * 1000 / F.col("views"))))


def ranked(items: DataFrame, weights: dict[str, float], now: str, half_life_days: float = 7.0) -> DataFrame:
    """items (id, published_at and the weighted columns, each from 0 to 1) by their weighted sum with freshness added."""
    age = (F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp(F.col("published_at").cast("timestamp"))) / 86_400
    fresh = F.pow(F.lit(0.5), F.greatest(age, F.lit(0)) / half_life_days)
    score = sum((F.coalesce(F.col(c), F.lit(0.0)) * w for c, w in weights.items() if c != "freshness"), fresh * weights.get("freshness", 0.0))
    return items.withColumn("score", F.round(score, 6)).orderBy(F.desc("score"), "id")
