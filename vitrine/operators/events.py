"""State from the behaviour log: toggles, counters, clamped scores, follows.

The log is immutable and in the order (ts, id). A score that may not fall below 0 is a reflected walk: the sum so far less
the least sum so far if that is negative. Sums and least sums of days combine, so an image with most of the events is
split into days instead of being walked by one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import has_text

#: What an event adds to the score (fixed values); toggles subtract it when they are undone.
SCORES = {"VIEW": "0.08", "CLICK": "0.08", "SHARE": "1.2", "LIKE": "1.6", "FAVORITE": "2.2", "COMMENT": "1.3"}
TOGGLES = ("LIKE", "FAVORITE")


def toggles(log: DataFrame) -> DataFrame:
    """LIKE and FAVORITE events with active: whether the state is on after them, as the n-th request turns it on if n is odd."""
    order = Window.partitionBy("user_id", "image_id", "kind").orderBy("ts", "id")
    rows = log.filter(F.col("kind").isin(*TOGGLES))
    return rows.withColumn("active", F.row_number().over(order) % 2 == 1)


def toggle_state(log: DataFrame) -> DataFrame:
    """Per user, image and kind whether it is on: an odd number of requests. Sums before the shuffle; nothing is sorted."""
    rows = log.filter(F.col("kind").isin(*TOGGLES)).groupBy("user_id", "image_id", "kind")
    return rows.agg(F.count(F.lit(1)).alias("requests"), F.max("ts").alias("changed_at")).withColumn("active", F.col("requests") % 2 == 1)


def interaction_status(log: DataFrame) -> DataFrame:
    """Per user and image: liked, favorited."""
    state = toggle_state(log)
    return state.groupBy("user_id", "image_id").agg(
        F.bool_or(F.col("active") & (F.col("kind") == "LIKE")).alias("liked"), F.bool_or(F.col("active") & (F.col("kind") == "FAVORITE")).alias("favorited")
    )


def effects(log: DataFrame) -> DataFrame:
    """id, ts, image_id, kind, step (+1 or -1) and delta (of the score) of every event."""
    flipped = toggles(log).select("id", "ts", "image_id", "kind", F.when(F.col("active"), 1).otherwise(-1).alias("step"))
    plain = log.filter(~F.col("kind").isin(*TOGGLES)).select("id", "ts", "image_id", "kind", F.lit(1).alias("step"))
    return weighted(plain.unionByName(flipped))


def weighted(steps: DataFrame) -> DataFrame:
    """steps (kind and step, +1 or -1) with delta: what each adds to the score."""
    score = F.element_at(F.create_map(*(x for k, v in SCORES.items() for x in (F.lit(k), F.lit(v).cast("decimal(12,4)")))), F.col("kind"))
    return steps.withColumn("delta", (score * F.col("step")).cast("decimal(12,4)"))


def counters(log: DataFrame) -> DataFrame:
    """Per image: view, share, like and favorite counts; views and clicks both count as views."""
    count = lambda *kinds: F.sum(F.when(F.col("kind").isin(*kinds), F.col("step")).otherwise(0))
    return effects(log).groupBy("image_id").agg(
        count("VIEW", "CLICK").alias("view_count"),
        count("SHARE").alias("share_count"),
        F.greatest(F.lit(0).cast("long"), count("LIKE")).alias("like_count"),
        F.greatest(F.lit(0).cast("long"), count("FAVORITE")).alias("favorite_count"),
    )


def walk_sums(deltas: DataFrame, start: str = "0") -> DataFrame:
    """(image_id, total, least, events): the sum of an image's deltas, and the least of start plus the sum after each event."""
    wide = "decimal(22,4)"
    dated = deltas.withColumn("day", F.to_date("ts"))
    walk = F.sum("delta").over(Window.partitionBy("image_id", "day").orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    days = dated.withColumn("walk", walk).groupBy("image_id", "day").agg(F.sum("delta").alias("total"), F.min("walk").alias("least"), F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("total").over(Window.partitionBy("image_id").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast(wide))
    return days.withColumn("least", before + F.lit(start).cast(wide) + F.col("least")).groupBy("image_id").agg(F.sum("total").alias("total"), F.min("least").alias("least"), F.sum("n").alias("events"))


def clamped_score(deltas: DataFrame, start: str = "0") -> DataFrame:
    """Per image the score after all events, held at 0 from below after each: (image_id, hot_score, events).

    deltas: image_id, ts, id, delta. start: the score before the first event, 0 or more.
    """
    wide = "decimal(22,4)"
    joined = walk_sums(deltas, start)
    score = F.lit(start).cast(wide) + F.col("total") - F.least(F.lit(0).cast(wide), F.col("least"))
    return joined.select("image_id", score.cast("decimal(12,4)").alias("hot_score"), "events")


def follow_state(log: DataFrame) -> DataFrame:
    """Edges that hold: per pair the first follow after its last unfollow; follows while following change nothing."""
    order = F.struct("ts", "id")
    ended = log.filter("action = 'unfollow'").groupBy("follower", "followee").agg(F.max(order).alias("ended"))
    follows = log.filter("action = 'follow'").withColumn("at", order)
    live = follows.join(ended, ["follower", "followee"], "left").filter(F.col("ended").isNull() | (F.col("at") > F.col("ended")))
    return live.groupBy("follower", "followee").agg(F.min("ts").alias("since"), F.min_by("scene", "at").alias("scene"))


def user_stats(users: DataFrame, images: DataFrame, edges: DataFrame, most_images: int = 10_000) -> DataFrame:
    """Per user: image_count (stops at most_images), following_count, follower_count."""
    posted = images.groupBy(F.col("author_id").alias("u")).agg(F.count(F.lit(1)).alias("images"))
    out = edges.groupBy(F.col("follower").alias("u")).agg(F.count(F.lit(1)).alias("following"))
    back = edges.groupBy(F.col("followee").alias("u")).agg(F.count(F.lit(1)).alias("followers"))
    rows = users.select(F.col("id").alias("u")).join(posted, "u", "left").join(out, "u", "left").join(back, "u", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long"))
    return rows.select(
        F.col("u").alias("user_id"), F.least(zero("images"), F.lit(most_images).cast("long")).alias("image_count"), zero("following").alias("following_count"), zero("followers").alias("follower_count")
    )


def rejected(events: DataFrame, images: DataFrame, users: DataFrame) -> DataFrame:
    """Events on images that aren't there or by users that aren't, with the reason; the others take effect."""
    by_image = events.join(images.select(F.col("id").alias("image_id")), "image_id", "left_anti").withColumn("reason", F.lit("image"))
    there = events.join(images.select(F.col("id").alias("image_id")), "image_id", "left_semi")
    return by_image.unionByName(there.join(users.select(F.col("id").alias("user_id")), "user_id", "left_anti").select(*events.columns).withColumn("reason", F.lit("user")))


def rejected_follows(follows: DataFrame, users: DataFrame) -> DataFrame:
    """Requests (follower, followee) that don't count, with the reason: to follow oneself, then someone who isn't there."""
    own = F.col("follower") == F.col("followee")
    others = follows.filter(~own).join(users.select(F.col("id").alias("followee")), "followee", "left_anti").select(*follows.columns)
    return follows.filter(own).withColumn("reason", F.lit("self")).unionByName(others.withColumn("reason", F.lit("user")))


def behavior_rows(raw: DataFrame) -> DataFrame:
    """Behaviours as they are logged: a blank kind or scene is 'unknown'."""
    return raw.withColumns({c: has_text(F.col(c), F.lit("unknown")) for c in ("kind", "scene")})


def comment_counts(comments: DataFrame) -> DataFrame:
    """Per image the count of visible comments: one up for each, one down for each that was hidden, never below 0."""
    step = F.when(F.col("status") == "VISIBLE", 1).otherwise(0)
    return comments.groupBy("image_id").agg(F.greatest(F.lit(0).cast("long"), F.sum(step)).alias("comment_count"))


def with_clock(rows: DataFrame, column: str, clock: str) -> DataFrame:
    """rows as they are written: the time of the run, which is given, where the column is null."""
    return rows.withColumn(column, F.coalesce(column, F.to_timestamp_ntz(F.lit(clock))))


def cleaned_profiles(changes: DataFrame) -> DataFrame:
    """Changes of profiles (nickname, bio, avatar) as they count: trimmed, and no change where a nickname is blank."""
    return changes.withColumns({"nickname": F.nullif(F.trim("nickname"), F.lit("")), "bio": F.trim("bio"), "avatar": F.trim("avatar")})


def profiles(changes: DataFrame, columns: list[str]) -> DataFrame:
    """Per user (user_id, ts, id and columns) the latest value of each column that a change gives; null leaves it."""
    order = F.struct("ts", "id")
    return changes.groupBy("user_id").agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), order)).alias(c) for c in columns))


def checked(rows: DataFrame, limits: dict[str, int]) -> DataFrame:
    """rows with fault: the first text column that is blank or longer than its limit; null if all are in order."""
    faults = [F.when(F.length(F.trim(F.coalesce(F.col(c), F.lit("")))).between(1, 1 << 30) & (F.length(c) <= n), None).otherwise(F.lit(c)) for c, n in limits.items()]
    return rows.withColumn("fault", F.coalesce(*faults))
