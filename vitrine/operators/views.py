"""Denormalised views: images with author and topics, comments with parents, tags, categories."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import has_text
from ..plans.session import discard, stored


def bindings(attempts: DataFrame) -> DataFrame:
    """A repeated binding is ignored."""
    return attempts.distinct()


def topic_lists(bound: DataFrame, topics: DataFrame) -> DataFrame:
    """Per image the names of its topics, hottest first, then by id."""
    named = bound.join(topics, bound["topic_id"] == topics["id"]).select("image_id", F.struct((-F.col("hot_score")).alias("less"), F.col("id"), F.col("name")).alias("t"))
    return named.groupBy("image_id").agg(F.transform(F.array_sort(F.collect_list("t")), lambda t: t["name"]).alias("topics"))


def image_views(images: DataFrame, users: DataFrame, lists: DataFrame, reason: str) -> DataFrame:
    """List views: a missing author is null, missing topics are an empty list, the first topic names the channel."""
    names = users.select(F.col("id").alias("uid"), "nickname")
    joined = images.join(names, F.col("author_id") == F.col("uid"), "left").join(lists.withColumnRenamed("image_id", "iid"), F.col("id") == F.col("iid"), "left")
    topics = F.coalesce("topics", F.array().cast("array<string>"))
    asset = F.struct(F.lit(0).alias("sort_order"), F.concat(F.lit("/media/"), F.col("id")).alias("url"))
    return joined.select(
        "id", "author_id", "nickname", "hot_score", "published_at", topics.alias("topics"), F.coalesce(F.get(topics, F.lit(0)), F.lit("recommend")).alias("channel"), F.lit(reason).alias("reason"), F.array(asset).alias("assets")
    )


def full_views(images: DataFrame, users: DataFrame, lists: DataFrame, reason: str) -> DataFrame:
    """Views with all that a page shows: author, topics, files, addresses and counters.

    A missing author is null; a blank thumbnail address gives way to the file's; the one asset comes first. The favorite
    count stands for collections too.
    """
    names = users.select(F.col("id").alias("uid"), F.struct("id", "nickname").alias("author"))
    joined = images.join(names, F.col("author_id") == F.col("uid"), "left").join(lists.withColumnRenamed("image_id", "iid"), F.col("id") == F.col("iid"), "left")
    topics = F.coalesce("topics", F.array().cast("array<string>"))
    first = F.coalesce(F.get(topics, F.lit(0)), F.lit("recommend"))
    asset = F.struct("id", "object_key", F.col("file_url").alias("url"), "file_type", F.col("thumbnail_url").alias("thumb_url"), "width", "height", "file_size", "hash", F.lit(0).alias("sort_order"))
    return joined.select(
        "id", "author", "title", "content", topics.alias("topics"), first.alias("topic"), first.alias("channel"), "post_type",
        F.array(asset).alias("assets"), F.array(F.struct(F.col("file_url").alias("url"), "width", "height")).alias("sources"),
        F.col("file_url").alias("cover_url"), has_text(F.col("thumbnail_url"), F.col("file_url")).alias("thumb_url"),
        "like_count", "favorite_count", F.col("favorite_count").alias("collect_count"), "comment_count", "share_count", "view_count", F.lit(reason).alias("reason"), "published_at",
    )


def lookup(rows: DataFrame, **keys: object) -> DataFrame:
    """The row whose columns have these values, a null being a value like any other; of several that of the least id."""
    for column, value in keys.items():
        rows = rows.filter(F.col(column).eqNullSafe(F.lit(value)))
    return rows.orderBy("id").limit(1)


def lookup_each(asked: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """asked (keys and others) with the id of the row of the same keys, nulls included; of several the least, null if there is none."""
    least = rows.groupBy(*(F.col(k).alias(f"_{k}") for k in keys)).agg(F.min("id").alias("id"))
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys))
    return asked.join(least, same, "left").drop(*(f"_{k}" for k in keys))


def single_view(images: DataFrame, users: DataFrame, image_id: int) -> DataFrame:
    """One image with its author; without the author there is no view."""
    names = users.select(F.col("id").alias("uid"), "nickname")
    return images.filter(F.col("id") == image_id).join(names, F.col("author_id") == F.col("uid")).drop("uid")


def latest_tags(writes: DataFrame) -> DataFrame:
    """Upserts of (image, tag): the largest confidence ever written, the source of the last write."""
    return writes.groupBy("image_id", "tag_id").agg(F.max("confidence").alias("confidence"), F.max_by("source", "seq").alias("source"))


def tag_rows(assigned: DataFrame, tags: DataFrame, *, by_name: bool = False) -> DataFrame:
    """Tag assignments with vocabulary columns and their place on the image: most confident first (not if by name), then type, name, id."""
    rows = assigned.join(tags, assigned["tag_id"] == tags["id"]).drop("id")
    order = Window.partitionBy("image_id").orderBy(*([] if by_name else [F.desc("confidence")]), "type", "name", "tag_id")
    return rows.withColumn("position", F.row_number().over(order))


def tags_by_type(tags: DataFrame, kind: str | None, size: int) -> DataFrame:
    """By type and name; a blank type means all types."""
    rows = tags.filter(F.col("type") == kind) if kind and kind.strip() else tags
    return rows.orderBy("type", "name", "id").limit(size)


def comment_order() -> list[Column]:
    return [F.desc("created_at"), F.desc("id")]


def comment_views(comments: DataFrame, users: DataFrame | None = None) -> DataFrame:
    """Comments with their parent's author and text, which may be hidden or of another image.

    With users also nickname of the author and reply_to, that of the parent's author; null where they are unknown.
    """
    also = [F.col("author_id").alias("parent_author_id")] if users is not None else []
    parent = comments.select(F.col("id").alias("pid"), F.col("author").alias("parent_author"), F.col("content").alias("parent_content"), *also)
    joined = comments.join(parent, F.col("parent_id") == F.col("pid"), "left").drop("pid")
    if users is None:
        return joined
    for key, name in (("author_id", "nickname"), ("parent_author_id", "reply_to")):
        joined = joined.join(users.select(F.col("id").alias("uid"), F.col("nickname").alias(name)), F.col(key) == F.col("uid"), "left").drop("uid")
    return joined


def _jumped(state: DataFrame, carried: list[str]) -> DataFrame:
    """state (id, up and carried columns, which describe the way from below up to id) when no round of jumping finishes a member.

    In a round every member takes over its up's up, so that ways double and rounds are as many as the depth has binary
    digits; carried arrays are joined and numbers added. Members of cycles keep an up. Each round is a table in the shared
    folder that is deleted when the next one is there.
    """
    state = stored(state)
    open_ = state.filter("up is not null").count()
    while open_:
        above = state.select(F.col("id").alias("_id"), F.col("up").alias("_up"), *(F.col(c).alias(f"_{c}") for c in carried))
        joined = state.join(above, F.col("up") == F.col("_id"), "left")
        longer = [F.when(F.col("_id").isNull(), F.col(c)).otherwise(F.concat(f"_{c}", c) if kind.startswith("array") else F.col(f"_{c}") + F.col(c)).alias(c) for c, kind in state.select(*carried).dtypes]
        after = stored(joined.select("id", F.col("_up").alias("up"), *longer))
        discard(state)
        state, before, open_ = after, open_, after.filter("up is not null").count()
        if open_ == before:
            break
    return state


def category_tree(categories: DataFrame) -> DataFrame:
    """id, parent_id, name, depth, path (of names), sort_path (of sort_no and id): in the order of sort_path it is depth first.

    Siblings are in the order of sort_no (a null is 0) and id, whatever their signs and digits. A category whose parent is
    unknown is a root; members of a cycle, and what hangs from them, are reached from no root and are left out. Only
    categories with children take part in the rounds, first to find out which are reached, then with their paths; all others
    are joined to their parents once, so that a category may have any number of children. Ids are unique.
    """
    key = F.struct(F.coalesce("sort_no", F.lit(0)).cast("long").alias("sort_no"), F.col("id").alias("id"))
    nodes = categories.select("id", "parent_id", "name", key.alias("key"))
    parents = nodes.filter("parent_id is not null").select(F.col("parent_id").alias("id")).distinct()
    inner = nodes.join(parents, "id", "left_semi")
    known = inner.select(F.col("id").alias("up"))
    linked = inner.join(known, F.col("parent_id") == F.col("up"), "left")
    reached = _jumped(linked.select("id", "up", F.lit(1).alias("depth")), ["depth"])
    rooted = linked.join(reached.filter("up is null").select("id"), "id", "left_semi")
    paths = _jumped(rooted.select("id", "up", F.array("name").alias("names"), F.array("key").alias("keys")), ["names", "keys"])
    discard(reached)
    above = paths.select(F.col("id").alias("up"), F.col("names").alias("up_names"), F.col("keys").alias("up_keys"))
    hung = nodes.join(above, F.col("parent_id") == F.col("up"), "left")
    # a known parent without a path is reached from no root; members of a cycle have such a parent
    lost = known.join(paths.select(F.col("id").alias("up")), "up", "left_anti").select(F.col("up").alias("parent_id"))
    rows = hung.join(lost, "parent_id", "left_anti")
    none = lambda c, kind: F.coalesce(F.col(c), F.array().cast(kind))
    names, keys = F.concat(none("up_names", "array<string>"), F.array("name")), F.concat(none("up_keys", dict(paths.dtypes)["keys"]), F.array("key"))
    return rows.select("id", "parent_id", "name", (F.size(names) - 1).alias("depth"), F.array_join(names, " > ").alias("path"), keys.alias("sort_path"))


def orphans(categories: DataFrame) -> DataFrame:
    """Categories that name a parent which doesn't exist."""
    known = categories.select(F.col("id").alias("parent_id"))
    return categories.filter("parent_id is not null").join(known, "parent_id", "left_anti")
