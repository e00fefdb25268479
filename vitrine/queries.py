"""The queries over the driver's tables, each with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import queries_rules  # noqa: F401  (registers its own)
from .functions import media, text, urls
from .operators import curation, events, layout, logistic, postings, ranking, recsys, search, snapshots, taxonomy, vectors, views
from .plans.paging import DEFAULTS, Page, clamp_page, page_of
from .plans.session import new_folder
from .registry import ORACLES, QUERIES, query
from .sources.model import Model
from .streaming import behaviors

__all__ = ["ORACLES", "QUERIES"]

#: Parameters of the queries.
IMAGE, AUTHOR, KEYWORD, TOPIC_WORD, NOW = 5000, 7, "eau", "#Supplier#00000000 1", "2024-02-01 00:00:00"
HOST = "img.example.com"


def _day(column: str) -> Column:
    return F.date_format(column, "yyyy-MM-dd").alias(column)


# ranked retrieval

_FEED = "SELECT id, author_id, hot_score, strftime(published_at, '%Y-%m-%d') AS published_at FROM published"


@query(f"SELECT f.*, u.nickname FROM ({_FEED} ORDER BY hot_score DESC, published.published_at DESC, id DESC LIMIT 30) f LEFT JOIN users u ON u.id = f.author_id", decimal="hot_score")
def feed_home(m: Model) -> DataFrame:
    page = ranking.feed(m.published(), clamp_page(1, DEFAULTS["feed"], "feed")).select("id", "author_id", "hot_score", _day("published_at"))
    names = m.users().select(F.col("id").alias("author_id"), "nickname")
    return page.join(names, "author_id", "left")


@query(f"{_FEED} ORDER BY hot_score DESC, published.published_at DESC, id DESC LIMIT 60 OFFSET 120", decimal="hot_score")
def feed_page_n(m: Model) -> DataFrame:
    return ranking.feed(m.published(), clamp_page(3, 61, "feed")).select("id", "author_id", "hot_score", _day("published_at"))


@query("SELECT count(*) AS total FROM published")
def feed_total(m: Model) -> DataFrame:
    return m.published().agg(F.count(F.lit(1)).alias("total"))


@query(f"SELECT id, abs(id - {IMAGE}) AS distance, hot_score FROM published WHERE id <> {IMAGE} ORDER BY 2, hot_score DESC, id LIMIT 24", decimal="hot_score")
def similar_by_id(m: Model) -> DataFrame:
    return ranking.similar(m.published(), IMAGE, clamp_page(1, DEFAULTS["similar"], "similar")).select("id", "distance", "hot_score")


@query(f"SELECT count(*) AS total FROM published WHERE id <> {IMAGE}")
def similar_total(m: Model) -> DataFrame:
    return m.published().filter(F.col("id") != IMAGE).agg(F.count(F.lit(1)).alias("total"))


@query(f"SELECT id, strftime(published_at, '%Y-%m-%d') AS published_at FROM published WHERE author_id = {AUTHOR} ORDER BY published.published_at DESC, id DESC LIMIT 30")
def author_latest(m: Model) -> DataFrame:
    return ranking.author_latest(m.published(), AUTHOR, clamp_page(0, 30, "author")).select("id", _day("published_at"))


@query("""
SELECT author_id, id, CAST(row_number() OVER (PARTITION BY author_id ORDER BY published_at DESC, id DESC) AS INTEGER) AS position
FROM published QUALIFY position <= 3
""")
def author_topk_all(m: Model) -> DataFrame:
    return ranking.top_per_author(m.published(), 3).select("author_id", "id", "position")


_ATTEMPTS = "(SELECT topic_id, count(*) AS attempts FROM topic_attempts GROUP BY 1)"


def _attempts(m: Model) -> DataFrame:
    return m.topic_attempts().groupBy("topic_id").agg(F.count(F.lit(1)).alias("attempts"))


def _counted_topics(m: Model) -> DataFrame:
    counts = _attempts(m)
    return m.topics().join(counts, F.col("id") == F.col("topic_id"), "left").drop("topic_id").fillna(0, ["attempts"])


@query(f"SELECT id, name, hot_score, coalesce(attempts, 0) AS attempts FROM topics LEFT JOIN {_ATTEMPTS} ON topic_id = id ORDER BY hot_score DESC, 4 DESC, id LIMIT 20", decimal="hot_score")
def trending_topics(m: Model) -> DataFrame:
    return ranking.trending(m.topics(), _attempts(m), DEFAULTS["topics"]).select("id", "name", "hot_score", "attempts")


@query("SELECT id, nickname FROM users WHERE id IN (3, 5, 8, 13, 1000000)")
def users_by_ids(m: Model) -> DataFrame:
    ids = m.spark.createDataFrame([(3,), (5,), (8,), (13,), (1_000_000,)], "id long")
    return m.users().join(F.broadcast(ids), "id", "left_semi").select("id", "nickname")


@query("""
SELECT id, min(page_no) AS page_no FROM (
  (SELECT id, 0 AS page_no FROM published ORDER BY hot_score DESC, published_at DESC, id DESC LIMIT 30)
  UNION ALL (SELECT id, 1 FROM published ORDER BY hot_score DESC, published_at DESC, id DESC LIMIT 30 OFFSET 20)) GROUP BY id
""")
def page_merge(m: Model) -> DataFrame:
    pages = [ranking.feed(m.published(), Page(offset, 30)).select("id") for offset in (0, 20)]
    return ranking.merge_pages(pages, "id").select("id", "page_no")


@query("SELECT min(id) AS id FROM users WHERE nickname = 'Customer#000000007'")
def user_by_name(m: Model) -> DataFrame:
    return views.lookup(m.users(), nickname="Customer#000000007").select("id")


@query("SELECT min(id) AS id FROM topics WHERE name = 'Supplier#000000003'")
def topic_by_name(m: Model) -> DataFrame:
    return views.lookup(m.topics(), name="Supplier#000000003").select("id")


@query("SELECT min(id) AS id FROM categories WHERE name = 'ASIA' AND parent_id IS NULL")
def category_by_parent(m: Model) -> DataFrame:
    return views.lookup(m.categories(), name="ASIA", parent_id=None).select("id")


@query("""
SELECT DISTINCT a.name, coalesce(a.parent_id, -1) AS parent_id, coalesce(c.id, -1) AS id FROM (SELECT name, parent_id FROM categories UNION ALL SELECT name, NULL FROM categories) a
LEFT JOIN (SELECT name, parent_id, min(id) AS id FROM categories GROUP BY ALL) c ON c.name = a.name AND c.parent_id IS NOT DISTINCT FROM a.parent_id
""")
def categories_by_parent(m: Model) -> DataFrame:
    own = m.categories()
    asked = own.select("name", "parent_id").unionAll(own.select("name", F.lit(None).cast("long").alias("parent_id"))).distinct()
    return views.lookup_each(asked, own, ["name", "parent_id"]).fillna(-1, ["parent_id", "id"])


@query("SELECT t.type, t.name, min(t.id) AS id FROM tags t GROUP BY ALL")
def tags_by_type_and_name(m: Model) -> DataFrame:
    return views.lookup_each(m.tags().select("type", "name").distinct(), m.tags(), ["type", "name"])


@query("SELECT (SELECT count(*) FROM topics) AS topics, (SELECT count(*) FROM users) AS users")
def table_counts(m: Model) -> DataFrame:
    return m.topics().agg(F.count(F.lit(1)).alias("topics")).crossJoin(m.users().agg(F.count(F.lit(1)).alias("users")))  # one row each


@query(f"SELECT i.id, i.hot_score, u.nickname FROM images i JOIN users u ON u.id = i.author_id WHERE i.id = {IMAGE}", decimal="hot_score")
def single_view(m: Model) -> DataFrame:
    return views.single_view(m.images(), m.users(), IMAGE).select("id", "hot_score", "nickname")


# views

_LISTS = """(SELECT image_id, string_agg(name, '|' ORDER BY hot_score DESC, id) AS topics, first(name ORDER BY hot_score DESC, id) AS channel
  FROM (SELECT DISTINCT * FROM topic_attempts) b JOIN topics t ON t.id = b.topic_id GROUP BY 1)"""


@query(f"""
SELECT f.id, f.author_id, u.nickname, f.hot_score, coalesce(l.topics, '') AS topics, coalesce(l.channel, 'recommend') AS channel, 'hot' AS reason
FROM (SELECT * FROM published ORDER BY hot_score DESC, published_at DESC, id DESC LIMIT 30) f
LEFT JOIN users u ON u.id = f.author_id LEFT JOIN {_LISTS} l ON l.image_id = f.id
""", decimal="hot_score")
def feed_view(m: Model) -> DataFrame:
    page = ranking.feed(m.published(), clamp_page(1, 30, "feed"))
    bound = views.bindings(m.topic_attempts().join(page.select(F.col("id").alias("image_id")), "image_id", "left_semi"))
    rows = views.image_views(page, m.users(), views.topic_lists(bound, m.topics()), "hot")
    return rows.select("id", "author_id", "nickname", "hot_score", F.array_join("topics", "|").alias("topics"), "channel", "reason")


@query(f"""
SELECT f.id, u.nickname, title, content, coalesce(l.topics, '') AS topics, coalesce(l.channel, 'recommend') AS channel, post_type,
  f.id || ':' || object_key || ':' || file_url || ':' || file_type || ':' || coalesce(thumbnail_url, '-') || ':' || width || ':' || height || ':' || file_size || ':' || hash || ':0' AS assets,
  file_url || ':' || width || ':' || height AS sources, file_url AS cover_url, CASE WHEN trim(coalesce(thumbnail_url, '')) = '' THEN file_url ELSE thumbnail_url END AS thumb_url,
  like_count, favorite_count, favorite_count AS collect_count, comment_count, share_count, view_count, 'detail' AS reason
FROM image_details f LEFT JOIN users u ON u.id = f.author_id LEFT JOIN {_LISTS} l ON l.image_id = f.id WHERE status = 'PUBLISHED'
""")
def image_full_view(m: Model) -> DataFrame:
    lists = views.topic_lists(views.bindings(m.topic_attempts()), m.topics())
    rows = views.full_views(m.image_details().filter("status = 'PUBLISHED'"), m.users(), lists, "detail")
    shown = lambda a: F.concat_ws(":", a["id"], a["object_key"], a["url"], a["file_type"], F.coalesce(a["thumb_url"], F.lit("-")), a["width"], a["height"], a["file_size"], a["hash"], a["sort_order"])
    assets, sources = F.array_join(F.transform("assets", shown), "|"), F.array_join(F.transform("sources", lambda x: F.concat_ws(":", x["url"], x["width"], x["height"])), "|")
    counters = ["like_count", "favorite_count", "collect_count", "comment_count", "share_count", "view_count"]
    return rows.select("id", "author.nickname", "title", "content", F.array_join("topics", "|").alias("topics"), "channel", "post_type", assets.alias("assets"), sources.alias("sources"), "cover_url", "thumb_url", *counters, "reason")


@query(f"SELECT image_id, topics FROM {_LISTS}")
def image_topics_batch(m: Model) -> DataFrame:
    rows = views.topic_lists(views.bindings(m.topic_attempts()), m.topics())
    return rows.select("image_id", F.array_join("topics", "|").alias("topics"))


@query("SELECT topic_id, count(*) AS attempts, count(DISTINCT image_id) AS bindings FROM topic_attempts GROUP BY 1")
def topic_post_count(m: Model) -> DataFrame:
    return _bound_counts(m)


def _bound_counts(m: Model) -> DataFrame:
    pairs = m.topic_attempts().groupBy("topic_id", "image_id").agg(F.count(F.lit(1)).alias("n"))
    return pairs.groupBy("topic_id").agg(F.sum("n").alias("attempts"), F.count(F.lit(1)).alias("bindings"))


@query("SELECT topic_id, count(*) - count(DISTINCT image_id) AS drift FROM topic_attempts GROUP BY 1 HAVING count(*) > count(DISTINCT image_id)")
def topic_binding_drift(m: Model) -> DataFrame:
    return _bound_counts(m).select("topic_id", (F.col("attempts") - F.col("bindings")).alias("drift")).filter("drift > 0")


_LATEST = "(SELECT image_id, tag_id, max(confidence) AS confidence, max_by(source, seq) AS source FROM tag_writes GROUP BY ALL)"


@query(f"SELECT image_id, tag_id, confidence, source FROM {_LATEST}", decimal="confidence")
def tag_upsert(m: Model) -> DataFrame:
    return views.latest_tags(m.tag_writes())


@query(f"""
SELECT image_id, tag_id, type, name, confidence,
  CAST(row_number() OVER (PARTITION BY image_id ORDER BY confidence DESC, type, name, tag_id) AS INTEGER) AS position
FROM {_LATEST} JOIN tags ON tags.id = tag_id
""", decimal="confidence")
def image_tag_rows(m: Model) -> DataFrame:
    return views.tag_rows(views.latest_tags(m.tag_writes()), m.tags()).select("image_id", "tag_id", "type", "name", "confidence", "position")


@query(f"""
SELECT image_id, tag_id, CAST(row_number() OVER (PARTITION BY image_id ORDER BY type, name, tag_id) AS INTEGER) AS position FROM {_LATEST} JOIN tags ON tags.id = tag_id
""")
def image_tags_by_name(m: Model) -> DataFrame:
    return views.tag_rows(views.latest_tags(m.tag_writes()), m.tags(), by_name=True).select("image_id", "tag_id", "position")


@query("SELECT id, type, name FROM tags WHERE type = 'SMALL' ORDER BY type, name, id LIMIT 100")
def tags_by_type(m: Model) -> DataFrame:
    return views.tags_by_type(m.tags(), "SMALL", DEFAULTS["tags"])


@query("SELECT id, type, name FROM tags ORDER BY type, name, id LIMIT 500")
def tags_all(m: Model) -> DataFrame:
    return views.tags_by_type(m.tags(), " ", clamp_page(1, 1000, "tags").size)


@query("SELECT u.id, c.name AS category FROM users u LEFT JOIN categories c ON c.id = u.category_id")
def main_category(m: Model) -> DataFrame:
    names = m.categories().select(F.col("id").alias("category_id"), F.col("name").alias("category"))
    return m.users().join(names, "category_id", "left").select("id", "category")


def _shown_path() -> Column:
    return F.array_join(F.transform("sort_path", lambda k: F.concat(k["sort_no"].cast("string"), F.lit("."), k["id"].cast("string"))), "/").alias("sort_path")


@query("""+
tree AS (
  SELECT id, name, 0 AS depth, name AS path, sort_no || '.' || id AS sort_path FROM categories WHERE parent_id IS NULL
  UNION ALL SELECT c.id, c.name, t.depth + 1, t.path || ' > ' || c.name, t.sort_path || '/' || c.sort_no || '.' || c.id
  FROM categories c JOIN tree t ON c.parent_id = t.id)
SELECT id, name, depth, path, sort_path FROM tree
""")
def category_tree(m: Model) -> DataFrame:
    return views.category_tree(m.categories()).select("id", "name", "depth", "path", _shown_path())


@query("SELECT id, parent_id FROM categories WHERE id <> 1001 AND parent_id IS NOT NULL AND parent_id NOT IN (SELECT id FROM categories WHERE id <> 1001)")
def category_orphans(m: Model) -> DataFrame:
    return views.orphans(m.categories().filter("id <> 1001")).select("id", "parent_id")


@query("SELECT id, author, length(content) AS n FROM comments WHERE image_id = 3 AND status = 'VISIBLE' ORDER BY created_at DESC, id DESC LIMIT 20")
def comment_page(m: Model) -> DataFrame:
    rows = page_of(m.comments().filter("image_id = 3 and status = 'VISIBLE'"), views.comment_order(), clamp_page(1, DEFAULTS["comments"], "comments"))
    return rows.select("id", "author", F.length("content").cast("long").alias("n"))


@query("""
SELECT c.id, u.nickname, coalesce(c.parent_id, -1) AS parent_id, r.nickname AS reply_to, strftime(c.created_at, '%Y-%m-%d %H:%M') AS created_at
FROM comments c LEFT JOIN users u ON u.id = c.author_id LEFT JOIN comments p ON p.id = c.parent_id LEFT JOIN users r ON r.id = p.author_id WHERE c.status = 'VISIBLE'
""")
def comment_view(m: Model) -> DataFrame:
    visible = views.comment_views(m.comments(), m.users()).filter("status = 'VISIBLE'")
    return visible.fillna(-1, ["parent_id"]).select("id", "nickname", "parent_id", "reply_to", F.date_format("created_at", "yyyy-MM-dd HH:mm").alias("created_at"))


@query("SELECT image_id, count(*) FILTER (status = 'VISIBLE') AS comment_count FROM comments GROUP BY 1")
def comment_counters(m: Model) -> DataFrame:
    return events.comment_counts(m.comments())


@query("SELECT image_id, count(*) AS comments FROM comments GROUP BY 1")
def comment_count(m: Model) -> DataFrame:
    return m.comments().groupBy("image_id").agg(F.count(F.lit(1)).alias("comments"))


@query("SELECT c.id, c.author, p.author AS parent_author, coalesce(length(p.content), 0) AS parent_length FROM comments c LEFT JOIN comments p ON p.id = c.parent_id")
def comment_replies(m: Model) -> DataFrame:
    return views.comment_views(m.comments()).select("id", "author", "parent_author", F.coalesce(F.length("parent_content"), F.lit(0)).cast("long").alias("parent_length"))


# event-sourced state

_TOGGLES = "(SELECT user_id, image_id, kind, count(*) AS requests, count(*) % 2 = 1 AS active FROM behaviors WHERE kind IN ('LIKE', 'FAVORITE') GROUP BY ALL)"
_EFFECTS = """(SELECT id, ts, image_id, kind, step, CAST(step * CASE kind WHEN 'VIEW' THEN 0.08 WHEN 'CLICK' THEN 0.08 WHEN 'SHARE' THEN 1.2 WHEN 'LIKE' THEN 1.6 ELSE 2.2 END AS DECIMAL(12,4)) AS delta
  FROM (SELECT *, CASE WHEN kind IN ('LIKE', 'FAVORITE') AND row_number() OVER (PARTITION BY user_id, image_id, kind ORDER BY ts, id) % 2 = 0 THEN -1 ELSE 1 END AS step FROM behaviors))"""
_SCORES = f"""(SELECT image_id, max_by(s, o) - least(0, min(s)) AS hot_score, count(*) AS events
  FROM (SELECT image_id, sum(delta) OVER (PARTITION BY image_id ORDER BY ts, id) AS s, row(ts, id) AS o FROM {_EFFECTS}) GROUP BY 1)"""


@query(f"SELECT user_id, image_id, kind, requests, active FROM {_TOGGLES}")
def toggle_state(m: Model) -> DataFrame:
    return events.toggle_state(m.behaviors()).select("user_id", "image_id", "kind", "requests", "active")


@query(f"SELECT user_id, image_id, bool_or(active AND kind = 'LIKE') AS liked, bool_or(active AND kind = 'FAVORITE') AS favorited FROM {_TOGGLES} GROUP BY ALL")
def interaction_status(m: Model) -> DataFrame:
    return events.interaction_status(m.behaviors())


@query(f"SELECT image_id, count(*) AS likes FROM {_TOGGLES} WHERE active AND kind = 'LIKE' GROUP BY 1")
def like_counts(m: Model) -> DataFrame:
    return events.toggle_state(m.behaviors()).filter("active and kind = 'LIKE'").groupBy("image_id").agg(F.count(F.lit(1)).alias("likes"))


@query(f"SELECT image_id, CAST(hot_score AS DECIMAL(12,4)) AS hot_score, events FROM {_SCORES}", decimal="hot_score")
def hot_score_state(m: Model) -> DataFrame:
    return events.clamped_score(events.effects(m.behaviors()))


@query(f"""
SELECT image_id, CAST(count(*) FILTER (kind IN ('VIEW', 'CLICK')) AS BIGINT) AS view_count, CAST(count(*) FILTER (kind = 'SHARE') AS BIGINT) AS share_count,
  CAST(coalesce(sum(step) FILTER (kind = 'LIKE'), 0) AS BIGINT) AS like_count, CAST(coalesce(sum(step) FILTER (kind = 'FAVORITE'), 0) AS BIGINT) AS favorite_count
FROM {_EFFECTS} GROUP BY 1
""")
def counters_state(m: Model) -> DataFrame:
    return events.counters(m.behaviors())


def _by_snapshot(m: Model) -> snapshots.Snapshot:
    """The log's state by way of a stored snapshot of its first half and the days since."""
    log, kept = new_folder(m.spark, "log"), new_folder(m.spark, "snapshot")
    snapshots.write_log(m.behaviors(), log)
    cut, end = datetime.date(2024, 1, 15), datetime.date.max
    snapshots.save(snapshots.advance(snapshots.empty(m.spark), snapshots.days(m.spark, log, datetime.date(1, 1, 1), cut), cut), kept)
    return snapshots.advance(snapshots.load(m.spark, kept), snapshots.days(m.spark, log, cut), end)


@query(f"SELECT image_id, CAST(hot_score AS DECIMAL(12,4)) AS hot_score, events FROM {_SCORES}", decimal="hot_score")
def hot_score_by_snapshot(m: Model) -> DataFrame:
    return snapshots.scores(_by_snapshot(m))


@query(f"""
SELECT image_id, CAST(count(*) FILTER (kind IN ('VIEW', 'CLICK')) AS BIGINT) AS view_count, CAST(count(*) FILTER (kind = 'SHARE') AS BIGINT) AS share_count,
  CAST(coalesce(sum(step) FILTER (kind = 'LIKE'), 0) AS BIGINT) AS like_count, CAST(coalesce(sum(step) FILTER (kind = 'FAVORITE'), 0) AS BIGINT) AS favorite_count
FROM {_EFFECTS} GROUP BY 1
""")
def counters_by_snapshot(m: Model) -> DataFrame:
    return snapshots.counters(_by_snapshot(m))


@query(f"SELECT image_id, CAST(hot_score AS DECIMAL(12,4)) AS hot_score FROM {_SCORES} ORDER BY 2 DESC, 1 DESC LIMIT 30", decimal="hot_score")
def feed_from_events(m: Model) -> DataFrame:
    return events.clamped_score(events.effects(m.behaviors())).select("image_id", "hot_score").orderBy(F.desc("hot_score"), F.desc("image_id")).limit(30)


_EDGES = """(SELECT f.follower, f.followee, min(f.ts) AS since, arg_min(f.scene, row(f.ts, f.id)) AS scene
  FROM (SELECT * FROM follow_log WHERE action = 'follow') f
  LEFT JOIN (SELECT follower, followee, max(row(ts, id)) AS ended FROM follow_log WHERE action = 'unfollow' GROUP BY ALL) e USING (follower, followee)
  WHERE ended IS NULL OR row(f.ts, f.id) > ended GROUP BY ALL)"""


@query(f"SELECT follower, followee, strftime(since, '%Y-%m-%d %H:%M:%S') AS since, scene FROM {_EDGES}")
def follow_state(m: Model) -> DataFrame:
    return events.follow_state(m.follow_log()).select("follower", "followee", F.date_format("since", "yyyy-MM-dd HH:mm:ss").alias("since"), "scene")


@query(f"SELECT id AS user_id, EXISTS (SELECT 1 FROM {_EDGES} e WHERE e.follower = {AUTHOR} AND e.followee = users.id) AS following FROM users")
def follow_status(m: Model) -> DataFrame:
    edges = events.follow_state(m.follow_log()).filter(F.col("follower") == AUTHOR).select(F.col("followee").alias("id"), F.lit(True).alias("f"))
    return m.users().join(edges, "id", "left").select(F.col("id").alias("user_id"), F.coalesce("f", F.lit(False)).alias("following"))


@query(f"""
SELECT u.id AS user_id, least((SELECT count(*) FROM images i WHERE i.author_id = u.id), 10000) AS image_count,
  (SELECT count(*) FROM {_EDGES} e WHERE e.follower = u.id) AS following_count, (SELECT count(*) FROM {_EDGES} e WHERE e.followee = u.id) AS follower_count FROM users u
""")
def user_stats(m: Model) -> DataFrame:
    return events.user_stats(m.users(), m.images(), events.follow_state(m.follow_log()))


@query("""
SELECT id, CASE WHEN NOT EXISTS (SELECT 1 FROM published p WHERE p.id = b.image_id) THEN 'image' ELSE 'user' END AS reason FROM behaviors b
WHERE NOT EXISTS (SELECT 1 FROM published p WHERE p.id = b.image_id) OR NOT EXISTS (SELECT 1 FROM users u WHERE u.id = b.user_id)
""")
def rejected_events(m: Model) -> DataFrame:
    return events.rejected(m.behaviors(), m.published(), m.users()).select("id", "reason")


@query("""
SELECT id, CASE WHEN user_id = image_id THEN 'self' ELSE 'user' END AS reason FROM behaviors
WHERE kind = 'CLICK' AND (user_id = image_id OR NOT EXISTS (SELECT 1 FROM users u WHERE u.id = image_id))
""")
def rejected_follows(m: Model) -> DataFrame:
    asked = m.behaviors().filter("kind = 'CLICK'").select("id", F.col("user_id").alias("follower"), F.col("image_id").alias("followee"))
    return events.rejected_follows(asked, m.users()).select("id", "reason")


@query("""
SELECT image_id, count(*) FILTER (kind = 'VIEW') AS exposures, count(*) FILTER (kind = 'CLICK') AS clicks, count(*) FILTER (kind = 'LIKE') AS likes, count(*) FILTER (kind = 'FAVORITE') AS favorites,
  CAST(coalesce(sum(duration) FILTER (kind = 'VIEW') // nullif(count(duration) FILTER (kind = 'VIEW'), 0), -1) AS BIGINT) AS dwell FROM behaviors GROUP BY 1
""")
def behavior_rates(m: Model) -> DataFrame:
    return recsys.behavior_rates(m.behaviors()).fillna(-1, ["dwell"])


@query("SELECT image_id, count(*) FILTER (kind = 'VIEW') AS views, count(*) FILTER (kind = 'CLICK') AS clicks, CASE WHEN views > 0 THEN clicks * 1000 // views ELSE -1 END AS per_mille FROM behaviors GROUP BY 1")
def click_rates(m: Model) -> DataFrame:
    return recsys.click_rates(m.behaviors()).fillna(-1, ["per_mille"])


@query("""
SELECT v.id, v.user_id, v.image_id, v.ts, coalesce(min_by(c.id, (c.ts, c.id)), -1) AS click_id, coalesce(CAST(date_diff('microsecond', v.ts, min(c.ts)) AS BIGINT), -1) AS dwell
FROM behaviors v LEFT JOIN behaviors c ON c.kind = 'CLICK' AND c.user_id = v.user_id AND c.image_id = v.image_id AND c.ts BETWEEN v.ts AND v.ts + INTERVAL 2 DAY
WHERE v.kind = 'VIEW' GROUP BY v.id, v.user_id, v.image_id, v.ts
""")
def exposure_clicks(m: Model) -> DataFrame:
    found = recsys.exposures(m.behaviors(), 2 * 86_400)
    dwell = F.timestamp_diff("MICROSECOND", F.col("ts"), F.col("clicked_at")).alias("dwell")
    return found.select("id", "user_id", "image_id", "ts", "click_id", dwell).fillna(-1, ["click_id", "dwell"])


@query()
def interaction_ranked(m: Model) -> DataFrame:
    """Every image of the log by its chance of a click, its heat and its nearness to the image seen last."""
    log = m.behaviors()
    trials = recsys.interaction_trials(log, "2024-01-16 00:00:00", 2 * 86_400)
    fitted = logistic.fit(trials, recsys.RATES, "exposures", "hits")
    chances = recsys.interaction_rates(log).filter("image_id is not null").withColumn("chance", logistic.probability(recsys.RATES, fitted))
    last = log.agg(F.max_by("image_id", F.struct("ts", "id")).alias("seed"))
    images = m.images().select(F.col("id").alias("image_id"), "published_at", (F.col("hot_score").cast("double") / 1_000_000).alias("heat"))
    items = chances.join(images, "image_id").withColumn("near", 1 / (1 + F.abs(F.col("image_id") - last.scalar()))).withColumnRenamed("image_id", "id")
    ranked = recsys.ranked(items, {"chance": 1.0, "near": 0.2, "heat": 0.5, "freshness": 0.1}, NOW, 30.0)
    return ranked.select("id", F.round("chance", 6).alias("chance"), F.round("score", 6).alias("score"))


# search

_FOLD = "contains(strip_accents(lower({0})), strip_accents(lower('{1}')))"


@query(f"SELECT doc_id, source FROM documents WHERE {_FOLD.format('text', KEYWORD)} ORDER BY n_chars DESC, doc_id LIMIT 36")
def search_docs_ci_ai(m: Model) -> DataFrame:
    return search.matching(m.corpus(), ["text"], KEYWORD).orderBy(F.desc("n_chars"), "doc_id").limit(search.IMAGES).select("doc_id", "source")


@query("SELECT doc_id FROM documents WHERE lower(text) LIKE '%th_r%ing%' OR lower(source) LIKE '%th_r%ing%'")
def search_like(m: Model) -> DataFrame:
    return search.matching(m.corpus(), ["text", "source"], "Th_r%ing", wildcards=True).select("doc_id")


@query(f"SELECT doc_id, source FROM documents WHERE {_FOLD.format('text', KEYWORD)} ORDER BY n_chars DESC, doc_id LIMIT 36")
def search_docs_postings(m: Model) -> DataFrame:
    index = postings.build(m.corpus(), ["text"], id_col="doc_id")
    return postings.search(index, KEYWORD).orderBy(F.desc("n_chars"), "doc_id").limit(search.IMAGES).select("doc_id", "source")


@query("SELECT doc_id FROM documents WHERE lower(text) LIKE '%th_rtion%ing%' OR lower(source) LIKE '%th_rtion%ing%'")
def search_like_postings(m: Model) -> DataFrame:
    index = postings.build(m.corpus(), ["text", "source"], id_col="doc_id")
    return postings.search(index, "Th_rtion%ing", wildcards=True).select("doc_id")


@query("SELECT id, nickname FROM users WHERE contains(lower(nickname), 'r#00000001') ORDER BY id DESC LIMIT 12")
def search_users(m: Model) -> DataFrame:
    return search.matching(m.users(), ["nickname"], "R#00000001").orderBy(F.desc("id")).limit(search.USERS).select("id", "nickname")


@query("SELECT id, name FROM topics WHERE contains(lower(name), 'supplier#000000001') ORDER BY hot_score DESC, id LIMIT 12")
def search_topics(m: Model) -> DataFrame:
    return search.matching(m.topics(), ["name"], text.topic_name(TOPIC_WORD)).orderBy(F.desc("hot_score"), "id").limit(search.TOPICS).select("id", "name")


@query(f"""+
t AS (SELECT *, row_number() OVER (ORDER BY hot_score DESC, id) AS position FROM topics WHERE contains(lower(name), '{KEYWORD}')),
u AS (SELECT *, row_number() OVER (ORDER BY id DESC) AS position FROM users WHERE contains(lower(nickname), '{KEYWORD}')),
d AS (SELECT *, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS position FROM documents WHERE {_FOLD.format('text', KEYWORD)})
SELECT 'topic' AS kind, id, name AS label, CAST(position AS INTEGER) AS position FROM t WHERE position <= 12
UNION ALL SELECT 'user', id, nickname, CAST(position AS INTEGER) FROM u WHERE position <= 12
UNION ALL SELECT 'image', doc_id, source, CAST(position AS INTEGER) FROM d WHERE position <= 36
""")
def search_all(m: Model) -> DataFrame:
    docs = m.corpus().select(F.col("doc_id").alias("id"), "text", "source", F.col("n_chars").alias("hot_score"))
    return search.search_all(m.users(), docs, _counted_topics(m), f" {KEYWORD} ")


# text and media

@query("SELECT p_partkey AS id, regexp_replace(regexp_replace(trim('  ##' || p_name || ' x'), '^#+', ''), '\\s+', '', 'g') AS topic FROM part")
def topic_normalize(m: Model) -> DataFrame:
    return m.table("part").select(F.col("p_partkey").alias("id"), text.normalize_topic(F.concat(F.lit("  ##"), F.col("p_name"), F.lit(" x"))).alias("topic"))


@query("""
SELECT p_partkey AS id, CASE WHEN trim(s, '-') = '' THEN 'key-' || substr(sha1(ltrim(raw, '#')), 1, 16) ELSE trim(s, '-') END AS slug
FROM (SELECT p_partkey, raw, regexp_replace(lower(regexp_replace(raw, '[^\\x00-\\x7F]', '', 'g')), '[^a-z0-9]+', '-', 'g') AS s
  FROM (SELECT p_partkey, CASE p_partkey % 10 WHEN 0 THEN '图' WHEN 1 THEN '#图' ELSE p_name || ' / ' || p_brand END AS raw FROM part))
""")
def slugify(m: Model) -> DataFrame:
    raw = F.when(F.col("p_partkey") % 10 == 0, "图").when(F.col("p_partkey") % 10 == 1, "#图").otherwise(F.concat_ws(" / ", "p_name", "p_brand"))
    return m.table("part").select(F.col("p_partkey").alias("id"), text.slug(raw).alias("slug"))


_SIZES = "(SELECT l_orderkey AS id, l_linenumber AS n, 16 + l_partkey * 7 % 1900 AS w, 16 + l_suppkey * 37 % 1400 AS h FROM lineitem)"


def _sizes(m: Model) -> DataFrame:
    return m.table("lineitem").select(
        F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("n"), (F.lit(16) + F.col("l_partkey") * 7 % 1900).alias("w"), (F.lit(16) + F.col("l_suppkey") * 37 % 1400).alias("h")
    )


@query(f"""
SELECT DISTINCT w, h, CASE WHEN greatest(w // gcd(w, h), h // gcd(w, h)) > 80
  THEN rtrim(rtrim(CAST(CAST(CAST((w * 100000 // h + 5) // 10 AS DECIMAL(20,0)) / 10000 AS DECIMAL(20,4)) AS VARCHAR), '0'), '.') || ':1'
  ELSE (w // gcd(w, h)) || ':' || (h // gcd(w, h)) END AS ratio FROM {_SIZES}
""")
def ratio_label(m: Model) -> DataFrame:
    return _sizes(m).select("w", "h").distinct().withColumn("ratio", media.ratio_label(F.col("w"), F.col("h")))


@query(f"SELECT DISTINCT w, h, CASE WHEN w > 520 THEN greatest(1, (h * 520 * 2 + w) // (2 * w)) ELSE h END AS thumb FROM {_SIZES}")
def thumb_size(m: Model) -> DataFrame:
    return _sizes(m).select("w", "h").distinct().withColumn("thumb", media.thumb_height(F.col("w"), F.col("h")))


@query("""
SELECT n, CASE WHEN n >= 100000 THEN ((n + 5000) // 10000) || '万' WHEN n >= 10000 THEN ((n + 500) // 1000 // 10) || '.' || ((n + 500) // 1000 % 10) || '万'
  WHEN n >= 1000 THEN ((n + 50) // 100 // 10) || CASE WHEN (n + 50) // 100 % 10 = 0 THEN '' ELSE '.' || ((n + 50) // 100 % 10) END || 'k' ELSE CAST(n AS VARCHAR) END AS shown
FROM (SELECT DISTINCT l_partkey * l_linenumber * 13 AS n FROM lineitem)
""")
def count_text(m: Model) -> DataFrame:
    counts = m.table("lineitem").select((F.col("l_partkey") * F.col("l_linenumber") * 13).alias("n")).distinct()
    return counts.withColumn("shown", text.count_text(F.col("n")))


@query(f"""
SELECT id, CASE WHEN s < 60 THEN '刚刚' WHEN s < 3600 THEN (s // 60) || '分钟前' WHEN s < 86400 THEN (s // 3600) || '小时前' WHEN s < 604800 THEN (s // 86400) || '天前'
  ELSE strftime(ts, '%Y/%-m/%-d') END AS shown
FROM (SELECT id, ts, CAST(epoch(TIMESTAMP '{NOW}') AS BIGINT) - CAST(floor(epoch(ts)) AS BIGINT) AS s FROM behaviors)
""")
def relative_time(m: Model) -> DataFrame:
    return m.behaviors().select("id", text.relative_bucket(F.col("ts"), F.to_timestamp_ntz(F.lit(NOW))).alias("shown"))


@query(f"SELECT id, n, CASE WHEN n % 2 = 0 THEN w || ' / ' || h ELSE ['3 / 4.2', '3 / 3.6', '3 / 4.8', '3 / 3.9', '3 / 4.5', '3 / 5.1'][CAST(abs(id) % 6 + 1 AS INTEGER)] END AS ratio, w FROM {_SIZES}")
def aspect_ratio(m: Model) -> DataFrame:
    width = F.when(F.col("n") % 2 == 0, F.col("w"))
    return _sizes(m).select("id", "n", media.aspect_ratio(width, F.col("h"), F.col("id")).alias("ratio"), "w")


# curation

def _candidates(m: Model) -> DataFrame:
    """Made-up image addresses, as the pages of the driver hold none."""
    size = F.element_at(F.array(*map(F.lit, ("236x", "474x", "736x", "originals"))), (F.col("page_id") * 7 % 4 + 1).cast("int"))
    url = F.concat(F.lit("https://IMG.example.com/"), size, F.lit("/"), F.col("page_id") % 40, F.lit("/ab/P.jpg"))
    return m.table("pages").select(
        F.col("page_id").alias("seq"), url.alias("url"), F.when(F.col("page_id") % 3 == 0, F.col("url")).otherwise("").alias("detail_url"), F.array(F.concat(url, F.lit("?s=")), F.lit("")).alias("fallbacks")
    )


_CANDIDATES = """(SELECT page_id AS seq, s, 'https://IMG.example.com/' || s || '/' || (page_id % 40) || '/ab/P.jpg' AS url,
  CASE s WHEN 'originals' THEN 1000010 ELSE CAST(replace(s, 'x', '') AS BIGINT) + 10 END AS score, sha1('img.example.com/originals/' || (page_id % 40) || '/ab/p.jpg') AS key
  , page FROM (SELECT page_id, url AS page, ['236x', '474x', '736x', 'originals'][CAST(page_id * 7 % 4 + 1 AS INTEGER)] AS s FROM pages))"""


@query("SELECT page_id, regexp_replace(url, '#.*$', '') AS clean FROM pages")
def url_normalize(m: Model) -> DataFrame:
    return m.table("pages").select("page_id", urls.normalize_url(F.col("url")).alias("clean"))


@query(f"SELECT seq, key, score FROM {_CANDIDATES}")
def canonical_key(m: Model) -> DataFrame:
    return curation.with_keys(_candidates(m), HOST).select("seq", "key", "score")


@query(f"SELECT key, min(seq) AS first_seq, max_by(url, score * 1000000 - seq) AS url FROM {_CANDIDATES} GROUP BY 1")
def candidate_dedupe(m: Model) -> DataFrame:
    return curation.merge_candidates(curation.with_keys(_candidates(m), HOST)).select("key", "first_seq", "url")


@query(f"""+
c AS (SELECT *, CASE WHEN seq % 3 = 0 THEN page ELSE '' END AS detail, row_number() OVER (PARTITION BY key ORDER BY seq) AS turn FROM {_CANDIDATES}),
f AS (
  SELECT key, turn, score, url, detail, [url || '?s='] AS fb FROM c WHERE turn = 1
  UNION ALL SELECT c.key, c.turn, greatest(f.score, c.score), CASE WHEN c.score > f.score THEN c.url ELSE f.url END,
    CASE WHEN c.score > f.score THEN c.detail WHEN f.detail = '' THEN c.detail ELSE f.detail END,
    CASE WHEN c.score > f.score THEN list_filter(list_concat([f.url], f.fb, [c.url || '?s=']), lambda x, i: list_position(list_concat([f.url], f.fb, [c.url || '?s=']), x) = i) ELSE f.fb END
  FROM f JOIN c ON c.key = f.key AND c.turn = f.turn + 1)
SELECT key, arg_max(detail, turn) AS detail_url, array_to_string(arg_max(fb, turn), ' ') AS fallbacks FROM f GROUP BY 1
""")
def candidate_fallbacks(m: Model) -> DataFrame:
    merged = curation.merge_candidates(curation.with_keys(_candidates(m), HOST))
    return merged.select("key", "detail_url", F.array_join(F.filter("fallbacks", lambda x: x != ""), " ").alias("fallbacks"))


@query(f"SELECT seq FROM {_CANDIDATES} WHERE key NOT IN (SELECT key FROM {_CANDIDATES} WHERE seq < 20)")
def resume_anti(m: Model) -> DataFrame:
    keyed = curation.with_keys(_candidates(m), HOST)
    return curation.not_done(keyed, keyed.filter("seq < 20")).select("seq")


@query("""
SELECT sha256(text) AS hash, min(doc_id) AS path, count(*) AS copies FROM documents WHERE doc_id >= 100
GROUP BY 1 HAVING hash NOT IN (SELECT sha256(text) FROM documents WHERE doc_id < 100)
""")
def content_hash_dedupe(m: Model) -> DataFrame:
    files = m.corpus().select(F.sha2("text", 256).alias("hash"), F.col("doc_id").alias("path"))
    return curation.new_contents(files.filter("path >= 100"), files.filter("path < 100"))


@query("SELECT event_type AS status, count(*) AS n FROM events GROUP BY 1")
def run_summary(m: Model) -> DataFrame:
    return curation.run_summary(m.table("events").withColumnRenamed("event_type", "status"))


@query("""+
r AS (SELECT l_orderkey AS page, l_linenumber AS round, count(*) % 2 AS n FROM lineitem GROUP BY ALL),
s AS (SELECT *, n = lag(n, 1, 0) OVER w AS same FROM r WINDOW w AS (PARTITION BY page ORDER BY round)),
g AS (SELECT *, sum(CASE WHEN same THEN 0 ELSE 1 END) OVER (PARTITION BY page ORDER BY round) AS run FROM s),
k AS (SELECT *, sum(CASE WHEN same THEN 1 ELSE 0 END) OVER (PARTITION BY page, run ORDER BY round) AS length FROM g)
SELECT page, min(round) AS round FROM k WHERE length >= 4 GROUP BY 1
""")
def settled_rounds(m: Model) -> DataFrame:
    rounds = m.table("lineitem").groupBy(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("round")).agg((F.count(F.lit(1)) % 2).alias("n"))
    return curation.settled_round(rounds)


@query("""
SELECT DISTINCT regexp_replace(url, '#.*$', '') AS source, CASE WHEN h LIKE 'http%' THEN h ELSE regexp_extract(url, '^(https?://[^/?#]*)', 1) || h END AS target
FROM (SELECT url, unnest(regexp_extract_all(html, '<a\\s[^>]*?href="([^"#]+)', 1)) AS h FROM pages) WHERE regexp_matches(h, '^(https?://|/)')
""")
def page_links(m: Model) -> DataFrame:
    return curation.links(m.table("pages"))


@query("""+
e AS (SELECT DISTINCT regexp_replace(url, '#.*$', '') AS source, CASE WHEN h LIKE 'http%' THEN h ELSE regexp_extract(url, '^(https?://[^/?#]*)', 1) || h END AS target
  FROM (SELECT url, unnest(regexp_extract_all(html, '<a\\s[^>]*?href="([^"#]+)', 1)) AS h FROM pages) WHERE regexp_matches(h, '^(https?://|/)')),
s AS (SELECT DISTINCT regexp_replace(url, '#.*$', '') AS url FROM pages WHERE page_id < 10),
b AS (SELECT url, 0 AS depth FROM s UNION SELECT target, depth + 1 FROM b JOIN e ON e.source = b.url WHERE depth < 3)
SELECT url, min(depth) AS depth FROM b GROUP BY 1
""")
def frontier_bfs(m: Model) -> DataFrame:
    seeds = m.table("pages").filter("page_id < 10").select(F.regexp_replace("url", "#.*$", "").alias("url"))
    return curation.crawl(curation.links(m.table("pages")), seeds, 3)


# taxonomy

@query("SELECT (SELECT max(id) FROM topics) + row_number() OVER (ORDER BY name) AS id, name FROM (SELECT DISTINCT p_name AS name FROM part)")
def new_topic_ids(m: Model) -> DataFrame:
    return taxonomy.assign_ids(m.topics().select("id", "name"), m.table("part").select(F.col("p_name").alias("name")), "name")


@query("""
SELECT CASE WHEN p_partkey % 10 = 0 THEN 'c' ELSE replace(p_name, ' ', '-') END AS slug, count(DISTINCT CASE WHEN p_partkey % 20 = 0 THEN 'C++' WHEN p_partkey % 10 = 0 THEN 'C#' ELSE p_name END) AS names
FROM part GROUP BY 1 HAVING names > 1
""")
def slug_collisions(m: Model) -> DataFrame:
    name = F.when(F.col("p_partkey") % 20 == 0, "C++").when(F.col("p_partkey") % 10 == 0, "C#").otherwise(F.col("p_name"))
    return taxonomy.slug_collisions(m.table("part").select(name.alias("name")), text.slug(F.col("name")))


@query("""
SELECT p_partkey AS id, p_brand AS description, p_type || '>' || p_name AS path, p_type || ':' || p_name || ':' || CASE p_partkey % 4 WHEN 0 THEN '0.8' WHEN 1 THEN '1.0' WHEN 2 THEN '0.0' ELSE '0.25' END AS tags FROM part
""")
def annotation_normalize(m: Model) -> DataFrame:
    """Answers of a model as they come: fenced, with words around, aliases, numbers out of range."""
    value = F.element_at(F.array(*map(F.lit, ('"high"', "7", "-1", '"0.25"'))), (F.col("p_partkey") % 4 + 1).cast("int"))
    body = F.concat(
        F.lit('{"description": " #'), F.col("p_brand"), F.lit('", "category_path": "'), F.col("p_type"), F.lit(" / "), F.col("p_name"),
        F.lit('", "tags": [{"type": "'), F.col("p_type"), F.lit('", "label": "##'), F.col("p_name"), F.lit('", "confidence": '), value, F.lit('}, {"type": "", "name": "x"}]}'),
    )
    answer = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("Sure: "), body, F.lit(" done"))).otherwise(body)
    found = m.table("part").select(F.col("p_partkey").alias("id"), taxonomy.normalized_annotation(answer).alias("a"))
    shown = F.transform("a.tags", lambda t: F.concat_ws(":", t["type"], t["name"], t["confidence"]))
    return found.select("id", "a.description", F.array_join("a.path", ">").alias("path"), F.array_join(shown, "|").alias("tags"))


# layout, streams in batch form, recommendation

@query(f"""+
c AS (SELECT id // 60 AS page, id % 60 AS place, id, greatest(136.0::DOUBLE, 236.0::DOUBLE * (h / w)) AS height FROM (SELECT id, max(w) AS w, max(h) AS h FROM {_SIZES} GROUP BY 1)),
n AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY place) AS turn FROM c),
p AS (
  SELECT DISTINCT page, CAST(0 AS BIGINT) AS turn, CAST([0, 0, 0, 0, 0] AS DOUBLE[]) AS heights, CAST(NULL AS BIGINT) AS id, CAST(NULL AS BIGINT) AS place, CAST(NULL AS BIGINT) AS k, CAST(NULL AS DOUBLE) AS y, CAST(NULL AS DOUBLE) AS height FROM n
  UNION ALL SELECT n.page, n.turn, list_transform(p.heights, lambda x, i: CASE WHEN i = list_position(p.heights, list_min(p.heights)) THEN x + n.height + 10 ELSE x END), n.id, n.place,
    list_position(p.heights, list_min(p.heights)) - 1, list_min(p.heights), n.height FROM p JOIN n ON n.page = p.page AND n.turn = p.turn + 1)
SELECT CAST(page AS INTEGER) AS page, id, CAST(place AS INTEGER) AS place, CAST(k AS INTEGER) AS "column", k * 246.0::DOUBLE AS x, y, height FROM p WHERE id IS NOT NULL
""")
def masonry_pack(m: Model) -> DataFrame:
    cards = _sizes(m).groupBy("id").agg(F.max("w").alias("w"), F.max("h").alias("h"))
    pages = cards.select((F.col("id") / 60).cast("int").alias("page"), (F.col("id") % 60).cast("int").alias("place"), "id", (F.col("h") / F.col("w")).alias("ratio"))
    return layout.pack(pages, 236.0, [0.0] * 5)


_HOUR = "strftime({0}, '%Y-%m-%d %H:%M:%S') AS start"


def _shown(rows: DataFrame) -> DataFrame:
    return rows.withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss"))


def _stream_events(m: Model) -> DataFrame:
    return m.table("events").withColumn("ts", F.col("ts").cast("timestamp"))


@query(f"SELECT {_HOUR.format('date_trunc($$hour$$, ts)')}, event_type, count(*) AS n FROM events GROUP BY ALL")
def events_tumbling(m: Model) -> DataFrame:
    return _shown(behaviors.windowed(_stream_events(m), "1 hour"))


@query(f"SELECT {_HOUR.format('w')}, event_type, count(*) AS n FROM (SELECT event_type, time_bucket(INTERVAL 15 MINUTE, ts) - INTERVAL 15 MINUTE * unnest([0, 1, 2, 3]) AS w FROM events) GROUP BY ALL")
def events_sliding(m: Model) -> DataFrame:
    return _shown(behaviors.windowed(_stream_events(m), "1 hour", "15 minutes"))


@query(f"""
SELECT user_id, {_HOUR.format('min(ts)')}, count(*) AS n FROM (
  SELECT *, sum(CASE WHEN gap THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts) AS visit
  FROM (SELECT user_id, ts, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) > INTERVAL 30 MINUTE, true) AS gap FROM events))
GROUP BY user_id, visit
""")
def events_session(m: Model) -> DataFrame:
    return _shown(behaviors.sessions(_stream_events(m)))


@query("""
SELECT e.vec_id, round(CAST(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) AS DOUBLE), 6) AS cosine
FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY 2 DESC, 1 LIMIT 20
""")
def vector_topk(m: Model) -> DataFrame:
    rows = m.table("embeddings")
    return vectors.nearest_each(rows, rows.filter("vec_id = 0"), 20).select("vec_id", "cosine")


@query("""
SELECT query_id, vec_id, cosine FROM (
  SELECT q.vec_id AS query_id, e.vec_id, round(CAST(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) AS DOUBLE), 6) AS cosine
  FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id % 20 = 0) q)
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, vec_id) <= 20
""")
def vector_topk_all(m: Model) -> DataFrame:
    rows = m.table("embeddings")
    return vectors.nearest_each(rows, rows.filter("vec_id % 20 = 0"), 20)


@query()
def vector_topk_index(m: Model) -> DataFrame:
    rows = m.table("embeddings")
    return vectors.nearest_each(rows, rows.filter("vec_id % 20 = 0"), 20, index=vectors.fit(rows, 20))


@query("""
SELECT e.vec_id, round(CAST(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) AS DOUBLE), 6) AS cosine
FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q WHERE e.vec_id % 3 = 1 ORDER BY 2 DESC, 1 LIMIT 20
""")
def vector_topk_where(m: Model) -> DataFrame:
    rows = m.table("embeddings")
    return vectors.nearest_each(rows, rows.filter("vec_id = 0"), 20, where=F.col("vec_id") % 3 == 1).select("vec_id", "cosine")


@query(f"""+
liked AS (SELECT DISTINCT image_id AS id FROM {_TOGGLES} WHERE user_id = {AUTHOR} AND kind = 'LIKE' AND active),
mine AS (SELECT DISTINCT tag_id FROM tag_writes WHERE image_id IN (FROM liked)),
shared AS (SELECT image_id AS id, count(DISTINCT tag_id) AS shared FROM tag_writes WHERE tag_id IN (FROM mine) AND image_id NOT IN (FROM liked) GROUP BY 1),
seed AS (SELECT max_by(image_id, row(ts, id)) AS seed FROM behaviors WHERE user_id = {AUTHOR}),
topic AS (SELECT topic_id, sum(delta) AS weight FROM (SELECT DISTINCT * FROM topic_attempts) JOIN {_EFFECTS.replace("SELECT id, ts,", "SELECT user_id, ts,", 1)} USING (image_id) WHERE user_id = {AUTHOR} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10),
weighed AS (SELECT image_id AS id, sum(weight) AS weight FROM (SELECT DISTINCT * FROM topic_attempts) JOIN topic USING (topic_id) GROUP BY 1)
SELECT 'tag' AS channel, id, CAST(row_number() OVER (ORDER BY shared DESC, hot_score DESC, id) AS INTEGER) AS place FROM shared JOIN published USING (id) QUALIFY place <= 40
UNION ALL SELECT 'similar', id, CAST(row_number() OVER (ORDER BY abs(id - seed), hot_score DESC, id) AS INTEGER) AS place FROM published, seed WHERE id <> seed QUALIFY place <= 40
UNION ALL SELECT 'interest', id, CAST(row_number() OVER (ORDER BY weight DESC, id) AS INTEGER) AS place FROM weighed JOIN published USING (id) QUALIFY place <= 40
""")
def recall_channels(m: Model) -> DataFrame:
    own = m.behaviors().filter(F.col("user_id") == AUTHOR)
    liked = events.toggle_state(own).filter("active and kind = 'LIKE'").select(F.col("image_id").alias("id")).distinct()
    bound = views.bindings(m.topic_attempts())
    found = {
        "tag": recsys.same_tags(m.published(), m.tag_writes(), liked, 40),
        "similar": recsys.like_the_last(m.published(), own, 40),
        "interest": recsys.by_interest(m.published(), bound, events.effects(own).select("image_id", "delta"), 40),
    }
    tagged = [rows.select(F.lit(name).alias("channel"), "id", "place") for name, rows in found.items()]
    return tagged[0].unionByName(tagged[1]).unionByName(tagged[2])


@query(f"""
SELECT id, round(score, 6) AS score FROM (SELECT id, CAST(hot_score AS DOUBLE) / 1000000 * 0.5 + pow(0.5, greatest(date_diff('second', published_at, TIMESTAMP '{NOW}') / 86400, 0) / 30) AS score FROM published)
""")
def ranked_images(m: Model) -> DataFrame:
    items = m.published().select("id", "published_at", (F.col("hot_score").cast("double") / 1_000_000).alias("heat"))
    return recsys.ranked(items, {"freshness": 1.0, "heat": 0.5}, NOW, 30.0).select("id", "score")


@query(f"""+
h AS (SELECT id, row_number() OVER (ORDER BY hot_score DESC, id) AS place, 0 AS c FROM published QUALIFY place <= 40),
l AS (SELECT id, row_number() OVER (ORDER BY published_at DESC, id) AS place, 1 AS c FROM published QUALIFY place <= 40),
a AS (SELECT id, row_number() OVER (ORDER BY published_at DESC, id) AS place, 2 AS c FROM published WHERE author_id = {AUTHOR} QUALIFY place <= 40),
x AS (SELECT * FROM (FROM h UNION ALL FROM l UNION ALL FROM a) WHERE id NOT IN (SELECT image_id FROM behaviors) QUALIFY row_number() OVER (PARTITION BY id ORDER BY place, c) = 1),
t AS (SELECT id, c, row_number() OVER (PARTITION BY c ORDER BY place) AS turn FROM x)
SELECT id, ['hot', 'latest', 'author'][c + 1] AS channel, CAST(turn AS INTEGER) AS turn, CAST(row_number() OVER (ORDER BY turn, c) AS INTEGER) AS slot FROM t ORDER BY turn, c LIMIT 30
""")
def recall_mix(m: Model) -> DataFrame:
    def channel(rows: DataFrame, *order: Column) -> DataFrame:
        return ranking.positions(rows.orderBy(*order).limit(40), list(order)).withColumnRenamed("position", "place")

    latest = (F.desc("published_at"), F.asc("id"))
    channels = {
        "hot": channel(m.published(), F.desc("hot_score"), F.asc("id")),
        "latest": channel(m.published(), *latest),
        "author": channel(m.published().filter(F.col("author_id") == AUTHOR), *latest),
    }
    return recsys.mix_channels(channels, m.behaviors().select(F.col("image_id").alias("id")), 30)
