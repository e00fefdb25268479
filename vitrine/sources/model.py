"""The logical relations, mapped to the star-schema tables that stand in for them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCORE = "decimal(12,4)"
#: Kinds of behaviour that the test tables' event types stand for.
KINDS = {"view": "VIEW", "click": "CLICK", "error": "SHARE", "purchase": "LIKE", "signup": "FAVORITE"}


class Model:
    """Lazy relations over the Parquet tables of one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def images(self) -> DataFrame:
        """id, author_id, status, hot_score, published_at, post_type."""
        return self.table("orders").select(
            F.col("o_orderkey").alias("id"),
            F.col("o_custkey").alias("author_id"),
            F.when(F.col("o_orderstatus") == "F", "PUBLISHED").otherwise("DRAFT").alias("status"),
            F.col("o_totalprice").cast(SCORE).alias("hot_score"),
            F.col("o_orderdate").alias("published_at"),
            F.col("o_orderpriority").alias("post_type"),
        )

    def published(self) -> DataFrame:
        return self.images().filter("status = 'PUBLISHED'")

    def users(self) -> DataFrame:
        """id, nickname, category_id."""
        return self.table("customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("nickname"), F.col("c_nationkey").cast("long").alias("category_id"))

    def topics(self) -> DataFrame:
        """id, name, hot_score."""
        return self.table("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").cast(SCORE).alias("hot_score"))

    def topic_attempts(self) -> DataFrame:
        """image_id, topic_id: every attempt to bind a topic; the distinct ones are the bindings."""
        return self.table("lineitem").select(F.col("l_orderkey").alias("image_id"), F.col("l_suppkey").alias("topic_id"))

    def tags(self) -> DataFrame:
        """id, type, name."""
        return self.table("part").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("type"), F.col("p_name").alias("name"))

    def tag_writes(self) -> DataFrame:
        """image_id, tag_id, confidence, source, seq: every write of a tag; seq orders writes of one pair."""
        table = self.table("lineitem")
        seq = F.struct("l_shipdate", *(c for c in table.columns if c != "l_shipdate"))
        return table.select(
            F.col("l_orderkey").alias("image_id"),
            F.col("l_partkey").alias("tag_id"),
            (1 - F.col("l_discount")).cast("decimal(6,4)").alias("confidence"),
            F.col("l_returnflag").alias("source"),
            seq.alias("seq"),
        )

    def categories(self) -> DataFrame:
        """id, name, parent_id, sort_no."""
        regions = self.table("region").select((F.col("r_regionkey") + 1000).cast("long").alias("id"), F.col("r_name").alias("name"), F.lit(None).cast("long").alias("parent_id"), F.col("r_regionkey").alias("sort_no"))
        nations = self.table("nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"), (F.col("n_regionkey") + 1000).cast("long").alias("parent_id"), (F.col("n_nationkey") % 3).alias("sort_no"))
        return regions.unionByName(nations)

    def behaviors(self) -> DataFrame:
        """id, ts, user_id, kind, image_id, duration."""
        kind = F.element_at(F.create_map(*(F.lit(x) for pair in KINDS.items() for x in pair)), F.col("event_type"))
        return self.table("events").select(
            F.col("event_id").alias("id"), "ts", "user_id", kind.alias("kind"), F.get_json_object("props", "$.k").cast("long").alias("image_id"), F.floor(F.col("value") * 10).alias("duration")
        )

    def follow_log(self) -> DataFrame:
        """id, ts, follower, followee, action (follow or unfollow), scene; nobody follows themselves."""
        log = self.behaviors().filter("kind in ('CLICK', 'SHARE')")
        return log.select(
            "id",
            "ts",
            F.col("user_id").alias("follower"),
            F.col("image_id").alias("followee"),
            F.when(F.col("kind") == "CLICK", "follow").otherwise("unfollow").alias("action"),
            F.date_format("ts", "yyyyMMdd").alias("scene"),
        ).filter("follower <> followee")

    def comments(self) -> DataFrame:
        """id, image_id, parent_id, author (a role), author_id, content, created_at, status."""
        turn = self.table("conversations").withColumns({"c": F.col("conv_id").cast("long"), "t": F.col("turn").cast("long")})
        return turn.select(
            (F.col("c") * 1000 + F.col("t")).alias("id"),
            F.col("c").alias("image_id"),
            F.when(F.col("t") > 0, F.col("c") * 1000 + F.col("t") - 1).alias("parent_id"),
            F.col("role").alias("author"),
            ((F.col("c") * 7 + F.col("t")) % 200).alias("author_id"),
            F.col("text").alias("content"),
            (F.to_timestamp_ntz(F.lit("2024-01-01 00:00:00")) + F.make_dt_interval(mins=((F.col("c") * 37 + F.col("t") * 53) % 100).cast("int"))).alias("created_at"),
            F.when(F.col("t") % 5 == 4, "HIDDEN").otherwise("VISIBLE").alias("status"),
        )

    def image_details(self) -> DataFrame:
        """images with title, content, addresses, sizes and counters, made up from the id."""
        key = F.col("id").cast("string")
        host = "https://img.example.com"
        thumb = F.when(F.col("id") % 3 == 1, F.concat(F.lit(f"{host}/t/"), key, F.lit(".jpg"))).when(F.col("id") % 3 == 2, " ")
        return self.images().select(
            "*", F.concat(F.lit("Order "), key).alias("title"), F.lower("post_type").alias("content"), F.concat(F.lit("originals/"), key, F.lit(".jpg")).alias("object_key"),
            F.concat(F.lit(f"{host}/"), key, F.lit(".jpg")).alias("file_url"), F.lit("image/jpeg").alias("file_type"), thumb.alias("thumbnail_url"), (16 + F.col("id") * 7 % 1900).alias("width"),
            (16 + F.col("id") * 37 % 1400).alias("height"), (F.col("id") * 13).alias("file_size"), F.sha2(key, 256).alias("hash"), (F.col("id") % 11).alias("like_count"), (F.col("id") % 7).alias("favorite_count"),
            (F.col("id") % 5).alias("comment_count"), (F.col("id") % 4).alias("share_count"), (F.col("id") % 101).alias("view_count"),
        )

    def corpus(self) -> DataFrame:
        return self.table("documents")


#: The same relations for DuckDB.
VIEWS = """
images AS (SELECT o_orderkey AS id, o_custkey AS author_id, CASE WHEN o_orderstatus = 'F' THEN 'PUBLISHED' ELSE 'DRAFT' END AS status,
  CAST(o_totalprice AS DECIMAL(12,4)) AS hot_score, o_orderdate AS published_at, o_orderpriority AS post_type FROM orders),
published AS (SELECT * FROM images WHERE status = 'PUBLISHED'),
users AS (SELECT c_custkey AS id, c_name AS nickname, CAST(c_nationkey AS BIGINT) AS category_id FROM customer),
topics AS (SELECT s_suppkey AS id, s_name AS name, CAST(s_acctbal AS DECIMAL(12,4)) AS hot_score FROM supplier),
topic_attempts AS (SELECT l_orderkey AS image_id, l_suppkey AS topic_id FROM lineitem),
tags AS (SELECT p_partkey AS id, p_type AS type, p_name AS name FROM part),
tag_writes AS (SELECT l_orderkey AS image_id, l_partkey AS tag_id, CAST(1 - l_discount AS DECIMAL(6,4)) AS confidence, l_returnflag AS source,
  row(l_shipdate, l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus) AS seq FROM lineitem),
categories AS (SELECT CAST(r_regionkey + 1000 AS BIGINT) AS id, r_name AS name, CAST(NULL AS BIGINT) AS parent_id, r_regionkey AS sort_no FROM region
  UNION ALL SELECT CAST(n_nationkey AS BIGINT), n_name, CAST(n_regionkey + 1000 AS BIGINT), n_nationkey % 3 FROM nation),
behaviors AS (SELECT event_id AS id, ts, user_id, CASE event_type WHEN 'view' THEN 'VIEW' WHEN 'click' THEN 'CLICK' WHEN 'error' THEN 'SHARE'
  WHEN 'purchase' THEN 'LIKE' WHEN 'signup' THEN 'FAVORITE' END AS kind, CAST(props->>'k' AS BIGINT) AS image_id, CAST(floor(value * 10) AS BIGINT) AS duration FROM events),
follow_log AS (SELECT id, ts, user_id AS follower, image_id AS followee, CASE WHEN kind = 'CLICK' THEN 'follow' ELSE 'unfollow' END AS action,
  strftime(ts, '%Y%m%d') AS scene FROM behaviors WHERE kind IN ('CLICK', 'SHARE') AND user_id <> image_id),
comments AS (SELECT CAST(conv_id AS BIGINT) * 1000 + CAST(turn AS BIGINT) AS id, CAST(conv_id AS BIGINT) AS image_id,
  CASE WHEN turn > 0 THEN CAST(conv_id AS BIGINT) * 1000 + CAST(turn AS BIGINT) - 1 END AS parent_id, role AS author,
  (CAST(conv_id AS BIGINT) * 7 + CAST(turn AS BIGINT)) % 200 AS author_id, text AS content, TIMESTAMP '2024-01-01 00:00:00' + to_minutes((CAST(conv_id AS BIGINT) * 37 + CAST(turn AS BIGINT) * 53) % 100) AS created_at,
  CASE WHEN turn % 5 = 4 THEN 'HIDDEN' ELSE 'VISIBLE' END AS status FROM conversations),
image_details AS (SELECT *, 'Order ' || id AS title, lower(post_type) AS content, 'originals/' || id || '.jpg' AS object_key, 'https://img.example.com/' || id || '.jpg' AS file_url, 'image/jpeg' AS file_type,
  CASE id % 3 WHEN 1 THEN 'https://img.example.com/t/' || id || '.jpg' WHEN 2 THEN ' ' END AS thumbnail_url, 16 + id * 7 % 1900 AS width, 16 + id * 37 % 1400 AS height, id * 13 AS file_size, sha256(CAST(id AS VARCHAR)) AS hash,
  id % 11 AS like_count, id % 7 AS favorite_count, id % 5 AS comment_count, id % 4 AS share_count, id % 101 AS view_count FROM images)
"""
