"""Ranked retrieval: feeds, neighbours by id, lists of an author, trending lists, totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.paging import Page, page_of


def feed_order() -> list[Column]:
    return [F.desc("hot_score"), F.desc("published_at"), F.desc("id")]


def feed(published: DataFrame, page: Page) -> DataFrame:
    """One page of the feed: hottest first, then latest, then largest id."""
    return page_of(published, feed_order(), page)


def similar(published: DataFrame, to: int, page: Page) -> DataFrame:
    """Nearest ids first, hottest first among equally near ones; the image itself is left out."""
    rows = published.filter(F.col("id") != to).withColumn("distance", F.abs(F.col("id") - F.lit(to)))
    return page_of(rows, [F.asc("distance"), F.desc("hot_score"), F.asc("id")], page)


def author_latest(published: DataFrame, author: int, page: Page) -> DataFrame:
    return page_of(published.filter(F.col("author_id") == author), [F.desc("published_at"), F.desc("id")], page)


def top_per_author(published: DataFrame, k: int) -> DataFrame:
    """The latest k images of every author; Spark cuts each task's groups to k rows before the shuffle."""
    rank = F.row_number().over(Window.partitionBy("author_id").orderBy(F.desc("published_at"), F.desc("id")))
    return published.withColumn("position", rank).filter(F.col("position") <= k)


def trending(topics: DataFrame, counts: DataFrame, size: int) -> DataFrame:
    """Topics by score, then by binding attempts, then by id."""
    rows = topics.join(counts, topics["id"] == counts["topic_id"], "left").drop("topic_id").fillna(0, ["attempts"])
    return rows.orderBy(F.desc("hot_score"), F.desc("attempts"), F.asc("id")).limit(size)


def positions(rows: DataFrame, order: list[Column]) -> DataFrame:
    """1-based positions in a shown list; for lists of a page's size."""
    return rows.withColumn("position", F.row_number().over(Window.orderBy(*order)))


def merge_pages(pages: list[DataFrame], key: str) -> DataFrame:
    """Pages in the order they were loaded; of a key seen before the later row is dropped."""
    every = pages[0].withColumn("page_no", F.lit(0))
    for k, page in enumerate(pages[1:], 1):
        every = every.unionByName(page.withColumn("page_no", F.lit(k)))
    first = F.row_number().over(Window.partitionBy(key).orderBy("page_no"))
    return every.withColumn("_n", first).filter("_n = 1").drop("_n")
