"""Keyword search, blind to case and accents or with wildcards."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import topic_name

#: Results of each kind in the combined search (fixed values).
USERS, IMAGES, TOPICS = 12, 36, 12


def contains_folded(column: str, keyword: str) -> Column:
    """Whether the keyword occurs, whatever the case and accents."""
    return F.contains(F.collate(F.col(column), "UNICODE_CI_AI"), F.collate(F.lit(keyword), "UNICODE_CI_AI"))


def like_folded(column: str, keyword: str) -> Column:
    """The same with wildcards: % stands for any text and _ for any character of the keyword; accents count."""
    return F.lower(F.col(column)).like(f"%{keyword.lower()}%")


def matching(rows: DataFrame, columns: list[str], keyword: str, *, wildcards: bool = False) -> DataFrame:
    """Rows with the keyword in any of the columns; a null column matches nothing."""
    test = like_folded if wildcards else contains_folded
    return rows.filter(reduce(lambda a, b: a | b, (test(c, keyword) for c in columns)))


def search_all(users: DataFrame, images: DataFrame, topics: DataFrame, keyword: str) -> DataFrame:
    """kind, id, label, position of users, images and topics; a blank keyword gives the trending topics alone.

    users and images are searched for the trimmed keyword, topics for its form as a topic name; images have text,
    hot_score and id, topics name, hot_score and attempts. A keyword that is no topic name gives the trending topics.
    """
    from .ranking import positions

    word, topic = keyword.strip(), topic_name(keyword)
    top_order = [F.desc("hot_score"), F.desc("attempts"), F.asc("id")]
    found = topics.orderBy(*top_order).limit(TOPICS) if not topic else matching(topics, ["name"], topic).orderBy(F.desc("hot_score"), "id").limit(TOPICS)
    order = top_order if not topic else [F.desc("hot_score"), F.asc("id")]
    parts = [positions(found, order).select(F.lit("topic").alias("kind"), "id", F.col("name").alias("label"), "position")]
    if word:
        people = matching(users, ["nickname"], word).orderBy(F.desc("id")).limit(USERS)
        parts.append(positions(people, [F.desc("id")]).select(F.lit("user").alias("kind"), "id", F.col("nickname").alias("label"), "position"))
        order = [F.desc("hot_score"), F.asc("id")]
        seen = matching(images, ["text"], word).orderBy(*order).limit(IMAGES)
        parts.append(positions(seen, order).select(F.lit("image").alias("kind"), "id", F.col("source").alias("label"), "position"))
    return reduce(DataFrame.unionByName, parts)
