"""Placement of cards into the shortest column, page by page.

Each card's place depends on all before it, so a page is folded in order: one row per page, whose cards are an array of a
page's size; pages are independent of each other and spread over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GAP, LEAST_HEIGHT = 10.0, 136.0
#: Width that columns are near to, and how many there are at most (fixed values).
COLUMN_WIDTH, MOST_COLUMNS = 236.0, 12


def grid(width: float, gap: float = GAP, near: float = COLUMN_WIDTH, most: int = MOST_COLUMNS) -> tuple[int, float]:
    """How many columns fit into a width, and how wide each is."""
    n = max(1, min(most, int((width + gap) // (near + gap))))
    return n, (width - (n - 1) * gap) / n


#: Column beside the grid of a detail page, most columns there and most that the panel takes (fixed values).
SIDE_COLUMN, DETAIL_COLUMNS, PANEL_COLUMNS = 52.0, 24, 5


def detail_grid(width: float, gap: float = GAP, near: float = COLUMN_WIDTH) -> tuple[int, float, int]:
    """How many columns a detail page has, how wide each is, and how many of them the image's panel takes."""
    n, each = grid(max(260.0, width - SIDE_COLUMN - gap), gap, near, DETAIL_COLUMNS)
    if n < 5:
        return n, each, max(1, n - 1)
    return n, each, max(3, min(int(n * 0.44 + 0.5), PANEL_COLUMNS, n - 2))


def shortest(heights: Column) -> Column:
    """The first of the lowest columns, counted from 0."""
    return (F.array_position(heights, F.array_min(heights)) - 1).cast("int")


def pack(cards: DataFrame, width: float, start: list[float], gap: float = GAP, least: float = LEAST_HEIGHT) -> DataFrame:
    """(page, id, place, column, x, y, height) of cards (page, place, id, ratio: height over width).

    start: the heights of the columns before the first card; reserved columns begin with what stands in them. With a
    width of 1, a gap of 0.4 and no least height, cards are dealt to columns by ratio alone.
    """
    height = lambda ratio: F.greatest(F.lit(least), F.lit(width) * ratio)
    pages = cards.groupBy("page").agg(F.array_sort(F.collect_list(F.struct("place", "id", height(F.col("ratio")).alias("height")))).alias("cards"))
    placed = "array<struct<place:int,id:bigint,height:double,column:int,y:double>>"
    zero = F.struct(F.array(*(F.lit(float(h)) for h in start)).alias("heights"), F.array().cast(placed).alias("out"))

    def put(held: Column, card: Column) -> Column:
        column = shortest(held["heights"])
        y = F.get(held["heights"], column)
        heights = F.transform(held["heights"], lambda h, k: F.when(k == column, h + card["height"] + gap).otherwise(h))
        item = F.struct(card["place"].cast("int").alias("place"), card["id"].cast("bigint").alias("id"), card["height"].alias("height"), column.alias("column"), y.alias("y"))
        return F.struct(heights.alias("heights"), F.concat(held["out"], F.array(item)).alias("out"))

    folded = pages.select("page", F.explode(F.aggregate("cards", zero, put)["out"]).alias("c")).select("page", "c.*")
    return folded.withColumn("x", F.col("column") * F.lit(width + gap)).select("page", "id", "place", "column", "x", "y", "height")
