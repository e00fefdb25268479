"""Pages: bounds on page number and size, and the slice of an ordered DataFrame."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame

#: Largest page of each list (fixed values).
CAPS = {"feed": 60, "similar": 60, "comments": 80, "author": 200, "users": 50, "topics": 50, "tags": 500}
#: Page sizes where none is asked for (fixed values).
DEFAULTS = {"feed": 30, "similar": 24, "comments": 20, "author": 30, "topics": 20, "tags": 100}


class Page(NamedTuple):
    offset: int
    size: int


def clamp_page(page: int, size: int, kind: str) -> Page:
    """Pages count from 1; a size lies between 1 and the list's cap."""
    size = max(1, min(size, CAPS[kind]))
    return Page((max(1, page) - 1) * size, size)


def page_of(rows: DataFrame, order: list[Column], page: Page) -> DataFrame:
    """One page by a total order; Spark keeps the first offset + size rows of each partition only."""
    return rows.orderBy(*order).offset(page.offset).limit(page.size)
