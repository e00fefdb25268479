"""Connected components by alternating stars: joins and grouped minima only, in a number of rounds that grows slowly."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import MOST_BROADCAST, materialize, remove


def _star(edges: DataFrame, small: bool, few: bool) -> DataFrame:
    """Link each node's neighbours (small: only the lesser ones and itself) to the least of them and itself.

    Where edges are few, the least neighbours are broadcast. If not, they are a table of their own, with one row a node, so
    that the join to them is one of two shuffled tables: a node with a large share of all edges is split up there.
    """
    both = edges if small else edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    least = F.broadcast(least) if few else materialize(least, "least")
    linked = both.join(least, "a")
    if not small:
        return linked.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
    own = least.select("a", F.col("m").alias("b"))
    return linked.filter(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(own).filter("a <> b").distinct()


def _done(edges: DataFrame) -> bool:
    """Whether every node has one edge to a node that has none: then each component is a star."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("x"), F.lit(1).alias("up")), F.struct(F.col("b").alias("x"), F.lit(0).alias("up")))).alias("e"))
    nodes = ends.groupBy("e.x").agg(F.sum("e.up").alias("up"), F.count(F.lit(1)).alias("n"))
    return nodes.filter((F.col("up") > 1) | ((F.col("up") == 1) & (F.col("n") > 1))).isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b); root is the least node of its component.

    Each round is written to the shared folder, so that a lost executor costs that round's tasks only; the round before
    is deleted then. Loops (a = b) and edges in either direction or more than once are allowed; without edges there are no
    rows, and nulls are no nodes.
    """
    ordered = edges.filter("a is not null and b is not null").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    now = materialize(ordered.filter("a <> b").distinct(), "edges")
    while not _done(now):
        few = now.count() <= MOST_BROADCAST // 2  # a node has two rows at most for each of its edges
        wide = _star(now, small=False, few=few)
        wide = wide if few else materialize(wide, "edges")
        then = materialize(_star(wide, small=True, few=few), "edges")
        remove(now)
        now = then
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionAll(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
