"""Mixing of sources to target weights by Pareto order sampling, with DataFrame operations only.

Targets: the sources share out a multiple of all words by weight; a source that would go beyond its cap stays at the cap
and the others share the excess. With the sources in order of cap per weight this is one level, found by running sums.

Selection: a source whose target is r times its size takes every document floor(r) times for certain, and draws the rest
of the words without replacement, with odds that differ among its documents: the inclusion odds p grow with a document's
size, p = min(1, scale * size), and the scale is such that the expected words, the sum of p * size, are the words to draw.
Documents with p = 1 are certain whole copies too. Each other document's rank is its random odds u / (1 - u), u from its
id, over its inclusion odds p / (1 - p); the smallest ranks are taken until the words are reached, the last one in part.
The scale comes from counts per source and size by running sums. The cut is found by a histogram of ranks per source
(summed before the shuffle), then by sorting the one bin that the cut falls in; with as many bins as the square root of
the rows, both stay small for a source that holds most of the corpus. Windows over all sources hold one row a source and
run in one task: sources are expected in thousands, not in millions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import SPACES, materialize

WEIGHTS = (3, 1, 2)
LEAST_BINS = 64


def word_count(text: Column) -> Column:
    """The number of runs of characters that aren't white space."""
    runs = F.char_length(F.regexp_replace(text, rf"[{SPACES}]*+[^{SPACES}]++[{SPACES}]*+", "x"))
    return F.when(text.rlike(rf"[^{SPACES}]"), runs).otherwise(0).cast("long")


def rank_uniform(id_col: Column, seed: int) -> Column:
    """A number between 0 and 1, both excluded, that depends on the id alone."""
    return (F.shiftrightunsigned(F.xxhash64(id_col, F.lit(seed)), 11).cast("double") + 0.5) / float(1 << 53)


def source_targets(sizes: DataFrame, weights: tuple[int, ...], total_share: float, cap: float) -> DataFrame:
    """From (source, size) per document: source, source_size, target."""
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    position = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(position, F.lit(len(weights))) + 1).cast("int")).cast("double")
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    weighed = sources.withColumn("weight", weight).withColumn("limit", F.col("source_size") * F.lit(cap))
    share = weighed.withColumn("wanted", F.sum("source_size").over(every) * F.lit(total_share)).withColumn("full_at", F.col("limit") / F.col("weight"))
    lower = Window.orderBy("full_at", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    upper = Window.orderBy("full_at", F.col("source").asc_nulls_last()).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (F.col("wanted") - F.coalesce(F.sum("limit").over(lower), F.lit(0.0))) / F.sum("weight").over(upper)
    # the level that holds is the first that leaves its own source, and so all after it, below the cap
    levelled = share.withColumn("level", level).withColumn("held", F.min(F.when(F.col("level") < F.col("full_at"), F.struct("full_at", "level"))).over(every))
    target = F.coalesce(F.least(F.col("limit"), F.col("weight") * F.col("held.level")), F.col("limit"))
    return levelled.select("source", "source_size", target.alias("target"))


def draw_scales(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """(ss, scale): per source that draws rest words the scale of its inclusion odds min(1, scale * size).

    Sizes above the one that a row of the running sums stands for are certain there; the first that leaves its own size
    uncertain, from the largest down, is the one that holds. There are as many rows as different sizes in a source.
    """
    sizes = rows.filter("size > 0").groupBy("source", "size").agg(F.count(F.lit(1)).cast("double").alias("n"))
    wanted = plan.filter("rest > 0").select("s", "rest")
    found = sizes.join(wanted, F.col("source").eqNullSafe(F.col("s")))
    by_size = Window.partitionBy("s").orderBy(F.desc("size"))
    certain = F.coalesce(F.sum(F.col("n") * F.col("size")).over(by_size.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    squares = F.sum(F.col("n") * F.col("size") * F.col("size")).over(by_size.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    scaled = found.withColumn("scale", (F.col("rest") - certain) / squares)
    # the least size always holds; a rounding error there must not leave a source without a scale
    holds = F.when(F.col("scale") * F.col("size") <= 1, F.col("size")).otherwise(-F.col("size"))
    return scaled.groupBy(F.col("s").alias("ss")).agg(F.max_by("scale", holds).alias("scale"))


def _ranked(rows: DataFrame, plan: DataFrame, seed: int) -> DataFrame:
    """rows with their source's columns of plan, p and rank: random odds over inclusion odds; null where nothing is drawn."""
    u = rank_uniform(F.coalesce(F.col("doc_id"), F.lit(-1)), seed)
    found = rows.withColumn("_u", u).join(plan, F.col("source").eqNullSafe(F.col("s")))
    found = found.withColumn("p", F.when(F.col("size") > 0, F.least(F.lit(1.0), F.col("scale") * F.col("size"))))
    odds = F.when(F.col("p") >= 1, F.lit(0.0)).otherwise((F.col("_u") / (1 - F.col("_u"))) * ((1 - F.col("p")) / F.col("p")))
    return found.withColumn("rank", F.when(F.col("p") > 0, odds)).drop("_u")


def sampling_plan(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, total_share: float = 1.5, cap: float = 2.0, seed: int = 7) -> DataFrame:
    """Per source (s): source_size, target, copies (whole ones for certain), scale, edge (rank where the cut falls), part.

    rows: doc_id, source, size. part is the share of the words that documents at the edge give.
    """
    plan = source_targets(rows, weights, total_share, cap)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    plan = plan.withColumn("copies", F.floor(ratio)).withColumn("rest", F.floor(F.col("target") - F.col("copies") * F.col("source_size")))
    plan = materialize(plan, "targets").withColumnRenamed("source", "s")
    plan = materialize(plan.join(draw_scales(rows, plan), F.col("s").eqNullSafe(F.col("ss")), "left").drop("ss"), "scales")
    bins = max(LEAST_BINS, math.isqrt(rows.count()))
    # ranks lie between 0 and infinity; times the odds of a document of the mean size and as x / (1 + x) they spread over 0 to 1 in the same order
    spread = F.col("rank") * (F.col("rest") / (F.col("source_size") - F.col("rest")))
    drawn = _ranked(rows, plan, seed).filter(F.col("rank").isNotNull()).withColumn("bin", F.least(F.floor(spread / (1 + spread) * bins), F.lit(bins - 1)))
    sums = drawn.groupBy("s", "bin").agg(F.sum("size").alias("words"), F.first("rest").alias("rest"))
    until = F.sum("words").over(Window.partitionBy("s").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    cut = sums.withColumn("until", until).filter((F.col("until") >= F.col("rest")) & (F.col("until") - F.col("words") < F.col("rest")))
    cut = cut.select(F.col("s").alias("cs"), F.col("bin").alias("cut_bin"), (F.col("rest") - F.col("until") + F.col("words")).alias("in_bin"))
    inside = drawn.join(cut, F.col("s").eqNullSafe(F.col("cs")) & (F.col("bin") == F.col("cut_bin")))
    ties = inside.groupBy("s", "rank").agg(F.sum("size").alias("words"), F.first("in_bin").alias("in_bin"))
    until = F.sum("words").over(Window.partitionBy("s").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    edge = ties.withColumn("until", until).filter((F.col("until") >= F.col("in_bin")) & (F.col("until") - F.col("words") < F.col("in_bin")))
    edge = edge.select(F.col("s").alias("es"), F.col("rank").alias("edge"), ((F.col("in_bin") - F.col("until") + F.col("words")) / F.col("words")).alias("part"))
    return materialize(plan.join(edge, F.col("s").eqNullSafe(F.col("es")), "left").drop("es", "rest"), "plan")


def with_taken(rows: DataFrame, plan: DataFrame, seed: int = 7) -> DataFrame:
    """rows (doc_id, source, size and others) with the source's columns of plan and taken, the words that the mix takes."""
    extra = F.when(F.col("rank") < F.col("edge"), F.col("size")).when(F.col("rank") == F.col("edge"), F.round(F.col("size") * F.col("part"))).otherwise(0)
    return _ranked(rows, plan, seed).withColumn("taken", (F.col("copies") * F.col("size") + F.coalesce(extra, F.lit(0))).cast("long"))


def _sizes(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(text).alias("size"))


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **plan) -> DataFrame:
    """Per row: doc_id, size, source, source_size, target, taken (words, repeats counted). plan: as for sampling_plan.

    Null texts have size 0 and are never taken; null ids and null sources are values of their own; rows with one id and
    size in one source share a rank, and where the cut falls on them they divide its words. Very long texts are counted
    where they are; nothing but sizes is shuffled. An empty table gives no rows. Other columns of docs are ignored,
    whatever their names. Reruns give the same rows: ranks depend on ids and sizes alone.
    """
    rows = materialize(_sizes(docs, id_col, text_col, source_col), "sizes")
    found = with_taken(rows, sampling_plan(rows, **plan), plan.get("seed", 7))
    return found.select("doc_id", "size", "source", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame, **plan) -> DataFrame:
    """The documents that the mix takes, each as often as it is taken; the last copy may end early, at a word.

    docs: doc_id, text, source, n_chars and any others; the columns stay, and n_chars follows the text. What mix says of
    nulls, ties and repeated rows holds; an empty table stays empty.
    """
    rows = materialize(_sizes(docs, "doc_id", "text", "source"), "sizes")
    names = [c for c in docs.columns if c not in ("doc_id", "text", "source", "n_chars")]
    kept = F.struct(*(F.col(f"`{c}`") for c in names)).alias("other") if names else F.lit(None).alias("other")
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "text", word_count(F.coalesce("text", F.lit(""))).alias("size"), kept)
    found = with_taken(sized, sampling_plan(rows, **plan), plan.get("seed", 7)).filter("taken > 0")
    whole, rest = F.floor(F.col("taken") / F.col("size")), F.col("taken") % F.col("size")
    pieces = F.concat(F.array_repeat(F.col("size"), whole.cast("int")), F.when(rest > 0, F.array(rest)).otherwise(F.array().cast("array<long>")))
    words = F.split(F.regexp_replace("text", f"^[{SPACES}]+", ""), f"[{SPACES}]+")
    text = F.when(F.col("words") == F.col("size"), F.col("text")).otherwise(F.array_join(F.slice(words, F.lit(1), F.col("words").cast("int")), " "))
    copies = found.withColumn("words", F.explode(pieces)).withColumn("text", text).withColumn("n_chars", F.char_length("text").cast("long"))
    return copies.select(*(F.col(f"other.`{c}`") if c in names else F.col(c) for c in docs.columns))
