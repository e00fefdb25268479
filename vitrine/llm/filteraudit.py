"""Filter interaction audit: what each filter removes in every order of the filters, and its Shapley share.

Each document becomes a mask of the filters that it fails; masks are counted by part and label, at most a few hundred cells
a part whatever the number of documents. Every order is visited by swapping two neighbours of the order before it (plain
changes). A swap changes the set of filters between the two only, so that just these two steps are worked out anew from
the cells; a filter's removals are added to its Shapley sum when they change, times the orders for which they held.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import NO_ID, SPACES, ship

#: The filters' letters; a document fails filter k where bit k of its mask is set.
FILTERS = "ABCDE"
SCHEMA = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def failures(text: str, words: str) -> list[Column]:
    """Whether a text (column) with these words (column of arrays) fails filters A to D; E needs other documents."""
    n, distinct, chars = F.size(words), F.size(F.array_distinct(words)), F.char_length(text)
    capitals = chars - F.char_length(F.regexp_replace(text, "[A-Z]+", ""))
    whole = lambda c: c.cast("long")
    return [n < 100, 100 * whole(distinct) < 80 * whole(n), 100 * whole(capitals) > 10 * whole(chars), F.col(text).rlike("[#$%&*|]")]


def mask_cells(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(part, mask, good, toxic, n): how many documents of a part have this mask and these labels.

    Copies are found by SHA-256. Rows meet their labels by id, a row without an id by its digest, as no label is its own;
    copies are counted before they are brought together, so that neither a hot text nor a third of all rows without id
    lands in one task.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"))
    rows = rows.withColumn("words", F.array_remove(F.split("text", f"[{SPACES}]+"), ""))
    mask = sum((F.when(fails, 1 << k).otherwise(0) for k, fails in enumerate(failures("text", "words"))), F.lit(0))
    rows = rows.select("doc_id", "part", mask.alias("mask"), F.unhex(F.sha2("text", 256)).alias("digest")).withColumn("key", F.coalesce("doc_id", F.xxhash64("digest")))
    flag = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)))
    judged = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("label_id")).agg(flag("quality").alias("good"), flag("toxic").alias("toxic"))
    labelled = rows.join(judged, (F.col("key") == F.col("label_id")) & F.col("doc_id").isNotNull(), "left").fillna(False, ["good", "toxic"])
    kind = ["part", "mask", "good", "toxic"]
    order = F.coalesce("doc_id", F.lit(NO_ID))
    by_id = labelled.groupBy("key", "doc_id", "digest", *kind).agg(F.count(F.lit(1)).alias("n"))
    by_text = by_id.groupBy("digest", *kind).agg(F.sum("n").alias("n"), F.min(order).alias("least"), F.min_by("n", order).alias("first"))
    least_of_all = F.min("least").over(Window.partitionBy("digest"))  # a text has one row for each part and label
    both = by_text.withColumn("least_of_all", least_of_all)
    kept = F.when(F.col("least") == F.col("least_of_all"), F.col("first")).otherwise(0)
    split = F.array(F.struct("mask", kept.alias("n")), F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - kept).alias("n")))
    return both.select("part", "good", "toxic", F.explode(split).alias("c")).select("part", "c.mask", "good", "toxic", "c.n").filter("n > 0").groupBy(*kind).agg(F.sum("n").alias("n"))


def neighbour_swaps(n: int) -> Iterator[int]:
    """Places k such that swapping members k and k + 1 in turn visits all n! orders: the last member sweeps to and fro
    through the others, which take one step of their own whenever it has reached an end."""
    if n < 2:
        return
    inner, down = neighbour_swaps(n - 1), True
    while True:
        yield from range(n - 2, -1, -1) if down else range(n - 1)
        step = next(inner, None)
        if step is None:
            return
        yield step + 1 if down else step  # the sweeping member stands first now, or last
        down = not down


def walk(masks: list[int], counts: dict[str, list[int]], filters: str = FILTERS) -> list[tuple]:
    """(filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) of every order and step.

    masks: of the cells; counts: of their documents, by all, good and toxic.
    """
    n, size = len(filters), 1 << len(filters)
    survive = {kind: [sum(c for m, c in zip(masks, of, strict=True) if not m & s) for s in range(size)] for kind, of in counts.items()}
    every = survive["every"]
    fails = [every[0] - every[1 << f] for f in range(n)]
    only = [sum(c for m, c in zip(masks, counts["every"], strict=True) if m == 1 << f) for f in range(n)]
    order, before = list(range(n)), [(1 << k) - 1 for k in range(n)]  # the filters before each step, as masks

    def worked_out(k: int) -> tuple:
        f, s = order[k], before[k]
        after = s | 1 << f
        removed, good, toxic = (survive[kind][s] - survive[kind][after] for kind in ("every", "good", "toxic"))
        return every[after], removed, fails[f] - removed, only[f], good, toxic

    steps = [worked_out(k) for k in range(n)]
    seen, since, shapley = 0, [0] * n, [0] * n  # of each filter: the first order for which its removals hold
    out = [("".join(filters[f] for f in order), tuple(order), list(steps))]
    for k in neighbour_swaps(n):
        seen += 1
        for at in (k, k + 1):
            f = order[at]
            shapley[f] += steps[at][1] * (seen - since[f])
            since[f] = seen
        order[k], order[k + 1] = order[k + 1], order[k]
        before[k + 1] = before[k] | 1 << order[k]
        steps[k], steps[k + 1] = worked_out(k), worked_out(k + 1)
        out.append(("".join(filters[f] for f in order), tuple(order), list(steps)))
    for k, f in enumerate(order):
        shapley[f] += steps[k][1] * (seen + 1 - since[f])
    return [(name, k + 1, *row, shapley[f]) for name, members, rows in out for k, (f, row) in enumerate(zip(members, rows, strict=True))]


def audit(cells: DataFrame) -> DataFrame:
    """SCHEMA of cells (part, mask, good, toxic, n): each part's few cells go to one task, which walks the orders."""
    ship(cells.sparkSession)

    def run(part: pd.DataFrame) -> pd.DataFrame:
        n = [int(x) for x in part["n"]]
        counts = {"every": n, "good": [c * bool(x) for c, x in zip(n, part["good"], strict=True)], "toxic": [c * bool(x) for c, x in zip(n, part["toxic"], strict=True)]}
        rows = walk([int(m) for m in part["mask"]], counts)
        return pd.DataFrame([(part["part"].iloc[0], *r) for r in rows], columns=[c.split()[0] for c in SCHEMA.split(", ")])

    return cells.groupBy("part").applyInPandas(run, SCHEMA)


def filter_audit(docs: DataFrame, labels: DataFrame, **columns: str) -> DataFrame:
    """SCHEMA: one row for each part, order of the filters and step.

    Filters: A under 100 words, B few distinct words, C many capitals, D special characters, E a copy of a document of a
    smaller id anywhere in the table. A null text is empty and so fails A; a null part is the empty string; a null id is
    smaller than all others and has no labels. Rows of the same id are no copies of each other. Repeated labels of an id
    count if any of them is 1; labels without a document count nowhere. Very long texts are single values in an array of
    their words. An empty table gives no rows. Other columns, whatever their names, are ignored.
    """
    return audit(mask_cells(docs, labels, **columns))


ORACLE = r"""
WITH texts AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce("text", '') AS t, list_filter(string_split_regex(coalesce("text", ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words FROM documents),
judged AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
fails AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, len(words) < 100 AS a, 100 * len(list_distinct(words)) < 80 * len(words) AS b,
    100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 10 * length(t) AS c, regexp_matches(t, '[#$%&*|]') AS d,
    coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS e
  FROM texts LEFT JOIN judged USING (doc_id)),
cells AS (
  SELECT part, good, toxic, CASE WHEN a THEN 'A' ELSE '' END || CASE WHEN b THEN 'B' ELSE '' END || CASE WHEN c THEN 'C' ELSE '' END || CASE WHEN d THEN 'D' ELSE '' END || CASE WHEN e THEN 'E' ELSE '' END AS failed, count(*) AS n
  FROM fails GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE b.x <> a.x AND c.x NOT IN (a.x, b.x) AND d.x NOT IN (a.x, b.x, c.x) AND e.x NOT IN (a.x, b.x, c.x, d.x)),
steps AS (SELECT filter_order, CAST(step AS INTEGER) AS step, filter_order[step:step] AS f, filter_order[1:step - 1] AS earlier FROM orders, range(1, 6) r(step)),
results AS (
  SELECT part, filter_order, step, f,
    CAST(sum(CASE WHEN failed = translate(failed, earlier || f, '') THEN n ELSE 0 END) AS BIGINT) AS kept,
    CAST(sum(CASE WHEN contains(failed, f) AND failed = translate(failed, earlier, '') THEN n ELSE 0 END) AS BIGINT) AS removed,
    CAST(sum(CASE WHEN contains(failed, f) AND failed <> translate(failed, earlier, '') THEN n ELSE 0 END) AS BIGINT) AS redundant,
    CAST(sum(CASE WHEN failed = f THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
    CAST(sum(CASE WHEN good = 1 AND contains(failed, f) AND failed = translate(failed, earlier, '') THEN n ELSE 0 END) AS BIGINT) AS good_lost,
    CAST(sum(CASE WHEN toxic = 1 AND contains(failed, f) AND failed = translate(failed, earlier, '') THEN n ELSE 0 END) AS BIGINT) AS toxic_lost
  FROM cells, steps GROUP BY part, filter_order, step, f)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM results
"""
