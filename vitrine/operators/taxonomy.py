"""Labels from a model's JSON, and find-or-create of the vocabulary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import keep_old, let, normalize_tag, slug
from ..plans.session import shared

MOST_TAGS, MOST_LEVELS, DEFAULT_CONFIDENCE = 24, 4, 0.8
_TAG = "struct<type:string,name:string,label:string,confidence:string>"
SCHEMA = f"description string, categoryPath string, category_path string, categories string, tags array<{_TAG}>"


def json_object(text: Column) -> Column:
    """The first JSON object in a model's answer: code fences and words around it go; null if there is none."""
    valid = lambda c: F.when(c.startswith("{") & F.get_json_object(c, "$").isNotNull(), c)
    bare = F.trim(F.regexp_replace(F.trim(text), r"^```(?:json)?\s*|\s*```$|^json\s*", ""))
    return let(bare, lambda b: F.coalesce(valid(b), let(F.regexp_extract(b, r"(?s)(\{.*\})", 1), valid)))


def _path(parsed: Column) -> Column:
    """Levels of a category path: a JSON array, or names between '/' or '>'. It is cut before hash signs go, so that a level of such alone counts."""
    raw = F.coalesce(*(F.nullif(parsed[c], F.lit("")) for c in ("categoryPath", "category_path", "categories")), F.lit(""))
    listed = lambda r: F.when(r.startswith("["), F.coalesce(F.from_json(r, "array<string>"), F.array().cast("array<string>"))).otherwise(F.split(r, r"[/>]"))
    full = lambda names: F.filter(names, lambda x: F.length(x) > 0)
    levels = F.slice(full(F.transform(let(raw, listed), lambda x: F.trim(x))), 1, MOST_LEVELS)
    return full(F.transform(levels, normalize_tag))


def confidence(value: Column) -> Column:
    """Between 0 and 1; the default where it is missing or no number. Not-a-number counts as 1."""
    number = F.coalesce(value.try_cast("double"), F.lit(DEFAULT_CONFIDENCE))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), number))


def _tag(t: Column) -> Column:
    name = F.coalesce(F.nullif(t["name"], F.lit("")), t["label"], F.lit(""))
    return F.struct(normalize_tag(F.coalesce(t["type"], F.lit(""))).alias("type"), normalize_tag(name).alias("name"), confidence(t["confidence"]).alias("confidence"))


def normalized_annotation(text: Column) -> Column:
    """struct(description, path, tags) of a model's answer; null if it has no object. Tags are cut before blanks go.

    Each step is bound once, so that an answer is parsed a single time.
    """

    def shaped(parsed: Column) -> Column:
        tags = F.transform(F.slice(F.coalesce(parsed["tags"], F.array().cast(f"array<{_TAG}>")), 1, MOST_TAGS), _tag)
        kept = F.filter(tags, lambda t: (F.length(t["type"]) > 0) & (F.length(t["name"]) > 0))
        return F.struct(normalize_tag(F.coalesce(parsed["description"], F.lit(""))).alias("description"), _path(parsed).alias("path"), kept.alias("tags"))

    return let(json_object(text), lambda j: F.when(j.isNotNull(), let(F.from_json(j, SCHEMA), shaped)))


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """rows with n, from 1 without gaps in the order given, which should be a total one.

    Rows are sorted into ranges, which Spark draws from a sample, and counted there; each range then begins after the rows
    of the ranges before. So names with one beginning are spread like any others.
    """
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_range", F.spark_partition_id())
    ranged = shared(ranged.withColumn("_place", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
    counts = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_rows"))
    before = counts.select("_range", (F.sum("_rows").over(Window.orderBy("_range")) - F.col("_rows")).alias("_before"))
    return ranged.join(before, "_range").withColumn("n", F.col("_before") + F.col("_place") + 1).drop("_range", "_place", "_rows", "_before")


def _next_id(existing: DataFrame) -> int:
    return existing.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]


def assign_ids(existing: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """Ids for the names of wanted that existing (id, key) lacks: above its largest id, dense, in order of the name."""
    new = wanted.select(key).filter(F.col(key).isNotNull()).distinct().join(existing.select(key), key, "left_anti")
    return numbered(new, key).select((F.lit(_next_id(existing)) + F.col("n")).cast("long").alias("id"), key)


def ensure_paths(categories: DataFrame, paths: DataFrame) -> DataFrame:
    """The categories (id, name, parent_id, slug, sort_no) that paths (path: names from the top) need and categories lacks.

    Names are cleaned as tags are, and blank ones and those met before on the path go. Level by level, a name is looked up
    under its parent (none at the top) and made if it isn't there, with the slugs of the path and ten times its level as
    the order. Ids go on above the largest one. Of several categories with one name and parent the least id counts.
    """
    names = F.array_distinct(F.filter(F.transform("path", normalize_tag), lambda x: F.length(x) > 0))
    left = paths.select(names.alias("names")).distinct().withColumns({"parent_id": F.lit(None).cast("long"), "slugs": F.lit(None).cast("string")})
    known, made = categories.select("id", "name", "parent_id"), None
    for level in range(MOST_LEVELS):
        left = left.filter(F.size("names") > level).withColumn("name", F.get("names", F.lit(level)))
        left = left.withColumn("slugs", F.concat_ws("-", "slugs", slug(F.col("name"))))
        asked = left.select("name", "parent_id", "slugs").distinct()
        there = known.groupBy(F.col("name").alias("n"), F.col("parent_id").alias("p")).agg(F.min("id").alias("id"))
        found = asked.join(there, (F.col("name") == F.col("n")) & F.col("parent_id").eqNullSafe(F.col("p")), "left").drop("n", "p")
        first = _next_id(known if made is None else known.unionByName(made.select("id", "name", "parent_id")))
        new = numbered(found.filter("id is null").drop("id"), "parent_id", "name").withColumn("id", (F.lit(first) + F.col("n")).cast("long")).drop("n")
        rows = new.select("id", "name", "parent_id", F.col("slugs").alias("slug"), F.lit(level * 10).alias("sort_no"))
        made = rows if made is None else made.unionByName(rows)
        known = known.unionByName(rows.select("id", "name", "parent_id"))
        ids = found.filter("id is not null").select("name", F.col("parent_id").alias("p"), "id").unionByName(new.select("name", F.col("parent_id").alias("p"), "id"))
        stepped = left.withColumnRenamed("name", "own").join(ids, (F.col("own") == F.col("name")) & F.col("parent_id").eqNullSafe(F.col("p")))
        left = shared(stepped.select("names", F.col("id").alias("parent_id"), "slugs"))
    return made


def category_of_path(categories: DataFrame, paths: DataFrame) -> DataFrame:
    """(id, category_id) of paths (id, path) whose names lead from the top through categories; null where one is missing."""
    names = F.array_distinct(F.filter(F.transform("path", normalize_tag), lambda x: F.length(x) > 0))
    at = paths.select("id", names.alias("names"), F.lit(None).cast("long").alias("category_id"), F.lit(True).alias("on"))
    there = categories.groupBy(F.col("name").alias("n"), F.col("parent_id").alias("p")).agg(F.min("id").alias("next"))
    for level in range(MOST_LEVELS):
        name, more = F.get("names", F.lit(level)), F.size("names") > level
        at = at.join(there, more & F.col("on") & (name == F.col("n")) & F.col("category_id").eqNullSafe(F.col("p")), "left")
        at = at.select("id", "names", F.when(more, F.col("next")).otherwise(F.col("category_id")).alias("category_id"), (F.col("on") & (~more | F.col("next").isNotNull())).alias("on"))
    return at.select("id", F.when(F.col("on"), F.col("category_id")).alias("category_id"))


def annotated(images: DataFrame, found: DataFrame) -> DataFrame:
    """images (id, category_id, description) with what found (the same columns) gives; null and, in texts, blank leave the old value."""
    new = found.select(F.col("id").alias("fid"), F.col("category_id").alias("new_category"), F.col("description").alias("new_description"))
    joined = images.join(new, F.col("id") == F.col("fid"), "left")
    return joined.select("id", F.coalesce("new_category", "category_id").alias("category_id"), keep_old(F.col("new_description"), F.col("description")).alias("description"))


def slug_collisions(names: DataFrame, slug: Column) -> DataFrame:
    """Slugs that different names share, with how many."""
    return names.withColumn("slug", slug).groupBy("slug").agg(F.count_distinct("name").alias("names")).filter("names > 1")
