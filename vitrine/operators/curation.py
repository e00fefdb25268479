"""Ingestion: candidates, deduplication that merges, resumption, content hashes, crawling of a link table."""

from __future__ import annotations

import sys
from html.parser import HTMLParser

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clean_text, ordered_union, tolerant_int
from ..functions.urls import allowed_image, canonical_key, detail_url, normalize_url, normalized_srcset, quality_score, ranked_urls, resolved, srcset, with_originals
from ..plans.session import shared

# tasks get the functions of this module by value, so that they need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def with_keys(candidates: DataFrame, host_ending: str) -> DataFrame:
    """candidates (url) with key and score."""
    return candidates.withColumns({"key": canonical_key(F.col("url"), host_ending), "score": quality_score(F.col("url"))})


#: Places in the order of candidates that one part of a key spans.
PART_PLACES = 100_000


def merge_candidates(candidates: DataFrame, most: int | None = None) -> DataFrame:
    """One row per key: key, url, detail_url, fallbacks, first_seq, in the order in which keys appear.

    candidates: key, score, seq (a place in the whole order), url, detail_url, fallbacks. The first row of the largest score
    wins. Each row that beats all before it, a record, takes over the former winner's address and fallbacks behind it. The
    winner's detail page counts; if it has none, the first one of a later row.

    A key's rows are split into parts of PART_PLACES places: running maxima within parts, and of parts, find the records
    without gathering a hot key in one task. What is gathered per key is its records, which are few, and for each part
    and record the first detail page after it.
    """
    parted = candidates.withColumn("_part", F.floor(F.col("seq") / PART_PLACES))
    tops = parted.groupBy("key", "_part").agg(F.max("score").alias("_top"))
    ahead = Window.partitionBy("key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select("key", "_part", F.max("_top").over(ahead).alias("_above"))
    within = Window.partitionBy("key", "_part").orderBy("seq")
    best = F.greatest(F.max("score").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.col("_above"))
    rows = parted.join(tops, ["key", "_part"]).withColumn("record", F.coalesce(F.col("score") > best, F.lit(True)))
    rows = rows.withColumn("_after", F.sum(F.col("record").cast("int")).over(within))
    found = rows.groupBy("key", "_part", "_after").agg(
        F.min(F.when(F.col("record"), F.struct("seq", "url", "detail_url", "fallbacks"))).alias("record"),
        F.min(F.when(~F.col("record") & (F.col("detail_url") != ""), F.struct("seq", "detail_url"))).alias("detail"),
    )
    grouped = found.groupBy("key").agg(F.array_sort(F.collect_list("record")).alias("records"), F.array_sort(F.collect_list("detail")).alias("details"))
    first = F.struct(F.col("records")[0]["url"].alias("url"), F.col("records")[0]["fallbacks"].alias("fb"))

    def take_over(held: Column, new: Column) -> Column:
        return F.struct(new["url"].alias("url"), ordered_union(F.array(held["url"]), held["fb"], new["fallbacks"]).alias("fb"))

    folded = F.aggregate(F.slice("records", F.lit(2), F.size("records")), first, take_over)
    winner = F.element_at("records", F.lit(-1))
    later = F.get(F.filter("details", lambda d: d["seq"] > winner["seq"]), F.lit(0))["detail_url"]
    detail = F.when(winner["detail_url"] != "", winner["detail_url"]).otherwise(F.coalesce(later, F.lit("")))
    out = grouped.select("key", winner["url"].alias("url"), detail.alias("detail_url"), folded["fb"].alias("fallbacks"), F.col("records")[0]["seq"].alias("first_seq"))
    return out if most is None else out.orderBy("first_seq").limit(most)


def not_done(candidates: DataFrame, done: DataFrame) -> DataFrame:
    """Candidates whose key isn't among the finished ones."""
    return candidates.join(done.select("key"), "key", "left_anti")


def new_contents(files: DataFrame, stored: DataFrame) -> DataFrame:
    """Of files (hash, path) those whose content is neither stored nor in a file of an earlier path.

    The first path of a content is its least one, found by partial minima, so that many copies cost one row per task.
    """
    first = files.groupBy("hash").agg(F.min("path").alias("path"), F.count(F.lit(1)).alias("copies"))
    return first.join(stored.select("hash"), "hash", "left_anti")


def latest_jobs(results: DataFrame) -> DataFrame:
    """Of rows (id, seq, ok, path) the last good one of each id, with the place where the id first appeared."""
    good = results.filter("ok and id is not null and path is not null")
    return good.groupBy("id").agg(F.max_by("path", "seq").alias("path"), F.min("seq").alias("first_seq"))


def settled_round(rounds: DataFrame, needed: int = 4) -> DataFrame:
    """Per page (page, round, n) the first round that ends a run of so many rounds without a change of n; n starts from 0."""
    order = Window.partitionBy("page").orderBy("round")
    same = rounds.withColumn("same", F.col("n") == F.lag("n", 1, 0).over(order))
    run = same.withColumn("run", F.sum(F.when(F.col("same"), 0).otherwise(1)).over(order))
    length = F.sum(F.when(F.col("same"), 1).otherwise(0)).over(Window.partitionBy("page", "run").orderBy("round"))
    return run.withColumn("length", length).filter(F.col("length") >= needed).groupBy("page").agg(F.min("round").alias("round"))


def run_summary(results: DataFrame) -> DataFrame:
    return results.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def links(pages: DataFrame) -> DataFrame:
    """(source, target) of the anchors of pages (url, html): absolute addresses without fragments."""
    page = F.regexp_replace("url", "#.*$", "")
    href = F.explode(F.regexp_extract_all("html", F.lit(r'<a\s[^>]*?href="([^"#]+)')))
    return pages.select(page.alias("source"), href.alias("href")).select("source", resolved(F.col("href"), F.col("source")).alias("target")).filter("target is not null").distinct()


def crawl(edges: DataFrame, seeds: DataFrame, rounds: int, most: int | None = None) -> DataFrame:
    """(url, depth) of what the seeds (url) reach in so many rounds over edges (source, target); at most so many if given.

    Each round joins the frontier to the links and drops what was met before; rounds are checkpointed in the shared folder.
    """
    seen = shared(seeds.select("url", F.lit(0).alias("depth")).distinct())
    frontier = seen
    for depth in range(1, rounds + 1):
        found = frontier.join(edges, frontier["url"] == edges["source"]).select(F.col("target").alias("url")).distinct().join(seen, "url", "left_anti")
        frontier = shared(found.withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen if most is None else seen.orderBy("depth", "url").limit(most)


class _Images(HTMLParser):
    """Image elements of a page in order: kind, src, srcset, alt, width, height, and the address of the link around them."""

    def __init__(self) -> None:
        super().__init__()
        self.around: list[str | None] = []
        self.found: list[tuple] = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        own = {k: v or "" for k, v in reversed(attrs)}
        if tag == "a":
            self.around.append(own.get("href"))
        elif tag == "img":
            link = next((h for h in reversed(self.around) if h is not None), "")
            self.found.append((tag, own.get("src", ""), own.get("srcset", ""), own.get("alt", ""), own.get("width"), own.get("height"), link))
        elif (tag == "source" and "srcset" in own) or (tag == "link" and own.get("as") == "image"):
            self.found.append((tag, own.get("href", ""), own.get("srcset") or own.get("imagesrcset", ""), "", None, None, ""))

    def handle_endtag(self, tag: str) -> None:
        if tag == "a" and self.around:
            self.around.pop()


_IMAGE = "array<struct<kind:string,src:string,srcset:string,alt:string,width:string,height:string,detail:string>>"


def dom_images(html: Column) -> Column:
    """The image elements of a page, as a pandas UDF: which link stands around an image is beyond regular expressions."""

    @F.pandas_udf(_IMAGE)
    def run(pages: pd.Series) -> pd.Series:
        out = []
        for page in pages:
            parser = _Images()
            parser.feed(page or "")
            parser.close()
            out.append([dict(zip(("kind", "src", "srcset", "alt", "width", "height", "detail"), x, strict=True)) for x in parser.found])
        return pd.Series(out)

    return run(html)


def page_candidates(pages: DataFrame, host_ending: str, folder: str, *, upgrade: bool = True) -> DataFrame:
    """(source, place, url, fallbacks, detail_url, alt, width, height) of the images that pages (url, html) show or offer.

    Of an element's addresses, those of the srcset before src, and of their full-size files (upgrade), the best one counts
    and the others are its fallbacks. Elements without an address that is taken from a known host are left out.
    """
    item = F.posexplode(dom_images(F.col("html"))).alias("place", "x")
    rows = pages.select(F.col("url").alias("source"), item).select("source", "place", "x.*")
    listed = F.concat(normalized_srcset(F.col("srcset"), F.col("source")), F.filter(F.array(normalize_url(F.col("src"), F.col("source"))), lambda u: u != ""))
    own = rows.withColumn("urls", F.array_distinct(listed))
    ranked = ranked_urls(with_originals(F.col("urls"), host_ending) if upgrade else F.col("urls"))
    own = own.withColumn("ranked", ranked).withColumn("best", F.get("ranked", F.lit(0))).filter(allowed_image(F.col("best"), host_ending))
    detail = detail_url(normalize_url(F.col("detail"), F.col("source")), host_ending, folder)
    others = F.filter(F.slice("ranked", F.lit(2), F.size("ranked")), lambda u: u != F.col("best"))
    return own.select("source", "place", F.col("best").alias("url"), others.alias("fallbacks"), detail.alias("detail_url"), clean_text(F.col("alt")).alias("alt"), tolerant_int(F.col("width")).alias("width"), tolerant_int(F.col("height")).alias("height"))


def completed_keys(results: DataFrame, host_ending: str) -> DataFrame:
    """(key): the distinct keys of the results (ok, image_url) that succeeded, for not_done."""
    done = results.filter("ok and image_url is not null and image_url <> ''")
    return done.select(canonical_key(F.col("image_url"), host_ending).alias("key")).distinct()


def page_images(pages: DataFrame) -> DataFrame:
    """(source, kind, url, alt) of the images that pages (url, html) show or offer: src, srcset and preloaded ones."""
    tag = F.explode(F.regexp_extract_all("html", F.lit(r"(?is)(<(?:img|source|link)\s[^>]*>)")))
    rows = pages.select(F.col("url").alias("source"), tag.alias("tag"))
    value = lambda name: F.regexp_extract("tag", rf"(?is)\s{name}\s*=\s*[\"']([^\"']*)", 1)
    kind = F.lower(F.regexp_extract("tag", "(?i)<([a-z]+)", 1))
    named = rows.select("source", kind.alias("kind"), value("src").alias("src"), value("srcset").alias("set"), value("alt").alias("alt"), value("href").alias("href"), F.lower(value("as")).alias("as"))
    shown = F.filter(F.concat(F.array(F.when(F.col("kind") == "img", F.col("src")).when((F.col("kind") == "link") & (F.col("as") == "image"), F.col("href")).otherwise("")), srcset(F.col("set"))), lambda u: u != "")
    return named.select("source", "kind", F.explode(F.array_distinct(shown)).alias("url"), "alt")


def new_keys(found: DataFrame, known: DataFrame) -> DataFrame:
    """How many keys of found are new."""
    return found.select("key").distinct().join(known.select("key"), "key", "left_anti").agg(F.count(F.lit(1)).alias("added"))
