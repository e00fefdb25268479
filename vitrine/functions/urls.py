"""URLs of pages and images."""

from __future__ import annotations

import html
import sys
from urllib.parse import unquote, urljoin, urlsplit, urlunsplit

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

# tasks get the functions of this module by value, so that they need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: A path segment that states a size, such as 236x, x600 or 75x75 (fixed values).
SIZE_SEGMENT = r"^(\d+x\d*|x\d+)$"
#: Endings of image files that add to the quality (fixed values).
IMAGE_ENDINGS = r"\.(png|webp|jpg|jpeg)$"
ORIGINALS, ENDING_SCORE = 1_000_000, 10
_PARTS = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return F.regexp_extract(url, _PARTS, 2)


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, _PARTS, 3)


def segments(url: Column) -> Column:
    return F.filter(F.split(path_of(url), "/"), lambda s: s != "")


def normalized(raw: str | None, base: str | None = None) -> str:
    """A clean absolute http(s) URL without fragment and parameters; empty if there is none."""
    text = html.unescape(raw or "").strip().strip("'\"")
    for escaped in ("\\/", "\\u002F", "\\u002f"):
        text = text.replace(escaped, "/")
    text = unquote(text).rstrip(".,;]")
    if text.startswith("//"):
        text = f"https:{text}"
    elif text.startswith("/") and base:
        text = urljoin(base, text)
    try:
        scheme, host, path, query, _ = urlsplit(text)
    except ValueError:
        return ""
    if scheme not in ("http", "https"):
        return ""
    head, slash, last = path.rpartition("/")
    return urlunsplit((scheme, host, head + slash + last.partition(";")[0], query, ""))


def normalize_url(raw: Column, base: Column | None = None) -> Column:
    """normalized, as a pandas UDF: entities and percent codes are beyond Spark's functions."""

    @F.pandas_udf("string")
    def run(values: pd.Series, bases: pd.Series) -> pd.Series:
        return pd.Series([normalized(v, b) for v, b in zip(values, bases, strict=True)])

    return run(raw, base if base is not None else F.lit(""))


def original_url(url: Column, host_ending: str) -> Column:
    """The address of the full-size file where a size segment of at least four shows one of a known host; else empty.

    A leading segment that begins with 'control' is skipped if more than four are there.
    """
    own, parts = F.lower(host_of(url)).endswith(host_ending), segments(url)
    skip = F.when(F.lower(F.get(parts, F.lit(0))).startswith("control") & (F.size(parts) > 4), 1).otherwise(0)
    root = F.concat(F.regexp_extract(url, _PARTS, 1), F.lit("://"), host_of(url))
    larger = F.concat(root, F.lit("/originals/"), F.array_join(F.slice(parts, skip + 2, F.size(parts)), "/"))
    return (
        F.when(~own | (F.size(parts) < 4), "")
        .when(F.lower(F.get(parts, F.lit(0))) == "originals", F.concat(root, path_of(url)))
        .when(F.lower(F.get(parts, skip)).rlike(SIZE_SEGMENT), larger)
        .otherwise("")
    )


def quality_score(url: Column) -> Column:
    """1,000,000 for an original, the largest number of each size segment, 10 for a usual image ending."""
    path = F.lower(path_of(url))
    sizes = F.filter(F.split(F.trim(path, F.lit("/")), "/"), lambda s: s.rlike(SIZE_SEGMENT))
    numbers = F.transform(sizes, lambda s: F.coalesce(F.array_max(F.transform(F.regexp_extract_all(s, F.lit(r"(\d+)")), lambda n: n.try_cast("long"))), F.lit(0).cast("long")))
    total = F.aggregate(numbers, F.lit(0).cast("long"), lambda a, b: a + b)
    return total + F.when(path.contains("/originals/"), ORIGINALS).otherwise(0) + F.when(path.rlike(IMAGE_ENDINGS), ENDING_SCORE).otherwise(0)


def canonical_key(url: Column, host_ending: str) -> Column:
    """SHA-1 of host and path, in lower case, of the full-size address or else of the URL."""
    best = F.coalesce(F.nullif(original_url(url, host_ending), F.lit("")), url)
    return F.sha1(F.trim(F.concat(F.lower(host_of(best)), F.lower(path_of(best)))))


def start_url(raw: Column) -> Column:
    """An address to begin at: https where no scheme is given, '/' for an empty path, no parameters and fragment; empty if it is none."""
    text = F.trim(raw)
    full = F.when(text.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), text).otherwise(F.concat(F.lit("https://"), F.ltrim(text, F.lit("/"))))
    part = lambda g: F.regexp_extract(full, r"^(?i)(https?)://([^/?#]+)([^?#]*)(\?[^#]*)?", g)
    path = F.regexp_replace(F.when(part(3) == "", "/").otherwise(part(3)), ";[^/]*$", "")
    made = F.concat(F.lower(part(1)), F.lit("://"), part(2), path, F.when(part(4) == "?", "").otherwise(part(4)))
    return F.when((F.length(text) > 0) & (part(2) != ""), made).otherwise("")


def resolved(href: Column, page: Column) -> Column:
    """The absolute address of a link on a page, without its fragment; null if it is no http(s) one.

    Dots in paths are followed: '..' drops the segment before it.
    """
    bare, at = F.regexp_replace(F.trim(href), "#.*$", ""), F.regexp_replace(page, "#.*$", "")
    root, folder = F.regexp_extract(at, r"^(https?://[^/?#]*)", 1), F.regexp_extract(at, r"^https?://[^/?#]*([^?]*/)", 1)
    path = F.concat(F.when(folder == "", "/").otherwise(folder), bare)
    target = (
        F.when(bare.rlike("^(?i)https?://"), bare)
        .when(bare.rlike("^[A-Za-z][A-Za-z0-9+.-]*:") | (bare == ""), None)
        .when(bare.startswith("//"), F.concat(F.regexp_extract(at, "^(https?:)", 1), bare))
        .when(bare.startswith("/"), F.concat(root, bare))
        .when(bare.startswith("?"), F.concat(F.regexp_extract(at, r"^([^?]*)", 1), bare))
        .otherwise(F.concat(root, path))
    )
    dotted = F.regexp_extract(target, r"^[^/]*//[^/?]*([^?]*)", 1)
    step = lambda held, s: F.when(s == "..", F.slice(held, F.lit(1), F.greatest(F.size(held) - 1, F.lit(1)))).when(s == ".", held).otherwise(F.array_append(held, s))
    walked = F.array_join(F.aggregate(F.slice(F.split(dotted, "/"), F.lit(2), F.greatest(F.size(F.split(dotted, "/")), F.lit(1))), F.array(F.lit("")), step), "/")
    folder_end = F.when(dotted.rlike(r"/\.{1,2}$") & ~walked.endswith("/"), "/").otherwise("")
    clean = F.concat(F.regexp_extract(target, r"^([^/]*//[^/?]*)", 1), walked, folder_end, F.regexp_extract(target, r"(\?.*)$", 1))
    return F.when(dotted.rlike(r"(^|/)\.{1,2}(/|$)"), clean).otherwise(target)


def srcset(raw: Column) -> Column:
    """The addresses of a srcset, in order, without their descriptors, as they stand there."""
    return F.filter(F.transform(F.split(raw, ","), lambda p: F.get(F.split(F.trim(p), r"\s+"), F.lit(0))), lambda u: u != "")


def srcset_urls(raw: str | None, base: str | None = None) -> list[str]:
    """The clean addresses of a srcset, in order; what is no address is left out."""
    found = [normalized(part.split()[0], base) for part in html.unescape(raw or "").split(",") if part.strip()]
    return [u for u in found if u]


def normalized_srcset(raw: Column, base: Column | None = None) -> Column:
    """srcset_urls, as a pandas UDF."""

    @F.pandas_udf("array<string>")
    def run(values: pd.Series, bases: pd.Series) -> pd.Series:
        return pd.Series([srcset_urls(v, b) for v, b in zip(values, bases, strict=True)])

    return run(raw, base if base is not None else F.lit(""))


def with_originals(urls: Column, host_ending: str) -> Column:
    """Clean addresses, each followed by that of its full-size file, each at its first place."""
    pairs = F.flatten(F.transform(urls, lambda u: F.array(u, original_url(u, host_ending))))
    return F.filter(F.array_distinct(pairs), lambda u: u != "")


def ranked_urls(urls: Column) -> Column:
    """By quality, best first; of equal ones the earlier first."""
    scored = F.transform(urls, lambda u, k: F.struct((-quality_score(u)).alias("less"), k.alias("k"), u.alias("u")))
    return F.transform(F.array_sort(scored), lambda x: x["u"])


def detail_url(url: Column, host_ending: str, folder: str) -> Column:
    """https://www.<host>/<folder>/<digits>/ of a detail page on a known host; else empty."""
    number = F.regexp_extract(path_of(url), rf"(?i)^/{folder}/([0-9]+)(/|$)", 1)
    known = F.lower(host_of(url)).endswith(host_ending) & (number != "")
    return F.when(known, F.concat(F.lit(f"https://www.{host_ending}/{folder}/"), number, F.lit("/"))).otherwise("")


def small_asset(url: Column, least: int = 200) -> Column:
    """Avatars, videos and images that one of the first two segments says are smaller than this on both sides."""
    parts = segments(url)
    sized = F.filter(F.slice(parts, 1, 2), lambda s: s.rlike(r"(?i)^\d+x\d+(_[A-Z]+)?$"))
    first = F.get(sized, F.lit(0))
    return F.when(F.size(parts) == 0, True).when(F.lower(parts[0]).isin("avatars", "videos"), True).otherwise(F.coalesce(F.greatest(*(F.regexp_extract(first, r"^(\d+)[xX](\d+)", g).try_cast("int") for g in (1, 2))) < least, F.lit(False)))


def allowed_image(url: Column, host: str | None = None) -> Column:
    """http(s) URLs with an image ending; if a host is given, of it and the hosts below it only, on any port, and no small assets."""
    image = url.rlike("^https?://") & F.lower(path_of(url)).rlike(r"\.(jpg|jpeg|png|webp|gif|bmp)$")
    named = F.substring_index(F.lower(host_of(url)), ":", 1)
    return image if host is None else image & ((named == host) | named.endswith(f".{host}")) & ~small_asset(url)


def first_address(*columns: Column) -> Column:
    """The first address of a chain that isn't null or empty; empty if there is none."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in columns), F.lit(""))
