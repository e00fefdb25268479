"""Names, labels and counts as text."""

from __future__ import annotations

import html
import re
import sys
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

# tasks get the functions of this module by value, so that they need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value worked out once, however often use refers to it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def has_text(column: Column, default: str | Column) -> Column:
    """The column, or the default where it is null, empty or blank."""
    return F.when(F.length(F.trim(column)) > 0, column).otherwise(default)


def keep_old(new: Column, old: Column) -> Column:
    """The new value unless it is null or empty."""
    return F.coalesce(F.nullif(new, F.lit("")), old)


def normalize_topic(column: Column) -> Column:
    """Trimmed, without leading hash signs, without white space."""
    return F.regexp_replace(F.regexp_replace(F.trim(column), "^#+", ""), r"\s+", "")


def topic_name(text: str) -> str:
    """normalize_topic of one keyword."""
    return re.sub(r"\s+", "", text.strip().lstrip("#"))


def normalize_tag(column: Column) -> Column:
    """Trimmed, without leading hash signs; what follows them isn't trimmed again."""
    return F.ltrim(F.trim(column), F.lit("#"))


def clean_topics(raw: Column, most: int = 10) -> Column:
    """Distinct raw topics in order, then trimmed and without hash signs; blanks go; the first ones stay."""
    cleaned = F.transform(F.array_distinct(raw), lambda t: F.regexp_replace(F.trim(t), "^#+", ""))
    return F.slice(F.filter(cleaned, lambda t: F.length(F.trim(t)) > 0), 1, most)


def ordered_union(*lists: Column) -> Column:
    """Values of all lists without blanks, each at its first place."""
    return F.filter(F.array_distinct(F.concat(*lists)), lambda x: F.length(F.trim(x)) > 0)


def tolerant_int(column: Column) -> Column:
    """A number in text, cut towards 0; null if it isn't one, or beyond 64 bits."""
    return F.trim(column).try_cast("double").try_cast("bigint")


def as_double(column: Column, default: float) -> Column:
    """A decimal as a double; the default where it is null."""
    return F.coalesce(column.cast("double"), F.lit(default))


def count_text(column: Column) -> Column:
    """Counts as shown: from 1,000 with k, from 10,000 in ten thousands."""
    n = F.greatest(F.coalesce(column, F.lit(0)).cast("decimal(18,0)"), F.lit(0).cast("decimal(18,0)"))
    wan = lambda digits: F.concat(F.round(n / 10_000, digits).cast(f"decimal(18,{digits})").cast("string"), F.lit("万"))
    k = F.concat(F.regexp_replace(F.round(n / 1000, 1).cast("decimal(18,1)").cast("string"), r"\.0$", ""), F.lit("k"))
    return F.when(n >= 100_000, wan(0)).when(n >= 10_000, wan(1)).when(n >= 1000, k).otherwise(n.cast("string"))


def relative_bucket(then: Column, now: Column) -> Column:
    """How long ago, in whole minutes, hours or days below a week; otherwise the date. Null stays empty."""
    s = F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(then.cast("timestamp"))
    part = lambda unit, name: F.concat(F.floor(s / unit).cast("string"), F.lit(name))
    late = F.when(s < 3600, part(60, "分钟前")).when(s < 86_400, part(3600, "小时前")).when(s < 7 * 86_400, part(86_400, "天前"))
    return F.when(then.isNull(), "").when(s < 60, "刚刚").otherwise(F.coalesce(late, F.date_format(then, "yyyy/M/d")))


def slug_text(value: str | None, fallback: str) -> str:
    """Letters and digits of the ASCII form in lower case, joined by dashes; the fallback where none are left."""
    plain = unicodedata.normalize("NFD", value or "").encode("ascii", "ignore").decode().lower()
    return re.sub(r"[^a-z0-9]+", "-", plain).strip("-") or fallback


def slug(column: Column) -> Column:
    """slug_text of the name without blanks and hash signs around it, with 'key-' and a part of its SHA-1 as the fallback.

    A pandas UDF: Spark has no Unicode decomposition.
    """
    name = normalize_tag(F.coalesce(column, F.lit("")))

    @F.pandas_udf("string")
    def run(values: pd.Series, digests: pd.Series) -> pd.Series:
        return pd.Series([slug_text(v, f"key-{d[:16]}") for v, d in zip(values, digests, strict=True)])

    return run(name, F.sha1(name))


def utf16_hash(value: str) -> int:
    """The 32-bit polynomial hash, to the base 31, of a text's UTF-16 units, with its sign."""
    h = 0
    for unit in memoryview(value.encode("utf-16-le")).cast("H"):
        h = (31 * h + unit) & 0xFFFFFFFF
    return h - (h >> 31 << 32)


def topic_slug(column: Column) -> Column:
    """slug_text with 'topic-' and the absolute value of utf16_hash as the fallback (of the least hash its own negative value)."""

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        made = lambda v: slug_text(v, "") or f"topic-{h if (h := utf16_hash(v)) == -(1 << 31) else abs(h)}"
        return values.map(made)

    return run(F.coalesce(column, F.lit("")))


def tag_slug(kind: Column, name: Column) -> Column:
    """The type, a dash, the name's slug."""
    return F.concat_ws("-", kind, slug(name))


def clean_text(column: Column, most: int = 500) -> Column:
    """Entities decoded, NUL removed, white space collapsed, cut. A pandas UDF: Spark decodes no entities."""

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: " ".join(html.unescape(v or "").replace("\0", "").split())[:most])

    return run(F.coalesce(column, F.lit("")))
