"""Sizes, ratios and names of image files."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

THUMB_WIDTH = 520
#: Longest side that a reduced ratio is shown with (fixed value).
MOST_SIDE = 80
#: Euclid's algorithm needs no more steps for each decimal digit of the lesser number (Lamé's theorem).
_STEPS_A_DIGIT = 5
#: Width and height where the size is unknown, by id (fixed values).
FALLBACK_RATIOS = ("3 / 4.2", "3 / 3.6", "3 / 4.8", "3 / 3.9", "3 / 4.5", "3 / 5.1")
#: File name endings and content types (fixed values).
CONTENT_TYPES = {".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".png": "image/png", ".gif": "image/gif", ".webp": "image/webp", ".bmp": "image/bmp"}


def gcd(a: Column, b: Column) -> Column:
    """Greatest common divisor of two positive whole numbers; the greater comes first, else a step would go into their exchange."""
    start = F.struct(F.greatest(a, b).cast("long").alias("a"), F.least(a, b).cast("long").alias("b"))
    step = lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), F.try_mod(s["a"], s["b"]).alias("b")))
    steps = F.length(F.least(a, b).cast("string")) * _STEPS_A_DIGIT
    return F.aggregate(F.sequence(F.lit(1), steps), start, step)["a"]


def ratio_label(width: Column, height: Column) -> Column:
    """'16:9'; with a reduced side above MOST_SIDE the quotient to 4 digits and ':1'; null unless both are positive."""
    g = gcd(width, height)
    a, b = (width / g).cast("long"), (height / g).cast("long")
    quotient = F.round(width.cast("decimal(20,0)") / height.cast("decimal(20,0)"), 4).cast("decimal(20,4)").cast("string")
    shown = F.regexp_replace(F.regexp_replace(quotient, "0+$", ""), r"\.$", "")
    text = F.when(F.greatest(a, b) > MOST_SIDE, F.concat(shown, F.lit(":1"))).otherwise(F.concat_ws(":", a, b))
    return F.when((width > 0) & (height > 0), text)


def thumb_height(width: Column, height: Column) -> Column:
    """Height of the thumbnail; narrower images keep their size. Halves are rounded up."""
    scaled = F.greatest(F.lit(1).cast("long"), F.round(height.cast("decimal(20,0)") * THUMB_WIDTH / width.cast("decimal(20,0)"), 0).cast("long"))
    return F.when(width > THUMB_WIDTH, scaled).otherwise(height.cast("long"))


def aspect_ratio(width: Column, height: Column, id_: Column) -> Column:
    """'width / height'; without a size one of the fallbacks by id."""
    other = F.element_at(F.array(*map(F.lit, FALLBACK_RATIOS)), (F.abs(id_) % len(FALLBACK_RATIOS) + 1).cast("int"))
    return F.when((width > 0) & (height > 0), F.concat_ws(" / ", width, height)).otherwise(other)


def _ending(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"(\.[A-Za-z0-9]+)$", 1))


def _looked_up(table: dict[str, str], key: Column, other: str) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), key), F.lit(other))


def content_type(name: Column) -> Column:
    """Of a file that is imported, by its ending."""
    return _looked_up(CONTENT_TYPES, _ending(name), "application/octet-stream")


def object_content_type(key: Column) -> Column:
    """Of a stored object, by its ending: a JPEG unless it says otherwise."""
    return _looked_up({e: CONTENT_TYPES[e] for e in (".png", ".gif", ".webp")}, _ending(key), "image/jpeg")


def upload_ending(name: Column, content: Column) -> Column:
    """Ending of an uploaded file: its own if it is one of the usual ones, .jpeg included; else by the content type."""
    own = _ending(name)
    return F.when(own.isin(".jpg", ".jpeg", ".png", ".gif", ".webp"), own).otherwise(_looked_up({"image/png": ".png", "image/gif": ".gif", "image/webp": ".webp"}, content, ".jpg"))


def import_ending(name: Column, content: Column) -> Column:
    """Ending of an imported file: its own if it is one of CONTENT_TYPES, .jpeg as .jpg; else by the content type."""
    own = _ending(name)
    kept = F.when(own == ".jpeg", ".jpg").when(own.isin(*CONTENT_TYPES), own)
    return F.coalesce(kept, _looked_up({"image/png": ".png", "image/webp": ".webp", "image/gif": ".gif"}, content, ".jpg"))


def download_ending(content: Column, otherwise: Column) -> Column:
    """Ending by the content type that a server states, parameters aside; otherwise where it names no image that is taken."""
    kind = F.lower(F.trim(F.get(F.split(content, ";"), F.lit(0))))
    return F.coalesce(F.nullif(_looked_up({v: k for k, v in CONTENT_TYPES.items() if k != ".jpeg"}, kind, ""), F.lit("")), otherwise)


def object_key(day: Column, digest: Column, ending: Column) -> Column:
    """originals/yyyy/MM/dd/<first 20 digits><ending>."""
    return F.concat(F.lit("originals/"), F.date_format(day, "yyyy/MM/dd/"), F.substr(digest, F.lit(1), F.lit(20)), ending)


def safe_key(key: Column) -> Column:
    """An object key with forward slashes and none at the start; null if it is blank or climbs out of its folder."""
    bare = F.ltrim(F.replace(key, F.lit("\\"), F.lit("/")), F.lit("/"))
    return F.when((F.length(F.trim(bare)) > 0) & ~bare.contains(".."), bare)


def public_url(prefix: str, key: Column) -> Column:
    """The address of an object below a prefix, of which one slash at the end is dropped; a local one if it is blank."""
    root = prefix.strip() or "/media/object"
    return F.concat(F.lit(root.removesuffix("/") + "/"), key)


def title_of(file_name: Column, most: int = 160) -> Column:
    """The name without its ending, trimmed; the whole name if nothing is left."""
    stem = F.trim(F.regexp_replace(file_name, r"(?<=.)\.[^.]*$", ""))
    return F.substr(F.when(F.length(stem) > 0, stem).otherwise(file_name), F.lit(1), F.lit(most))
