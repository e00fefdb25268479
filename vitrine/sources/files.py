"""JSON lines, URL lists and image files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.media import object_content_type
from ..functions.urls import start_url

IMAGE_GLOB = "*.{jpg,jpeg,png,webp,gif,bmp,JPG,JPEG,PNG,WEBP,GIF,BMP}"


def read_jsonl(spark: SparkSession, path: str, schema: str, *, strict: bool) -> DataFrame:
    """JSON lines of a known schema; a malformed line fails the read if strict, else it is left out."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def write_jsonl(rows: DataFrame, path: str, *, append: bool = False) -> None:
    rows.write.mode("append" if append else "overwrite").json(path)


def parse_jsonl(lines: DataFrame, column: str, schema: str, *, strict: bool) -> DataFrame:
    """Rows of JSON lines that stand in a column; a malformed line fails if strict, else it is left out."""
    mode = "FAILFAST" if strict else "PERMISSIVE"
    row = F.from_json(column, f"{schema}, _bad string", {"mode": mode, "columnNameOfCorruptRecord": "_bad"})
    found = lines.filter(F.length(F.trim(column)) > 0).select(row.alias("r")).filter("r._bad is null")
    return found.select("r.*").drop("_bad")


def distinct_urls(lines: DataFrame, column: str) -> DataFrame:
    """(url, place): the clean addresses of lines (column, place), each at its first place."""
    urls = lines.select(start_url(F.col(column)).alias("url"), "place").filter("url <> ''")
    return urls.groupBy("url").agg(F.min("place").alias("place"))


def read_urls(spark: SparkSession, path: str) -> DataFrame:
    """(url): distinct addresses of the lines of a file; https where no scheme is given."""
    return spark.read.text(path).select(start_url(F.col("value")).alias("url")).filter("url <> ''").distinct()


def image_rows(listed: DataFrame, *, head: int | None = None) -> DataFrame:
    """(path, bytes, hash, content) of listed files (path, content) that have an image ending, by path; the first ones only if head is given."""
    kept = listed.filter(F.lower("path").rlike(r"\.(jpg|jpeg|png|webp|gif|bmp)$"))
    rows = kept.select("path", F.length("content").cast("long").alias("bytes"), F.sha2("content", 256).alias("hash"), "content")
    return rows.orderBy("path").limit(head) if head else rows


def read_images(spark: SparkSession, folder: str, *, recursive: bool = False, head: int | None = None) -> DataFrame:
    """image_rows of the files in a folder, and of those below it if recursive."""
    return image_rows(spark.read.format("binaryFile").option("pathGlobFilter", IMAGE_GLOB).option("recursiveFileLookup", recursive).load(folder), head=head)


def read_object(spark: SparkSession, root: str, key: str) -> DataFrame:
    """(key, content_type, content) of a stored object; a key that is blank or climbs out of the folder is refused."""
    safe = key.replace("\\", "/").lstrip("/")
    if not safe.strip() or ".." in safe:
        raise ValueError(f"no object key: {key!r}")
    rows = spark.read.format("binaryFile").load(f"{root.rstrip('/')}/{safe}")
    return rows.select(F.lit(safe).alias("key"), object_content_type(F.lit(safe)).alias("content_type"), "content")


def has_table(spark: SparkSession, name: str) -> bool:
    return spark.catalog.tableExists(name)


def has_column(rows: DataFrame, name: str) -> bool:
    """Whether there is a column of this name, by the session's rule for case."""
    same = (lambda a: a) if rows.sparkSession.conf.get("spark.sql.caseSensitive") == "true" else str.lower
    return same(name) in map(same, rows.columns)


def read_jdbc(spark: SparkSession, url: str, table: str, key: str, low: int, high: int, partitions: int = 12, **options: str) -> DataFrame:
    """A table of a relational store, read in ranges of a key."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options)
    return reader.option("partitionColumn", key).option("lowerBound", low).option("upperBound", high).option("numPartitions", partitions).load()
