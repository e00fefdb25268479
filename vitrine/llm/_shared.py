"""What the operators of this subpackage share: scratch tables and shipping of the package to executors."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ROOT = Path(__file__).resolve().parents[1]
#: White space as the contracts of this subpackage define it.
SPACES = r"\x20\x09-\x0D"

_shipped: set[str] = set()
_made: dict[str, str] = {}


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that Python tasks import it by name."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    folder = tempfile.mkdtemp(prefix="vitrine-")
    target = os.path.join(folder, "vitrine_llm_code.zip")
    with zipfile.ZipFile(target, "w") as out:
        for path in sorted(ROOT.rglob("*.py")):  # the whole package, as this copy comes first in the tasks' search path
            out.write(path, path.relative_to(ROOT.parent))
    spark.sparkContext.addPyFile(target)
    _shipped.add(app)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name below spark.checkpoint.dir, which all executors share.

    Where that is unset and the master is local, as in tests, it is a local folder; on a cluster that is an error.
    """
    app = spark.sparkContext.applicationId
    if app not in _made:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            base = tempfile.mkdtemp(prefix="vitrine-scratch-")
            spark.sparkContext.setCheckpointDir(base)
        _made[app] = f"{base}/vitrine-{uuid.uuid4().hex[:12]}"
        atexit.register(_remove, spark, _made[app])
    return f"{_made[app]}/{name}-{uuid.uuid4().hex[:8]}"


def _remove(spark: SparkSession, folder: str) -> None:
    try:
        _delete(spark, folder)
    except Exception:  # the JVM may be gone already at exit
        pass


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back: it is computed once and its lineage ends."""
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def remove(df: DataFrame) -> None:
    """Delete the folder of a table that materialize gave and nothing reads any more."""
    _delete(df.sparkSession, df.scratch_path)


def free_name(name: str, taken: list[str]) -> str:
    """The name, or one with underscores before it where columns have it already."""
    while name.lower() in {t.lower() for t in taken}:
        name = f"_{name}"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text"):
    """The text; a null counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


#: Stands for a null document id in comparisons: null comes first.
NO_ID = -(2**63)


#: Keys of rows to drop that are broadcast at most, some 100 bytes each; more are joined by a shuffle.
MOST_BROADCAST = 200_000


def keep_rows(docs: DataFrame, rows: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows of docs whose (doc_id, xxhash64 of text) is in kept, one row for each of them.

    rows: id_key and text_hash of every row of docs; kept: the same of those to keep, each once. What is dropped is mostly
    few, so that it is broadcast and texts stay where they are; only rows that are there more than once are brought
    together. Other columns of docs may have any names.
    """
    keys = ["id_key", "text_hash"]
    counted = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).join(kept.select(*keys, F.lit(True).alias("kept")), keys, "left")
    special = materialize(counted.filter("kept is null or n > 1"), "special")
    key, text_hash = (free_name(n, docs.columns) for n in ("_id_key", "_text_hash"))
    again = special.filter("kept").select(F.col("id_key").alias(key), F.col("text_hash").alias(text_hash))
    known = special.select(F.col("id_key").alias(key), F.col("text_hash").alias(text_hash))
    few = F.broadcast if special.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST else lambda df: df
    keyed = docs.withColumns({key: F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), text_hash: F.xxhash64(text_of())})
    columns = [F.col(f"`{c}`") for c in docs.columns]
    once = keyed.join(few(known), [key, text_hash], "left_anti").select(*columns)
    if again.isEmpty():
        return once
    place = free_name("_first", [*docs.columns, key, text_hash])
    first = F.row_number().over(Window.partitionBy(key, text_hash).orderBy(text_hash))
    repeated = keyed.join(few(again), [key, text_hash], "left_semi").withColumn(place, first).filter(F.col(place) == 1)
    return once.unionAll(repeated.select(*columns))
