"""Settings that the operators are written for."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.ansi.enabled": "true",
}


def configure(builder: SparkSession.Builder) -> SparkSession.Builder:
    return builder.config(map=SETTINGS)


def _folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors share.

    Where that is unset and the master is local, as in tests, it is a local folder; on a cluster that is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="vitrine-checkpoint-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def shared(rows: DataFrame) -> DataFrame:
    """rows, worked out and checkpointed in the shared folder; Spark deletes it as it pleases."""
    _folder(rows.sparkSession)
    return rows.checkpoint()


def new_folder(spark: SparkSession, name: str) -> str:
    """A name for a new folder below the shared one; it is deleted when Python ends, if not before."""
    path = f"{_folder(spark)}/vitrine-{name}-{uuid.uuid4().hex[:12]}"
    atexit.register(_remove, spark, path)
    return path


def stored(rows: DataFrame, name: str = "table") -> DataFrame:
    """rows, written once as a table in the shared folder and read again, for discard() to delete."""
    path = new_folder(rows.sparkSession, name)
    rows.write.option("compression", "zstd").parquet(path)
    out = rows.sparkSession.read.schema(rows.schema).parquet(path)
    out.stored_path = path
    return out


def discard(rows: DataFrame) -> None:
    """Delete what stored() wrote, when nothing reads it any more."""
    _remove(rows.sparkSession, rows.stored_path)


def _remove(spark: SparkSession, folder: str) -> None:
    try:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # the JVM may be gone already at exit
        pass
