"""Sharding with size-tiered compaction, with DataFrame operations only.

A table is a folder of immutable shards and a sequence of versions. Arrivals are appended as they come, one small shard
per input task, without a shuffle. A compaction reads the shards' sizes from file metadata, sorts small shards into tiers
by powers of TIER_FACTOR, and merges runs of neighbouring shards of one tier: as many runs of about equal size as the tier
holds target sizes, each written by its own task as one file. Rounds follow until no tier has a run left, so that a
second compaction finds nothing to do. Only the shards of runs are read, at most MOST_SHARDS a round.

A version is a file that names a manifest (a Parquet table of shards) and the rows' schema. The file is written aside and
then gets its name by an operation that fails where the name exists (a hard link on a local file system, a rename without
overwriting elsewhere). So of two writers of one version one fails, readers see the old or the new version, and a job
that dies leaves files that no version names.
"""

from __future__ import annotations

import json
import re
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ._shared import free_name

TARGET_BYTES = 64 << 20
#: Shards belong to one tier if their sizes lie between two neighbouring powers of this.
TIER_FACTOR = 4
#: So many shards of a tier at least make a merge worth while.
LEAST_RUN = 2
#: Shards that are merged in a round at most; their names go through the driver.
MOST_SHARDS = 100_000
#: Seconds for which files that no version names are left alone, as a writer may be about to commit them.
VACUUM_AGE = 7 * 86_400
CODEC = "zstd"
MANIFEST = "shard string, bytes long, rows long, tier int, version int"


class ShardedTable:
    """A sharded table in a folder that all executors share.

    Columns are kept as they are, whatever their names; all appends have the columns of the first. Nulls, empty and very
    long texts and repeated rows are rows like any other. Appending an empty table commits a version with the same shards,
    and a table without shards is read as no rows.
    """

    def __init__(self, spark: SparkSession, folder: str, *, target_bytes: int = TARGET_BYTES, tier_factor: int = TIER_FACTOR):
        self.spark, self.folder, self.target, self.factor = spark, folder.rstrip("/"), target_bytes, tier_factor

    # versions

    def _fs(self, path: str):
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark._jsc.hadoopConfiguration()), target

    def version(self) -> int:
        """The current version; 0 before the first commit."""
        fs, path = self._fs(f"{self.folder}/versions")
        if not fs.exists(path):
            return 0
        names = [s.getPath().getName() for s in fs.listStatus(path)]
        return max((int(n[1:]) for n in names if n[0] == "v"), default=0)

    def _state(self, version: int) -> dict:
        """The manifest's folder and the rows' schema of a version."""
        fs, path = self._fs(self._name(version))
        stream = fs.open(path)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _name(self, version: int) -> str:
        return f"{self.folder}/versions/v{version:09d}"

    def manifest(self, version: int | None = None) -> DataFrame:
        version = self.version() if version is None else version
        if not version:
            return self.spark.createDataFrame([], MANIFEST)
        return self.spark.read.schema(MANIFEST).parquet(self._state(version)["manifest"])

    def _commit(self, shards: DataFrame, version: int, schema: StructType) -> None:
        """Write the manifest, then make it current under the version's name; fails if another commit came first."""
        folder, aside = (f"{self.folder}/{kind}-{uuid.uuid4().hex}" for kind in ("manifests/m", "versions/_new"))
        # Spark rebalances the rows, so that a manifest has files of a usual size
        shards.select("shard", "bytes", "rows", "tier", F.lit(version).alias("version")).hint("rebalance").write.parquet(folder)
        fs, path = self._fs(aside)
        out = fs.create(path, True)
        out.write(json.dumps({"manifest": folder, "schema": schema.jsonValue()}).encode())
        out.close()
        taken = not self._publish(aside, self._name(version))
        fs.delete(path, False)
        if taken:
            fs.delete(self._fs(folder)[1], True)
            raise RuntimeError(f"version {version} was committed by another writer")

    def _publish(self, aside: str, name: str) -> bool:
        """Give a file another name unless that exists; whether it has it now."""
        jvm, (fs, source), (_, target) = self.spark._jvm, self._fs(aside), self._fs(name)
        try:
            if fs.getScheme() == "file":  # renaming would replace a file there
                at = [jvm.java.io.File(p.toUri().getPath()).toPath() for p in (target, source)]
                jvm.java.nio.file.Files.createLink(*at)
            else:
                kinds = jvm.org.apache.hadoop.fs.Options.Rename
                none = self.spark.sparkContext._gateway.new_array(kinds, 1)
                none[0] = kinds.NONE
                jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self.spark._jsc.hadoopConfiguration()).rename(source, target, none)
        except Py4JJavaError as e:
            if "FileAlreadyExists" in e.java_exception.getClass().getName():
                return False
            raise
        return True

    def _described(self, folder: str) -> DataFrame:
        """shard, bytes, rows, tier of the files in a folder, from metadata and row counts."""
        files = self.spark.read.parquet(folder).groupBy(F.col("_metadata.file_path").alias("shard"))
        sized = files.agg(F.max("_metadata.file_size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
        return sized.withColumn("tier", F.greatest(F.lit(0), F.floor(F.log(float(self.factor), F.col("bytes") / 1024.0))).cast("int"))

    # data

    def append(self, rows: DataFrame) -> int:
        """Write each task's rows as a shard and commit the next version."""
        return self.append_batches(rows, F.lit(0), 1)

    def append_batches(self, rows: DataFrame, batch: Column, batches: int) -> int:
        """Rows of batch 0, 1 and so on as arrivals of their own: one pass over rows, one version for each of them."""
        now, schema = self.version(), rows.schema
        if now and sorted(rows.columns) != sorted(self.schema(now).names):
            raise ValueError(f"the table's columns are {self.schema(now).names}")
        folder, own = f"{self.folder}/data/{uuid.uuid4().hex}", free_name("_batch", rows.columns)
        with _setting(self.spark, "spark.sql.maxConcurrentOutputFileWriters", str(batches)):
            rows.withColumn(own, batch.cast("int")).write.option("compression", CODEC).partitionBy(own).parquet(folder)
        for k in range(batches):
            fs, path = self._fs(f"{folder}/{own}={k}")
            old = self.manifest(now).drop("version")
            self._commit(old.unionByName(self._described(f"{folder}/{own}={k}")) if fs.exists(path) else old, now + 1, schema if not now else self.schema(now))
            now += 1
        return now

    def schema(self, version: int | None = None) -> StructType:
        return StructType.fromJson(self._state(self.version() if version is None else version)["schema"])

    def plan(self, version: int | None = None) -> DataFrame:
        """shard, bytes, rows, tier, run: shards of one run are merged; a null run stays as it is.

        Shards of up to half the target are small. A tier's small shards, in the order of their names, are cut into as many
        runs as the tier holds target sizes, one at least: a shard belongs to the run that its middle lies in, so that runs
        are near to equal in size.
        """
        small = self.manifest(version).filter(F.col("bytes") * 2 <= self.target)
        total = F.sum("bytes").over(Window.partitionBy("tier"))
        before = F.coalesce(F.sum("bytes").over(Window.partitionBy("tier").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        parts = F.greatest(F.lit(1), F.round(total / self.target))
        cut = small.withColumn("part", F.floor((before + F.col("bytes") / 2) * parts / total))
        counted = cut.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("tier", "part")))
        run = F.when(F.col("n") >= LEAST_RUN, F.concat_ws("-", "tier", "part"))
        return counted.select("shard", "bytes", "rows", "tier", run.alias("run"))

    def compact(self) -> int:
        """Merge the planned runs and commit, until no run is left; the same version if there is nothing to merge."""
        now = self.version()
        while self._merge(now):
            now += 1
        return now

    def _merge(self, now: int) -> bool:
        by_run = Window.partitionBy("run")
        chosen = self.plan(now).filter(F.col("run").isNotNull()).orderBy("run", "shard").limit(MOST_SHARDS)
        whole = chosen.withColumn("n", F.count(F.lit(1)).over(by_run)).filter(F.col("n") >= LEAST_RUN)
        runs = whole.select("shard", (F.dense_rank().over(Window.orderBy("run")) - 1).alias("k")).collect()  # MOST_SHARDS at most
        if not runs:
            return False
        merged, schema = f"{self.folder}/data/{uuid.uuid4().hex}", self.schema(now)
        rows = self.spark.read.schema(schema).parquet(*(r["shard"] for r in runs))
        shard, k = (free_name(x, schema.names) for x in ("_shard", "_run"))
        known = F.broadcast(self.spark.createDataFrame(runs, f"{shard} string, {k} int"))
        tagged = rows.withColumn(shard, F.col("_metadata.file_path")).join(known, shard).repartitionById(max(r["k"] for r in runs) + 1, F.col(k))
        tagged.select(*(F.col(f"`{c}`") for c in schema.names)).write.option("compression", CODEC).parquet(merged)
        kept = self.manifest(now).drop("version").join(known.select(F.col(shard).alias("shard")), "shard", "left_anti")
        self._commit(kept.unionByName(self._described(merged)), now + 1, schema)
        return True

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version: of the shards that its manifest names, and no other files.

        The driver lists the shards, as Spark does for any table: about 100,000 names for 100 TB with a target of 1 GB.
        """
        version = self.version() if version is None else version
        if not version:
            raise ValueError("the table has no version yet")
        shards = [r["shard"] for r in self.manifest(version).select("shard").toLocalIterator()]
        return self.spark.read.schema(self.schema(version)).parquet(*shards) if shards else self.spark.createDataFrame([], self.schema(version))

    def vacuum(self, older_than: float = VACUUM_AGE) -> None:
        """Delete data folders that the current version doesn't name, if they are older than so many seconds.

        Older versions can't be read any more if their shards are gone. Younger folders may be those of a writer that is
        about to commit, so the age must be above the longest time that an append or a compaction takes.
        """
        named = {re.search(r"/data/([^/]+)/", r["shard"])[1] for r in self.manifest().select("shard").toLocalIterator()}
        fs, path = self._fs(f"{self.folder}/data")
        for status in fs.listStatus(path):
            if status.getPath().getName() not in named and status.getModificationTime() / 1000 < time.time() - older_than:
                fs.delete(status.getPath(), True)


@contextmanager
def _setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    before = spark.conf.get(key)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def compacted(rows: DataFrame, folder: str, *, batches: int = 4, id_col: str = "doc_id", target_bytes: int = TARGET_BYTES) -> DataFrame:
    """Append rows in batches (by a hash of the id), compact, and return where each row is now.

    Per row: its id, shard, shard_rows, shard_bytes, tier, version. Null ids are a value of their own and form no group;
    repeated rows and very long texts are rows like any other; an empty table gives no rows. Other columns are stored too,
    whatever their names.
    """
    table = ShardedTable(rows.sparkSession, folder, target_bytes=target_bytes)
    table.append_batches(rows, F.pmod(F.xxhash64(id_col), F.lit(batches)), batches)
    table.compact()
    manifest = table.manifest().select("shard", F.col("rows").alias("shard_rows"), F.col("bytes").alias("shard_bytes"), "tier", "version")
    if manifest.isEmpty():
        return table.read().select(id_col).join(manifest.drop("shard").withColumn("shard", F.lit("")), F.lit(False)).select(id_col, "shard", "shard_rows", "shard_bytes", "tier", "version")
    where = table.read().select(F.col(id_col), F.col("_metadata.file_path").alias("_path"))
    named = manifest.withColumnRenamed("shard", "_path")
    return where.join(named, "_path").select(id_col, F.regexp_extract("_path", "[^/]+$", 0).alias("shard"), "shard_rows", "shard_bytes", "tier", "version")
