"""Token ids in ORC files: written in ascending id order, read back stripe by stripe.

ORC stores integers by run-length encoding; row indexes every ROW_INDEX rows and Bloom filters on the document id let a
reader skip stripes and row groups from metadata alone. One shuffle sorts the texts into ranges of (id, hash of the text),
so that an id which many rows have is split too; each range is encoded and written by its own task as one file. A row
holds its number of ids and of those before it in the file, so a document's place in the corpus is that number and the
totals of the files before: ids are read once, and only where they are asked for.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import ship
from .tokens import encoder

ROW_INDEX = 1000
STRIPE_BYTES = 64 << 20
SCHEMA = "doc_id long, n_ids long, before long, ids array<int>"
_TYPES = pa.schema([("doc_id", pa.int64()), ("n_ids", pa.int64()), ("before", pa.int64()), ("ids", pa.list_(pa.int32()))])
#: Ids are handed to Spark in batches of about so many.
BATCH_IDS = 2_000_000
#: Chunks a worker remembers at most; new ones take most of the encoding, and there is room beside a sort of texts.
MEMO_CHUNKS = 1_500_000


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, *, id_col: str = "doc_id", text_col: str = "text", stripe_bytes: int = STRIPE_BYTES) -> None:
    """Write SCHEMA as ORC, ascending by id over the files in name order.

    Null texts count as empty and give the end id alone; null ids of documents come first; rows with one id are in the
    order of a hash of their texts; repeated rows are written once each. A very long text's ids are one value and take
    some times its size in memory. An empty table gives files without rows. Other columns of docs are ignored, whatever
    their names.
    """
    ship(docs.sparkSession)
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, written = encoder(tokenizer_path, most=MEMO_CHUNKS), 0

        def rows(names: list, parts: list[bytes]) -> pa.RecordBatch:
            nonlocal written
            offsets = np.cumsum([0, *(len(p) // 4 for p in parts)])
            ids = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(np.frombuffer(b"".join(parts), "<i4")))
            columns = [pa.array(names, pa.int64()), pa.array(np.diff(offsets)), pa.array(offsets[:-1] + written), ids]
            written += int(offsets[-1])
            return pa.RecordBatch.from_arrays(columns, schema=_TYPES)

        for batch in batches:
            names, parts, held = [], [], 0
            for k in range(batch.num_rows):
                names.append(batch["doc_id"][k].as_py())
                parts.append(encode(batch["text"][k].as_py()) + end)
                held += len(parts[-1]) // 4
                if held >= BATCH_IDS:
                    yield rows(names, parts)
                    names, parts, held = [], [], 0
            if names:
                yield rows(names, parts)

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    keys = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc()]
    ordered = source.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(run, SCHEMA)
    (
        ordered.write.option("compression", "zstd")
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.row.index.stride", ROW_INDEX)
        .option("orc.stripe.size", stripe_bytes)
        .orc(path)
    )


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The files' rows and the name of each row's file. A filter on doc_id prunes stripes and row groups."""
    return spark.read.schema(SCHEMA).orc(path).select("doc_id", "n_ids", "before", "ids", F.col("_metadata.file_name").alias("file"))


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files: doc_id, start (ids of all documents before it, in the files' order), n_tokens, ids_crc32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch["ids"]
            flat, ends = memoryview(np.ascontiguousarray(lists.flatten().to_numpy(zero_copy_only=False).astype("<i4", copy=False))).cast("B"), np.cumsum(lists.value_lengths().to_numpy()) * 4
            starts = [0, *ends[:-1].tolist()]
            crc = [zlib.crc32(flat[a:b]) for a, b in zip(starts, ends.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch["file"], batch["doc_id"], batch["before"], pa.array(lists.value_lengths(), pa.int64()), pa.array(crc, pa.int64())],
                names=["file", "doc_id", "before", "n_tokens", "ids_crc32"],
            )

    rows = read_tokens(spark, path).select("file", "doc_id", "before", "ids").mapInArrow(run, "file string, doc_id long, before long, n_tokens long, ids_crc32 long")
    totals = read_tokens(spark, path).groupBy("file").agg(F.sum("n_ids").alias("total"))
    in_order = Window.orderBy(F.length("file"), "file")  # numbers in names grow longer beyond 99,999
    ahead = totals.select("file", (F.sum("total").over(in_order) - F.col("total")).alias("ahead"))
    return rows.join(ahead, "file").select("doc_id", (F.col("ahead") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")
