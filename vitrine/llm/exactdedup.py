"""Exact deduplication against a minimal perfect hash over the distinct digests of what is already there.

The rows fall into history and arrivals. History's digests are grouped (partial sums before the shuffle, so a hot text
costs one row per task) and dealt by digest to shards of about SHARD_KEYS. Each shard becomes a minimal perfect hash:
a pilot per bucket sends its keys to distinct slots, as many slots as keys; a slot holds the full 32-byte digest and the
locator of the winner. Arrivals are grouped alike and looked up: a slot whose digest agrees byte for byte marks a repeat,
which joins that group; the others form groups of their own. The winners are joined back to the rows by digest; Spark
splits the shuffle partitions of hot digests there.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import NO_ID, keep_rows, materialize, ship

SHARD_KEYS = 20_000
LEAST_SHARDS = 64
_PILOTS = np.arange(256, dtype=np.uint64)
_GROUPS = "digest binary, points long, id_key long, row long, n long"
_INDEX = "shard long, pilots binary, digests binary, points binary, ids binary, rows binary, counts binary"


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row (unique), doc_id, id_key, text_hash, points (code points of the original text), digest (SHA-256 without white space)."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [hashlib.sha256(t.translate(None, b" \t\n\v\f\r")).digest() for t in batch["text"].cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(found, pa.binary())], names=["doc_id", "text_hash", "points", "digest"])

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.char_length(text).cast("long").alias("points"), text.alias("text"))
    found = source.mapInArrow(run, "doc_id long, text_hash long, points long, digest binary")
    return found.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.coalesce("doc_id", F.lit(NO_ID)).alias("id_key"), "text_hash", "points", "digest")


def grouped(rows: DataFrame) -> DataFrame:
    """One row per digest: the winner (most code points, then smallest id, then first row) and the group's size."""
    best = F.min(F.struct((-F.col("points")).alias("less"), "id_key", "row")).alias("best")
    return rows.groupBy("digest").agg(best, F.count(F.lit(1)).alias("n")).select("digest", (-F.col("best.less")).alias("points"), "best.id_key", "best.row", "n")


def _places(keys: np.ndarray, pilots: np.ndarray, n: int) -> np.ndarray:
    x = (keys[:, 1] ^ (pilots * np.uint64(0x9E3779B97F4A7C15))) * (keys[:, 2] | np.uint64(1))
    return (x ^ (x >> np.uint64(32))) % np.uint64(n)


def build_hash(keys: np.ndarray) -> np.ndarray:
    """Pilots of a minimal perfect hash over the rows of keys (n x 4 unsigned 64-bit, distinct)."""
    n = len(keys)
    buckets = max(1, n // 3)
    at = (keys[:, 0] % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(at, kind="stable")
    starts = np.searchsorted(at[order], np.arange(buckets + 1))
    taken, pilots = np.zeros(n, dtype=bool), np.zeros(buckets, dtype=np.int64)
    sizes = np.diff(starts)
    for bucket in np.argsort(-sizes, kind="stable"):
        size = sizes[bucket]
        if size <= 1:
            break
        own, base = keys[order[starts[bucket] : starts[bucket + 1]]], 0
        while True:
            tried = _PILOTS + np.uint64(base)
            x = (own[:, 1] ^ (tried[:, None] * np.uint64(0x9E3779B97F4A7C15))) * (own[:, 2] | np.uint64(1))
            slots = ((x ^ (x >> np.uint64(32))) % np.uint64(n)).astype(np.int64)
            good = ~taken[slots].any(axis=1)
            if good.any():
                ordered = np.sort(slots, axis=1)
                good &= (ordered[:, 1:] != ordered[:, :-1]).all(axis=1)
                if good.any():
                    k = int(good.argmax())
                    taken[slots[k]] = True
                    pilots[bucket] = base + k
                    break
            base += len(_PILOTS)
    single = np.flatnonzero(sizes == 1)
    pilots[single] = -np.flatnonzero(~taken)[: len(single)] - 1  # a lone key is sent to its slot directly
    return pilots


def find_slots(keys: np.ndarray, pilots: np.ndarray, n: int) -> np.ndarray:
    own = pilots[(keys[:, 0] % np.uint64(len(pilots))).astype(np.int64)]
    return np.where(own < 0, -own - 1, _places(keys, own.astype(np.uint64), n).astype(np.int64))


def _keys(values: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(values), "<u8").reshape(-1, 4)


def build_index(groups: DataFrame, shards: int) -> DataFrame:
    """The perfect hash of each shard, as one row of arrays."""

    def build(own: pd.DataFrame) -> pd.DataFrame:
        keys = _keys(own["digest"])
        pilots = build_hash(keys)
        slot = find_slots(keys, pilots, len(keys))
        at = np.empty(len(keys), dtype=np.int64)
        at[slot] = np.arange(len(keys))
        arrays = {c: own[c].to_numpy(np.int64)[at].tobytes() for c in ("points", "id_key", "row", "n")}
        return pd.DataFrame([[own["shard"].iloc[0], pilots.tobytes(), keys[at].tobytes(), arrays["points"], arrays["id_key"], arrays["row"], arrays["n"]]])

    return groups.withColumn("shard", _shard(shards)).groupBy("shard").applyInPandas(build, _INDEX)


def _shard(shards: int) -> Column:
    return F.pmod(F.xxhash64("digest"), F.lit(shards)).cast("long")


def merge(index: DataFrame, groups: DataFrame, shards: int) -> DataFrame:
    """Groups of history and arrivals together: repeats joined to their slot's group, the others as they are."""

    def look_up(held: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        names = ["points", "id_key", "row", "n"]
        new = own[["digest", *names]].reset_index(drop=True)
        if held.empty:
            return new
        first = held.iloc[0]
        table = np.frombuffer(first["digests"], "<u8").reshape(-1, 4)
        values = {c: np.frombuffer(first[b], np.int64).copy() for c, b in zip(names, ("points", "ids", "rows", "counts"), strict=True)}
        if len(new):
            keys = _keys(new["digest"])
            slot = find_slots(keys, np.frombuffer(first["pilots"], np.int64), len(table))
            member = (table[slot] == keys).all(axis=1)  # the full digest decides
            at = slot[member]
            hit = {c: new[c].to_numpy(np.int64)[member] for c in names}
            better = (hit["points"] > values["points"][at]) | (
                (hit["points"] == values["points"][at])
                & ((hit["id_key"] < values["id_key"][at]) | ((hit["id_key"] == values["id_key"][at]) & (hit["row"] < values["row"][at])))
            )
            values["n"][at] += hit["n"]
            for c in names[:3]:
                values[c][at[better]] = hit[c][better]
            new = new[~member]
        flat = table.tobytes()
        old = pd.DataFrame({"digest": [flat[k : k + 32] for k in range(0, len(flat), 32)], **values})
        return pd.concat([old, new], ignore_index=True)

    new = groups.withColumn("shard", _shard(shards))
    return index.groupBy("shard").cogroup(new.groupBy("shard")).applyInPandas(look_up, _GROUPS)


def exact_dedup(docs: DataFrame, is_history: Column | None = None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, keep_id, group_size, kept, text_sha256, text_hash, of texts that are equal but for white space.

    is_history: which rows, by a condition on doc_id, are there already; the lower half of the id range if not given. It
    decides the order of work only, never the result. Null texts count as empty, and all empty texts are one group. A
    null id comes before all others. Of repeated rows with one id exactly one is kept. Very long texts become digests
    where they are. An empty table gives no rows.
    Other columns of docs are ignored, whatever their names.
    """
    rows = materialize(digests(docs, id_col, text_col), "digests")
    low, high, count = rows.agg(F.min("doc_id"), F.max("doc_id"), F.count(F.lit(1))).first()
    if is_history is None:
        is_history = F.col("doc_id") < F.lit(((low or 0) + (high or 0)) // 2)
    there = F.coalesce(is_history, F.lit(False))
    shards = max(LEAST_SHARDS, -(-count // SHARD_KEYS))
    index = materialize(build_index(grouped(rows.filter(there)), shards), "index")
    winners = merge(index, grouped(rows.filter(~there)), shards).select("digest", F.col("id_key").alias("best_key"), F.col("row").alias("best_row"), F.col("n"))
    return rows.join(winners, "digest").select(
        "doc_id",
        F.nullif("best_key", F.lit(NO_ID)).alias("keep_id"),
        F.col("n").alias("group_size"),
        (F.col("row") == F.col("best_row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        "text_hash",
    )


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of docs (doc_id, text and any other columns) without copies: of each group the row that exact_dedup keeps.

    What exact_dedup says of nulls, empty texts, ties and repeated rows holds; an empty table stays empty.
    """
    judged = exact_dedup(docs).select(F.coalesce("doc_id", F.lit(NO_ID)).alias("id_key"), "text_hash", "kept")
    judged = materialize(judged, "judged")
    return keep_rows(docs, judged, judged.filter("kept"))


#: The result in DuckDB's SQL.
ORACLE = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS points, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS plain
  FROM documents
), g AS (
  SELECT doc_id, sha256(plain) AS text_sha256, count(*) OVER (PARTITION BY plain) AS group_size,
         first_value(doc_id) OVER (PARTITION BY plain ORDER BY points DESC, doc_id) AS keep_id
  FROM t
)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, text_sha256 FROM g
"""
