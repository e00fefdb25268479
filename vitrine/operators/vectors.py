"""Nearest vectors by cosine: exactly, by products of blocks, and through an inverted file of centroids.

Equal vectors are one class with its least ids, so that a vector which a third of all rows have costs as much as any other.
Classes and distinct queries are dealt into lists, one list for the exact search, one of each centroid for the index; a list
is dealt into tiles, and every tile of vectors meets every tile of queries of its list in a cell of bounded size, which is one
matrix product in a task. Each cell keeps k classes a query; the rest is merged by query. Nothing is compared row by row.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# tasks get the functions of this module by value, so that they need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Rows of a tile of vectors or of queries.
TILE = 4096
#: Rows (about) from which centroids are fitted, lists at most, steps of fitting, and queries on which probes are counted.
SAMPLE, MOST_LISTS, STEPS, TRIED = 20_000, 4096, 10, 400
#: Digits of a cosine; closer ones are ties, which the smaller id wins.
DIGITS = 6


@dataclass
class Index:
    """Unit centroids, one for each list, and how many lists a query looks into."""

    centroids: np.ndarray
    probes: int


def _unit(rows: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, norm, out=np.zeros_like(rows), where=norm > 0)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of an array column as doubles; a null, or one of another length, is a row of zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = np.diff(column.offsets.to_numpy())
    if column.null_count == 0 and column.flatten().null_count == 0 and (lengths == width).all():
        return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)
    rows = column.to_pylist()
    return np.array([r if r is not None and len(r) == width and None not in r else [0.0] * width for r in rows], float).reshape(-1, width)


def classes(vectors: DataFrame, k: int) -> DataFrame:
    """(h1, h2, embedding, ids): distinct vectors of (vec_id, embedding) by two 64-bit hashes, each with its k least ids in order.

    Every task keeps k ids of a vector before the shuffle.
    """
    hashes = {"h1": F.xxhash64("embedding"), "h2": F.xxhash64(F.lit(1), "embedding")}
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>").alias("embedding")).withColumns(hashes)
    place = F.row_number().over(Window.partitionBy("h1", "h2").orderBy("vec_id"))
    return rows.withColumn("place", place).filter(F.col("place") <= k).groupBy("h1", "h2").agg(F.first("embedding").alias("embedding"), F.sort_array(F.collect_list("vec_id")).alias("ids"))


def fit(vectors: DataFrame, k: int, *, lists: int | None = None, target: float = 0.95, seed: int = 7) -> Index:
    """An index for the k nearest: spherical k-means on about SAMPLE rows chosen by the hash of their ids.

    As many lists are probed as the k nearest of TRIED of these rows ask for, so that target of them are found; in the
    whole table neighbours are nearer than in the sample, so that it is found there too.
    """
    n = vectors.count()
    share = min(1.0, SAMPLE / max(1, n))
    chosen = F.pmod(F.xxhash64(F.lit(seed), F.col("vec_id")), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))
    sample = vectors.filter(chosen & F.col("embedding").isNotNull()).select("embedding").limit(2 * SAMPLE).toArrow()["embedding"]
    width = max((len(x) for x in sample.slice(0, 100).to_pylist()), default=0)
    if not width:
        return Index(np.zeros((1, 1)), 1)
    rows = _unit(_matrix(sample, width))
    rng = np.random.default_rng(seed)
    c = max(1, min(lists or round(math.sqrt(n)), MOST_LISTS, len(rows) // 8))
    centroids = rows[rng.choice(len(rows), c, replace=False)]
    for _ in range(STEPS):
        own = np.argmax(rows @ centroids.T, axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, rows)
        empty = ~sums.any(axis=1)
        sums[empty] = rows[rng.choice(len(rows), int(empty.sum()))]
        centroids = _unit(sums)
    own = np.argmax(rows @ centroids.T, axis=1)
    tried = rows[rng.choice(len(rows), min(TRIED, len(rows)), replace=False)]
    near = np.argsort(-(tried @ rows.T), axis=1)[:, :k]
    rank = np.argsort(np.argsort(-(tried @ centroids.T), axis=1), axis=1)  # of each list for each tried row
    needed = np.sort(np.take_along_axis(rank, own[near], axis=1).ravel())
    return Index(centroids, int(needed[math.ceil(target * len(needed)) - 1]) + 1)


def _in_lists(rows: DataFrame, index: Index | None, probes: int) -> DataFrame:
    """rows with list: each row once for each of the probes nearest centroids."""
    if index is None:
        return rows.withColumn("list", F.pmod("h1", F.lit(1)).cast("int"))  # 0, which a literal would make a join without a key
    centroids = index.centroids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = _matrix(batch["embedding"], centroids.shape[1]) @ centroids.T
            best = np.argsort(-score, axis=1, kind="stable")[:, :probes].astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(best) + 1) * best.shape[1], pa.int32()), pa.array(best.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=[*batch.schema.names, "lists"])

    schema = ", ".join(f"{name} {kind}" for name, kind in rows.dtypes) + ", lists array<int>"
    return rows.mapInArrow(run, schema).withColumn("list", F.explode("lists")).drop("lists")


def _best(k: int):
    """Of a cell's rows (vectors with ids, queries without) the k best classes of each query."""

    def run(cell: pa.Table) -> pa.Table:
        asking = cell["ids"].is_null()
        queries, vectors = cell.filter(asking), cell.filter(pa.compute.invert(asking))
        out = {"q1": [], "q2": [], "cosine": [], "ids": []}
        if len(queries) and len(vectors):
            width = max(len(x) for x in vectors["embedding"].to_pylist() if x is not None) if vectors["embedding"].null_count < len(vectors) else 1
            ids = vectors["ids"].to_pylist()
            least = np.array([x[0] for x in ids])
            v, q = _unit(_matrix(vectors["embedding"], width)), _unit(_matrix(queries["embedding"], width))
            q1, q2 = queries["h1"].to_pylist(), queries["h2"].to_pylist()
            for start in range(0, len(q), 512):  # a strip of the product at a time
                cosine = np.round(q[start : start + 512] @ v.T, DIGITS) + 0.0
                edge = -np.partition(-cosine, min(k, len(v)) - 1, axis=1)[:, min(k, len(v)) - 1]
                for j, row in enumerate(cosine):
                    at = np.flatnonzero(row >= edge[j])
                    for x in at[np.lexsort((least[at], -row[at]))[:k]]:
                        out["q1"].append(q1[start + j])
                        out["q2"].append(q2[start + j])
                        out["cosine"].append(float(row[x]))
                        out["ids"].append(ids[x])
        return pa.table({"q1": pa.array(out["q1"], pa.int64()), "q2": pa.array(out["q2"], pa.int64()), "cosine": pa.array(out["cosine"], pa.float64()), "ids": pa.array(out["ids"], pa.list_(pa.int64()))})

    return run


def nearest_each(vectors: DataFrame, queries: DataFrame, k: int, *, index: Index | None = None, where: Column | None = None, tile: int = TILE) -> DataFrame:
    """(query_id, vec_id, cosine) of the k vectors (vec_id, embedding) of the largest cosine to each of queries (likewise); ties by id.

    index: looks into the lists nearest to a query alone; without one the result is exact. where: a condition on other
    columns of vectors, which reaches the scan. Every row is in the index. A null vector, one of zeros and one of another
    length have the cosine 0; rows of the same id count each for itself; an empty table on either side gives no rows.
    """
    vectors = vectors if where is None else vectors.filter(where)
    asked = queries.select(F.col("vec_id").cast("long").alias("query_id"), F.col("embedding").cast("array<float>").alias("embedding")).withColumns({"h1": F.xxhash64("embedding"), "h2": F.xxhash64(F.lit(1), "embedding")})
    distinct = asked.groupBy("h1", "h2").agg(F.first("embedding").alias("embedding"))
    listed = _in_lists(classes(vectors, k), index, 1)
    probing = _in_lists(distinct, index, index.probes if index else 1)
    tiles = lambda df, name: df.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias(name))  # noqa: E731  a row for each list
    sizes = F.broadcast(tiles(listed, "v_tiles").join(tiles(probing, "q_tiles"), "list"))
    dealt = lambda df, own, other: df.join(sizes, "list").select("list", "h1", "h2", "embedding", "ids", F.pmod("h1", F.col(own)).cast("int").alias("own"), F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias("other"))
    v = dealt(listed, "v_tiles", "q_tiles").select("list", F.col("own").alias("v"), F.col("other").alias("q"), "h1", "h2", "embedding", "ids")
    q = dealt(probing.withColumn("ids", F.lit(None).cast("array<long>")), "q_tiles", "v_tiles").select("list", F.col("other").alias("v"), F.col("own").alias("q"), "h1", "h2", "embedding", "ids")
    best = v.unionByName(q).groupBy("list", "v", "q").applyInArrow(_best(k), "q1 long, q2 long, cosine double, ids array<long>")
    found = best.select("q1", "q2", "cosine", F.explode("ids").alias("vec_id"))
    place = F.row_number().over(Window.partitionBy("q1", "q2").orderBy(F.desc("cosine"), "vec_id"))
    merged = found.withColumn("place", place).filter(F.col("place") <= k)
    return asked.join(merged, (F.col("h1") == F.col("q1")) & (F.col("h2") == F.col("q2"))).select("query_id", "vec_id", "cosine")


def recall(found: DataFrame, exact: DataFrame) -> float:
    """The share of exact's rows (query_id, vec_id) that are found."""
    pairs = exact.select("query_id", "vec_id").join(found.select("query_id", "vec_id", F.lit(1).alias("hit")), ["query_id", "vec_id"], "left")
    return pairs.agg(F.count("hit") / F.count(F.lit(1))).first()[0] or 0.0
