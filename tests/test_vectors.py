"""Nearest vectors against brute force, and the recall of the index."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vitrine.operators import vectors
from vitrine.queries import QUERIES

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, asked, k):
    unit = lambda v: v / np.linalg.norm(v) if np.linalg.norm(v) else v
    flat = [(i, unit(np.array(v or [0.0] * 4, np.float32).astype(float))) for i, v in rows]
    out = []
    for q, v in asked:
        v = unit(np.array(v or [0.0] * 4, np.float32).astype(float))
        best = sorted((-(round(float(v @ w), 6) + 0.0), i) for i, w in flat)[:k]
        out += [(q, i, -c) for c, i in best]
    return sorted(out)


def same(found, want):
    found = sorted(tuple(r) for r in found.collect())
    assert [r[:2] for r in found] == [r[:2] for r in want]
    assert [r[2] for r in found] == pytest.approx([r[2] for r in want], abs=2e-6)


@pytest.mark.parametrize("tile", [3, 4096])
def test_exact_with_copies_ties_zeros_and_nulls(spark, tile):
    rng = np.random.default_rng(1)
    rows = [(k, [float(x) for x in rng.integers(-2, 3, 4)]) for k in range(60)] + [(100 + k, [1.0, 0.0, 0.0, 0.0]) for k in range(40)]
    rows += [(200, [0.0] * 4), (201, None), (7, [2.0, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame([(*r, 0) for r in rows], SCHEMA).repartition(5)
    asked = [r for r in rows if r[0] % 20 == 0]
    same(vectors.nearest_each(df, df.filter("vec_id % 20 = 0"), 5, tile=tile), brute(rows, asked, 5))
    some = [r for r in rows if r[0] % 3 == 0]
    same(vectors.nearest_each(df, df.filter("vec_id % 20 = 0"), 5, where=F.col("vec_id") % 3 == 0, tile=tile), brute(some, asked, 5))


def test_empty_tables(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0], 0)], SCHEMA)
    assert vectors.nearest_each(df.limit(0), df, 3).count() == 0 and vectors.nearest_each(df, df.limit(0), 3).count() == 0
    assert vectors.fit(df.limit(0), 3).probes == 1


def test_index_holds_every_row_and_finds_nine_of_ten(spark, data):
    rows = spark.read.parquet(f"{data}/embeddings.parquet")
    exact, found = QUERIES["vector_topk_all"](spark, data), QUERIES["vector_topk_index"](spark, data)
    assert vectors.recall(found, exact) >= 0.9
    index = vectors.fit(rows, 20)
    assert 1 < index.probes < len(index.centroids)
    everywhere = vectors.nearest_each(rows, rows.filter("vec_id % 20 = 0"), 20, index=vectors.Index(index.centroids, len(index.centroids)))
    assert vectors.recall(everywhere, exact) == 1.0  # all lists together hold all rows


def test_index_probes_few_lists_of_clustered_vectors(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(30, 16)) * 4
    rows = [(k, [float(x) for x in centres[k % 30] + rng.normal(size=16)], 0) for k in range(3000)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    index = vectors.fit(df, 10)
    asked = df.filter("vec_id % 20 = 0")
    assert index.probes <= len(index.centroids) // 4
    assert vectors.recall(vectors.nearest_each(df, asked, 10, index=index, tile=64), vectors.nearest_each(df, asked, 10)) >= 0.9


def test_no_cross_join(spark, data):
    for name in ("vector_topk_all", "vector_topk_index"):
        plan = QUERIES[name](spark, data)._jdf.queryExecution().toString()
        assert "Cartesian" not in plan and "NestedLoop" not in plan
