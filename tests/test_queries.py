"""Every query of the library against its SQL in DuckDB."""

import os

import duckdb
import pandas as pd
import pytest

from vitrine.queries import ORACLES, QUERIES
from vitrine.sources.model import Model

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(frame: pd.DataFrame) -> list[str]:
    names = sorted(frame.columns)
    return sorted(str(tuple(None if v is None or pd.isna(v) else v for v in r)) for r in frame[names].itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def duck(data):
    connection = duckdb.connect()
    for name in TABLES:
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM '{data}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, data, duck, name):
    got, want = QUERIES[name](spark, data).toPandas(), duck.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


#: Approximate by nature, with its recall measured in tests/test_vectors.py; iterative, with a brute force in tests/test_logistic.py.
WITHOUT_SQL = {"vector_topk_index", "interaction_ranked"}


def test_every_query_has_its_sql():
    assert set(QUERIES) - set(ORACLES) == WITHOUT_SQL


def test_no_query_reads_a_part_of_the_users(spark, data):
    data = os.path.join(os.path.dirname(data.rstrip("/")), "sf0.01")  # the smallest with users beyond id 150
    users = Model(spark, data).users().select("id").collect()
    assert sorted(r["user_id"] for r in QUERIES["follow_status"](spark, data).collect()) == sorted(r["id"] for r in users)
    assert len(users) > 1000


def test_entry_and_contract(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
