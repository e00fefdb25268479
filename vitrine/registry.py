"""Where queries over the driver's tables are registered, each with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .sources.model import VIEWS, Model

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _plain(rows: DataFrame) -> DataFrame:
    """Decimals as doubles, so that both engines hand out the same type."""
    return rows.withColumns({c: F.col(c).cast("double") for c, kind in rows.dtypes if kind.startswith("decimal")})


def query(sql: str | None = None, *, decimal: str | None = None):
    """Register a function of the model under its name; sql may refer to the logical relations. decimal: its decimal column."""

    def put(f: Callable[[Model], DataFrame]) -> Callable[[Model], DataFrame]:
        QUERIES[f.__name__] = lambda spark, folder: _plain(f(Model(spark, folder)))
        if sql and decimal:
            ORACLES[f.__name__] = f"WITH {VIEWS.strip()}\nSELECT * REPLACE (CAST({decimal} AS DOUBLE) AS {decimal}) FROM ({sql.strip()})"
        elif sql:
            ORACLES[f.__name__] = f"WITH RECURSIVE {VIEWS.strip()}{',' if sql.lstrip().startswith('+') else ''}\n{sql.lstrip().lstrip('+')}"
        return f

    return put
