"""Registered queries: one per operator of the inventory.

Each query is a callable ``(spark, sf_dir) -> DataFrame`` that builds the
fixtures from the tables under ``sf_dir`` and applies one operator to them,
over the whole tables.  ``ORACLE`` holds the DuckDB SQL of the same result
for every query that has one.  Double columns are rounded to 6 decimals in
both so the driver's value hash compares like with like.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import fixtures as fx
from .oracle import ANCHOR_SQL, positive_zero_rounds, with_fixtures

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = positive_zero_rounds(with_fixtures(sql))
        return fn
    return deco


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every DOUBLE/FLOAT column (arrays of doubles element-wise)."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append(F.round(F.col(f.name).cast("double"), digits).alias(f.name))
        elif isinstance(f.dataType, T.ArrayType) and isinstance(
                f.dataType.elementType, (T.DoubleType, T.FloatType)):
            cols.append(F.transform(f.name, lambda v: F.round(v.cast("double"), digits)).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


# Import the query modules so that they register themselves.
from . import q_relational  # noqa: E402,F401
from . import q_windows  # noqa: E402,F401
from . import q_evaluation  # noqa: E402,F401
from . import q_series  # noqa: E402,F401
from . import q_ml  # noqa: E402,F401

__all__ = ["QUERIES", "ORACLE", "register", "rounded", "fx", "ANCHOR_SQL"]
