"""Registry of named queries (Spark) and their DuckDB oracle SQL.

Each query is a callable ``(spark, sf_dir) -> DataFrame`` that reads the
supplied tables over their whole extent.  Doubles are rounded to 6 places on
both sides so that the order-insensitive value hash is stable.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return deco


def r6(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every floating/decimal column to ``digits`` places as DOUBLE."""
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.DecimalType):  # exact: round half-up in decimal, then to double
            out.append(F.round(F.col(f"`{f.name}`"), digits).cast("double").alias(f.name))
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            out.append(F.round(F.col(f"`{f.name}`").cast("double"), digits).alias(f.name))
        else:
            out.append(F.col(f"`{f.name}`"))
    return df.select(*out)


def load_all() -> None:
    # importing the modules registers their queries
    from . import q_core, q_ledger, q_feedback, q_models, q_stream  # noqa: F401
