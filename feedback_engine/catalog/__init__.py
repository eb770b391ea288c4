"""Registered queries: one operator over the driver tables plus its SQL twin."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
_MODULES = ("sources", "preparing", "views", "reports", "ordering", "scalars", "learning", "jobs")


def plain(df: DataFrame) -> DataFrame:
    """Types both engines return alike: naive timestamps, longs, doubles at six decimals."""
    out = []
    for field in df.schema:
        column, kind = F.col(f"`{field.name}`"), field.dataType
        if isinstance(kind, (T.TimestampType, T.DateType)):
            column = column.cast("timestamp_ntz")
        elif isinstance(kind, (T.IntegerType, T.ShortType, T.ByteType)):
            column = column.cast("long")
        elif isinstance(kind, (T.DoubleType, T.FloatType, T.DecimalType)):
            column = F.round(column.cast("double"), 6)
        out.append(column.alias(field.name))
    return df.select(*out)


def register(key: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Add a query; without SQL its result is checked by the tests' invariants."""

    def add(query: Query) -> Query:
        if key in QUERIES:
            raise ValueError(f"registered twice: {key}")
        QUERIES[key] = lambda spark, sf_dir: plain(query(spark, sf_dir))
        if sql is not None:
            ORACLES[key] = sql.strip()
        return query

    return add


def load() -> tuple[dict[str, Query], dict[str, str]]:
    for name in _MODULES:
        import_module(f"{__name__}.{name}")
    return QUERIES, ORACLES
