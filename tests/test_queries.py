"""Every registered query against its SQL twin."""

from __future__ import annotations

import math

import duckdb
import pandas as pd
import pytest

from feedback_engine import catalog
from tests.conftest import TABLES

QUERIES, ORACLES = catalog.load()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def canonical(frame: pd.DataFrame) -> list[tuple]:
    def cell(value):
        if value is None or value is pd.NaT or (isinstance(value, float) and math.isnan(value)):
            return "null"
        if isinstance(value, float):
            return repr(round(value, 6) + 0.0)
        return str(value)

    ordered = frame[sorted(frame.columns)]
    return sorted(tuple(map(cell, row)) for row in ordered.itertuples(index=False, name=None))


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_matches_sql(spark, sf_dir, duck, key):
    ours = QUERIES[key](spark, sf_dir).toPandas()
    theirs = duck.execute(ORACLES[key]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert canonical(ours) == canonical(theirs)


def test_only_model_queries_go_without_sql():
    prefixes = ("ml_", "job_")
    assert all(key.startswith(prefixes) for key in set(QUERIES) - set(ORACLES))
