from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from feedback_engine.session import local_session  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


@pytest.fixture(scope="session")
def spark():
    session = local_session("feedback_engine-tests", "8", partitions=4)
    session.conf.set("spark.sql.execution.arrow.pyspark.enabled", "true")
    return session


@pytest.fixture(scope="session")
def sf_dir():
    if not os.path.isdir(SF_SMALL):
        pytest.skip("driver tables are not here")
    return SF_SMALL


def rows(df, *columns):
    """Collected rows as tuples, sorted."""
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)
