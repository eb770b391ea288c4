from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from feedback_engine.operators import prepare as P
from feedback_engine.operators import views as V
from feedback_engine.plans.adapters import reviews_view
from feedback_engine.sources.key_index import dedupe_batch, key_index
from feedback_engine.sources.view_store import ViewStore
from tests.conftest import rows

SCHEMA = "record_id string, source string, nr long"


@pytest.fixture
def records(spark):
    data = [(f"r{i % 37}" if i % 11 else None, ["a", "b", None][i % 3], i) for i in range(300)]
    return spark.createDataFrame(data, SCHEMA)


def test_batches_equal_one_run(spark, records, tmp_path):
    index = key_index(spark, str(tmp_path / "index"), records, ["record_id", "source"], 8)
    parts = [dedupe_batch(index, records.where(F.floor(F.col("nr") / 60) == i), [F.col("nr")], f"b{i}") for i in range(5)]
    once = P.dedupe_id_source(records, [F.col("nr")])
    assert rows(P.union_by_name(parts), "nr") == rows(once, "nr")
    again = dedupe_batch(index, records.where(F.floor(F.col("nr") / 60) == 3), [F.col("nr")], "b3")
    assert rows(again, "nr") == rows(parts[3], "nr")  # a retry gives the same rows
    assert dedupe_batch(index, records, [F.col("nr")], "all").count() == 0
    assert dedupe_batch(index, records.where("false"), [F.col("nr")], "none").count() == 0


def test_the_stored_side_is_not_shuffled(spark, records, tmp_path):
    index = key_index(spark, str(tmp_path / "index"), records, ["record_id", "source"], 8)
    dedupe_batch(index, records, [F.col("nr")], "b0")
    plan = index.unseen(records, "b1")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    stored = plan[plan.index("SortMergeJoin") :]
    assert stored.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in stored


def test_index_outlives_its_registration(spark, records, tmp_path):
    """Another session knows the folder only."""
    index = key_index(spark, str(tmp_path / "index"), records, ["record_id", "source"], 8)
    dedupe_batch(index, records, [F.col("nr")], "b0")
    spark.sql(f"DROP TABLE {index.table}")
    assert index.unseen(records, "b1").count() == 0


def test_views_after_three_batches_equal_a_full_run(spark, sf_dir, tmp_path):
    df = reviews_view(spark, sf_dir)
    store = ViewStore(spark, str(tmp_path / "views"))
    for i in (0, 1, 1, 2):
        store.commit(df.where(F.pmod(F.xxhash64("record_id"), F.lit(3)) == i), f"b{i}")

    def check():
        for name, want in V.register_views(df).items():
            found = getattr(store, name.removeprefix("vw_"))()
            assert sorted(found.columns) == sorted(want.columns)
            assert rows(found, *want.columns) == rows(want, *want.columns), name

    check()
    store.compact()
    check()
    store.commit(df, "b2")  # still known after compaction
    check()
