"""Plans: no Python per row, map-side limits, pushed filters."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from feedback_engine import catalog
from feedback_engine.operators import cube
from feedback_engine.operators import prepare as P
from feedback_engine.operators import ranking as RK
from feedback_engine.operators import themes
from feedback_engine.plans.adapters import read_table, reviews_view, themed_reviews
from tests.conftest import rows

QUERIES, ORACLES = catalog.load()
CHEAP = sorted(k for k in ORACLES if not k.startswith(("job_", "ml_tfidf", "ml_cluster_k", "ml_pca", "ml_multinomial", "src_", "snk_")))


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("key", CHEAP)
def test_no_python_in_plan(spark, sf_dir, key):
    text = plan(QUERIES[key](spark, sf_dir))
    for node in ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "FlatMapGroups", "CartesianProduct"):
        assert node not in text


def test_keep_first_limits_before_the_shuffle(spark, sf_dir):
    df = RK.keep_first(read_table(spark, sf_dir, "lineitem"), ["l_partkey"], [F.col("l_orderkey")])
    text = plan(df)
    assert "Partial" in text and text.count("WindowGroupLimit") == 2


def test_theme_table_hash_aggregates(spark, sf_dir):
    text = plan(themes.theme_priority(themed_reviews(spark, sf_dir)))
    assert "ObjectHashAggregate" in text and "SortAggregate" not in text


def test_date_filter_and_columns_reach_the_scan(spark, sf_dir):
    orders = read_table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").alias("published_at"))
    text = plan(P.utc_window(orders, "1996-01-01", "1996-12-31").select("o_orderkey"))
    assert "GreaterThanOrEqual(o_orderdate" in text and "o_totalprice" not in text


def test_report_reads_few_columns(spark, sf_dir):
    text = plan(QUERIES["vw_source_summary"](spark, sf_dir))
    assert "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double>" in text


def test_source_filter_is_planned_below_the_aggregate(spark, sf_dir):
    df = P.by_source(reviews_view(spark, sf_dir), "youtube").groupBy("source").count()
    text = plan(df)
    assert text.index("HashAggregate") < text.index("Filter")


def test_scratch_folder_must_be_named(spark):
    from types import SimpleNamespace

    from feedback_engine.session import scratch_root

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch_root(SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: default)))


REPORTS = (
    "rpt_business_insights", "rpt_storyline", "rpt_audience_insights", "rpt_channel_insights", "rpt_channel_statements",
    "rpt_primary_snapshot", "rpt_class_kpis", "rpt_trend_deltas", "rpt_trend_insights",
)


@pytest.mark.parametrize("key", REPORTS)
def test_a_report_reads_the_records_once(spark, sf_dir, key, monkeypatch):
    """The cube's plan scans the records' table once; nothing after it scans them again."""
    plans = []
    real = cube.materialize

    def seen(df, name):
        plans.append(plan(df))
        return real(df, name)

    monkeypatch.setattr(cube, "materialize", seen)
    plans.append(plan(QUERIES[key](spark, sf_dir)))
    scans = [line for text in plans for line in text.split("\n") if "FileScan" in line and "orders.parquet" in line]
    assert len(plans) == 2 and len(scans) == 1 and "orders.parquet" not in plans[1]


def test_cube_has_only_its_sets(spark):
    df = spark.createDataFrame([("a", None), ("a", "x"), (None, "x")], "k string, m string")
    made = cube.fact_cube(df, {"k": F.col("k"), "m": F.col("m")}, [["k"], ["m"], []], {"n": F.lit(1)})
    assert rows(made.by("k"), "k", "n") == [("a", 2), (None, 1)] and rows(made.by("m"), "m", "n") == [("x", 2), (None, 1)]
    assert made.by().first()["n"] == 3
    with pytest.raises(ValueError):
        made.by("k", "m")
    assert cube.fact_cube(df.where("false"), {"k": F.col("k")}, [["k"]], {"n": F.lit(1)}).by("k").count() == 0


def test_scratch_of_a_run_can_be_removed(spark, tmp_path, monkeypatch):
    """In a folder of its own, so that the shared one's files stay."""
    import os

    from feedback_engine import session as SE

    monkeypatch.setattr(SE, "scratch_root", lambda spark: str(tmp_path))
    kept = SE.materialize(spark.range(5), "five")
    assert kept.count() == 5 and os.listdir(SE.run_folder(spark))
    assert SE.clear_scratch(spark) and not os.path.exists(SE.run_folder(spark))
    assert not SE.clear_scratch(spark)
