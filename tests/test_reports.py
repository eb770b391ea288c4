from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from feedback_engine.operators import eda, insights, metrics, reports, sampling, themes, trends
from feedback_engine.operators import ranking as RK
from tests.conftest import rows

NEG, NEU, POS = "Negativo", "Neutro", "Positivo"


def test_theme_beats_category_and_uninformative_drop(spark):
    df = spark.createDataFrame(
        [
            ("1", "google_play", NEG, "Pix e transferências", "a"),
            ("2", "youtube", NEG, "Outros temas", "b"),
            ("3", "youtube", POS, "Cartão e fatura", "c"),
            ("4", None, NEG, "Pix e transferências", None),
        ],
        "record_id string, source string, predicted_label string, theme string, raw_text string",
    )
    out = themes.theme_priority(df).collect()
    assert [(r["theme"], r["n"], r["share"], r["example"]) for r in out] == [("Pix e transferências", 2, 1.0, "a")]
    only_bad = themes.theme_priority(df.where("theme = 'Outros temas'")).collect()
    assert [r["theme"] for r in only_bad] == ["Outros temas"]
    assert themes.theme_priority(df, value="Misto").count() == 0


def test_cluster_signal_picks_rows(spark):
    df = spark.createDataFrame(
        [
            ("1", "youtube", NEG, "Pix", NEG, "", "k1"),
            ("2", "youtube", POS, "Pix", NEG, "exemplo", None),
            ("3", "youtube", POS, "Misturado", None, "m", "k3"),
        ],
        "record_id string, source string, predicted_label string, cluster_label string, cluster_signal string, cluster_example string, cluster_keywords string",
    )
    out = themes.theme_priority_clusters(df, value=NEG).first()
    assert (out["theme"], out["n"], out["example"], out["keywords"]) == ("Pix", 2, "exemplo", "k1")
    assert rows(themes.theme_priority_clusters(df, value="Misto"), "theme") == [("Misturado",)]


def _dated(spark):
    data = []
    for i, (month, label, source) in enumerate(
        [(1, POS, "google_play"), (1, NEG, "youtube"), (2, NEG, "google_play"), (3, NEG, "youtube"), (4, NEG, "google_play"), (4, NEG, "youtube")]
    ):
        data.append((str(i), source, dt.datetime(2025, month, 5), label))
    return spark.createDataFrame(data, "record_id string, source string, published_at timestamp, predicted_label string")


def test_trends(spark):
    row = trends.trend_deltas(_dated(spark)).first()
    assert (row["n_months"], row["neg_delta"], row["pos_delta"], row["channel_neg_delta"]) == (4, 0.5, -0.5, 1.0)
    facts = rows(trends.trend_insights(_dated(spark)), "fact")
    assert ("negative_share",) in facts and ("channel",) in facts
    assert trends.trend_insights(_dated(spark).limit(0)).count() == 0


def _scored(spark):
    return _dated(spark).withColumns(
        {
            "theme": F.lit("Conta bloqueada e acesso"),
            "raw_text": F.lit("x"),
            "is_uncertain_neural": F.col("record_id").isin("0", "1", "2"),
        }
    )


def test_insights(spark):
    df = _scored(spark)
    models = spark.createDataFrame([(True, 0.1)], "is_primary boolean, f1_neu double")
    business = insights.business_insights(df, df, models)
    assert business.count() == 5
    audiences = insights.audience_insights(df, df).groupBy("audience").count()
    assert {r["audience"] for r in audiences.collect()} == {"investor", "user", "internal"}
    risks = insights.storyline(df).where("audience = 'risk'")
    assert risks.count() >= 2
    # The share of the neural flag, not 100 %.
    assert "50.0%" in risks.where("fact = 'uncertain'").first()["text"]
    channel = insights.channel_insights(df, df, "no such channel").first()
    assert (channel["n"], channel["top_theme"]) == (0, "Sem dados")
    assert insights.channel_statements(insights.channel_insights(df, df, "none")).count() == 0


def test_summary_of_empty_and_missing(spark):
    empty = _dated(spark).limit(0)
    assert rows(reports.sentiment_summary(empty), "sentiment", "n", "share") == [
        (NEG, 0, "0.0%"), (NEU, 0, "0.0%"), (POS, 0, "0.0%"),
    ]
    with pytest.raises(ValueError):
        reports.require_date_bounds([empty])
    examples = reports.comment_examples(_dated(spark).withColumn("raw_text", F.lit("x" * 300)), 1).collect()
    assert all(len(r["comment"]) == 220 and r["title"] == "Sem titulo" for r in examples)


METRICS = "model string, roc_auc_macro double, f1_macro double, accuracy double"


def test_model_ranking_with_missing_values(spark):
    base = [("A", 0.8, 0.5, 0.9), ("B", 0.9, 0.4, 0.8), ("C", 0.9, 0.3, 0.99)]
    assert metrics.choose_primary(spark.createDataFrame(base, METRICS)).first()["model"] == "B"
    for missing in (None, float("nan")):
        df = spark.createDataFrame([("A", missing, 0.99, 0.9), ("D", 0.1, 0.1, 0.1)], METRICS)
        assert metrics.choose_primary(df).first()["model"] == "D"


def test_merge_benchmark_cannot_win(spark):
    schema = METRICS + ", provenance string"
    classic = spark.createDataFrame([("A", 0.5, 0.5, 0.5, "classic_runtime")], schema)
    bench = spark.createDataFrame([("N", 0.9, 0.9, 0.9, "benchmark")], schema)
    merged = metrics.merge_summaries(classic, bench)
    assert rows(merged.where("is_primary"), "model") == [("A",)]
    assert rows(metrics.merge_summaries(bench).where("is_primary"), "model") == [("N",)]


def test_benchmark_gate(spark):
    schema = "set_id int, model string, accuracy double, f1_macro double, roc_auc_macro double"
    df = spark.createDataFrame(
        [(1, "N", 0.9, 0.6, 0.9), (2, "N", 0.8, 0.6, None), (3, None, 0.1, 0.1, 0.1)], schema
    )
    row = metrics.benchmark_gate(df, "N").first()
    assert (row["available"], row["reason"], row["set_id"]) == (False, "missing: roc_auc_macro", 2)
    assert metrics.benchmark_gate(df.where("set_id = 1"), "N").first()["available"]
    assert metrics.benchmark_gate(df.limit(0), "N").first()["reason"] == "no benchmark rows"


def test_auc_is_null_without_a_class(spark):
    df = spark.createDataFrame(
        [(NEG, 0.8, 0.1, 0.1), (POS, 0.1, 0.2, 0.7)], "label string, score_neg double, score_neu double, score_pos double"
    )
    assert metrics.roc_auc_ovr(df).first()["roc_auc_macro"] is None
    by_class = {r["class"]: r["auc"] for r in metrics.roc_auc_by_class(df).collect()}
    assert by_class == {NEG: 1.0, NEU: None, POS: 1.0}


def test_hot_group_rank_and_quantiles_match_brute_force(spark):
    """Two thirds of the rows share one key and many share one value."""
    df = spark.range(3000).select(
        F.col("id").cast("string").alias("record_id"),
        F.when(F.col("id") % 3 < 2, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("label"),
        F.when(F.col("id") % 4 == 0, 7.0).otherwise(F.sqrt("id")).alias("x"),
    )
    ranked = RK.md5_rank(df, ["label"], F.col("record_id"), 42).toPandas()
    for _, group in ranked.groupby("label"):
        assert sorted(group["cum_n"]) == list(range(1, len(group) + 1))
        assert (group["all_n"] == len(group)).all()
    exact = df.groupBy("label").agg(F.expr("percentile(x, 0.25)").alias("q")).toPandas()
    ours = RK.exact_quantiles(df, ["label"], "x", {"q": 0.25}).toPandas()
    both = exact.merge(ours, on="label")
    assert len(both) == len(exact) and (abs(both["q_x"] - both["q_y"]) < 1e-9).all()


def test_folds_and_samples(spark):
    df = spark.range(100).select(
        F.col("id").cast("string").alias("record_id"),
        F.when(F.col("id") < 80, POS).when(F.col("id") < 97, NEG).otherwise(NEU).alias("label"),
    )
    folds = sampling.stratified_kfold(df).toPandas()
    assert set(folds["fold"]) == {0, 1, 2}  # the smallest class has three rows
    for _, group in folds.groupby("label"):
        sizes = group["fold"].value_counts().reindex([0, 1, 2], fill_value=0)
        assert sizes.max() - sizes.min() <= 1
    sample = {r["label"]: r["count"] for r in sampling.proportional_sample(df, 10).groupBy("label").count().collect()}
    assert sample == {POS: 8, NEG: 2, NEU: 1}
    assert sampling.proportional_sample(df, 1000).count() == 100


def test_describe_of_all_null(spark):
    df = spark.createDataFrame([(None,)], "x double")
    row = eda.describe(df, "x").first()
    assert row["n"] == 0 and row["p50"] is None
