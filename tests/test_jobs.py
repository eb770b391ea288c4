from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from feedback_engine import schemas as S
from feedback_engine.operators import prepare as P
from feedback_engine.operators.features import TfidfSpec
from feedback_engine.plans import jobs
from feedback_engine.sources import files
from tests.conftest import rows

OLD = "record_id string, source string, published_at timestamp, title string, raw_text string, rating double, category string, status string, label string"


def old_unified(spark):
    when = dt.datetime(2025, 1, 2)
    return spark.createDataFrame(
        [
            ("r1", "google_play", when, "t", "App ruim", 1.0, "cat", "st", "Negativo"),
            ("v1", "youtube", when, "t", "Video bom", None, "cat", None, None),
        ],
        OLD,
    )


def test_legacy_only_bronze_and_contracts(spark):
    bronze = jobs.build_bronze({}, old_unified(spark))
    assert bronze.columns == [f.name for f in S.BRONZE] and bronze.count() == 2
    silver = P.prepare_silver(old_unified(spark))
    assert silver.columns == [f.name for f in S.SILVER]
    assert silver.first()["problem_category"] == "cat"
    gold = P.prepare_gold_sentiment(old_unified(spark).withColumn("topic", F.lit("x")))
    assert gold.columns == [f.name for f in S.GOLD_SENTIMENT] and "category" not in gold.columns


def test_backfill_adds_only_absent_feeds(spark):
    complaints = spark.createDataFrame(
        [("cg1", "Reclamação", "SP", None)], "record_id string, raw_text string, UF string, source string"
    )
    feeds = {"consumidor_gov": complaints}
    bronze = jobs.build_bronze(feeds, old_unified(spark))
    assert rows(bronze.select("source").distinct(), "source") == [(s,) for s in sorted(S.ALL_SOURCES)]
    assert bronze.where("record_id = 'cg1'").first()["region"] == "SP"


def test_complaints(spark):
    df = spark.createDataFrame(
        [
            ("Empresa Alfa", "2025-01-02", "4", "Grupo", " ", "SP", "Taxa", "Cobrança", "Recife"),
            ("Outra", "2025-01-02", "4", "Grupo", "x", "SP", "Taxa", "Cobrança", "Recife"),
            (None, "2025-01-02", "4", "Grupo", "x", "SP", "Taxa", "Cobrança", "Recife"),
            ("empresa alfa sa", "ontem", "x", "Grupo", "x", "SP", "Outra", "Cobrança", "Recife"),
        ],
        list(P.COMPLAINT_COLUMNS.values())[:3]
        + ["Grupo Problema", "Situação", "UF", "Assunto", "Problema", "Cidade"],
    )
    out = P.normalize_complaints(df, "ALFA").collect()
    assert len(out) == 1 and len(out[0]) == 17
    assert out[0]["raw_text"] == "Assunto: Taxa | Problema: Cobrança | Categoria: Grupo"
    assert out[0]["clean_text"] == "assunto taxa problema cobrança categoria grupo"
    assert out[0]["complaint_status"] == "Não informado" and out[0]["rating"] == 4.0


def test_gold_metrics(spark):
    df = spark.createDataFrame(
        [("A", 0.5, " boa ", "classic_runtime"), ("B", 0.5, None, "benchmark")],
        "model string, accuracy double, insight_summary string, provenance string",
    )
    out = P.prepare_gold_metrics(df).orderBy("model").collect()
    assert [r["vectorizer"] for r in out] == ["tfidf", "bertimbau"]
    assert [r["observations"] for r in out] == ["boa classic_runtime", "benchmark"]
    assert len(out[0]) == 9 and out[0]["run_id"]


def test_formats_and_fallbacks(spark, tmp_path):
    with pytest.raises(ValueError):
        files.format_of("table.xlsx")
    df = spark.createDataFrame([("1", 'a "b"\nc;d, '), ("2", ""), ("3", None)], "record_id string, raw_text string")
    for suffix in files.FORMATS:
        path = str(tmp_path / f"t{suffix}")
        files.write_by_suffix(df, path)
        back = files.read_by_suffix(spark, path, df.schema, multiline=True)
        # A CSV cell cannot tell an empty text from a missing one.
        expected = df.withColumn("raw_text", F.nullif("raw_text", F.lit(""))) if suffix == ".csv" else df
        assert rows(back, "record_id", "raw_text") == rows(expected, "record_id", "raw_text")
    missing = str(tmp_path / "none")
    with pytest.raises(FileNotFoundError):
        files.first_available([lambda: spark.read.parquet(missing)])
    empty = files.optional_dataset(lambda: spark.read.parquet(missing), spark, S.BRONZE)
    assert empty.schema == S.BRONZE and empty.count() == 0


def test_windows(spark):
    df = spark.createDataFrame([(dt.datetime(2025, 1, 2, 23, 59),), (dt.datetime(2025, 1, 3),), (None,)], "published_at timestamp")
    assert P.utc_window(df, "2025-01-01", "2025-01-02").count() == 1
    with pytest.raises(ValueError):
        P.date_window(df, "2025-02-01", "2025-01-01")
    assert P.report_date_range(df.withColumnRenamed("published_at", "x"), "2025-01-01", "2025-01-02").count() == 3


def test_full_job(spark, tmp_path):
    labels = {"Negativo": (1.0, "ruim trava"), "Neutro": (3.0, "normal comum"), "Positivo": (5.0, "otimo rapido")}
    data = [
        (f"{label}{i}", dt.datetime(2025, 1 + i % 3, 1), f"{words} caso{i % 4}", rating, label)
        for label, (rating, words) in labels.items()
        for i in range(7)
    ]
    feed = spark.createDataFrame(data, "record_id string, published_at timestamp, raw_text string, rating double, label string")
    layers = jobs.Layers(spark, str(tmp_path / "lake"))
    jobs.bronze_job(layers, {"google_play": feed})  # the full run replaces this copy
    tables = jobs.full_job(layers, {"google_play": feed}, spec=TfidfSpec(200), topic_spec=TfidfSpec(50))
    assert layers.read("bronze", "records").count() == 21
    assert {n: t.count() for n, t in tables.items() if n != "topic_analysis"} == {
        "reviews_cleaned": 21, "sentiment_analysis": 21, "model_metrics": 3,
    }
    summary = layers.read("gold", "model_summary")
    assert summary.where("is_primary").count() == 1 and len(summary.columns) == 13
