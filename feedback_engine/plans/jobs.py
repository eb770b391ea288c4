"""Batch jobs: bronze, silver, training, topics, publishing."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedback_engine import schemas as S
from feedback_engine.operators import metrics as M
from feedback_engine.operators import models, prepare, topics
from feedback_engine.operators.features import SPECS, TfidfSpec
from feedback_engine.sources.files import committed, full_refresh


@dataclass(frozen=True)
class Layers:
    """Layer folders under one root, Parquet tables inside."""

    spark: SparkSession
    root: str

    def path(self, layer: str, table: str) -> str:
        return f"{self.root.rstrip('/')}/{layer}/{table}"

    def write(self, df: DataFrame, layer: str, table: str, batch: str | None = None) -> DataFrame:
        """Replace a table in one commit and hand back the stored one, so later stages read, not recompute."""
        full_refresh(df, self.path(layer, table), batch=batch)
        return self.read(layer, table)

    def read(self, layer: str, table: str) -> DataFrame:
        return committed(self.spark, self.path(layer, table))


def build_bronze(feeds: Mapping[str, DataFrame], legacy: DataFrame | None = None) -> DataFrame:
    """Union of the loaded feeds; feeds that are absent come from the legacy table."""
    loaded = [prepare.to_bronze(df, feed) for feed, df in feeds.items()]
    if legacy is None:
        return prepare.union_by_name(loaded)
    old = prepare.conform(prepare.rename_legacy(legacy), S.BRONZE)
    if not loaded:
        return old
    absent = [s for s in S.ALL_SOURCES if s not in feeds]
    return prepare.union_by_name([*loaded, old.where(F.col("source").isin(absent))])


def bronze_job(
    layers: Layers, feeds: Mapping[str, DataFrame], legacy: DataFrame | None = None
) -> DataFrame:
    return layers.write(build_bronze(feeds, legacy), "bronze", "records")


def silver_job(
    layers: Layers, bronze: DataFrame, profile: str = "sentiment", brand_terms: Sequence[str] = ()
) -> DataFrame:
    """Cleaned records; reports read this table, there is no second copy."""
    cleaned = prepare.conform(prepare.preprocess_reviews(bronze, profile, brand_terms), S.SILVER)
    return layers.write(cleaned, "silver", "records")


def training_job(
    layers: Layers,
    silver: DataFrame,
    benchmark: DataFrame | None = None,
    spec: TfidfSpec = SPECS["sentiment"],
    evaluation: str = "cv",
) -> tuple[DataFrame, DataFrame]:
    """Train, score every row, and write the model summary."""
    trained = models.train_select_refit(silver, spec=spec, evaluation=evaluation)
    scored = layers.write(models.score_table(silver, trained.model), "gold", "scored")
    rows = M.summary_rows(trained.metrics, trained.winner, "classic_runtime")
    summary = prepare.conform(M.merge_summaries(rows, benchmark), S.MODEL_SUMMARY)
    return scored, layers.write(summary, "gold", "model_summary")


def topics_job(
    layers: Layers,
    scored: DataFrame,
    method: str = "semantic",
    k: int = 8,
    embedding: str | None = None,
    spec: TfidfSpec = SPECS["topic_fallback"],
    brand_terms: Sequence[str] = (),
) -> tuple[DataFrame, DataFrame]:
    """Topics over the scored rows, written as members and summary; no term contains a brand term."""
    spec = replace(spec, brand_terms=tuple(brand_terms) or spec.brand_terms)
    if method == "semantic":
        members, summary = topics.topic_pipeline(scored, k=k, embedding=embedding, spec=spec)
    elif method == "negatives":
        own = replace(SPECS["negative_topics"], brand_terms=tuple(brand_terms))
        members, summary = topics.negative_topics(scored, k=k, spec=own)
    else:
        raise ValueError(f"unknown topic method: {method}")
    return layers.write(members, "gold", "topic_members"), layers.write(summary, "gold", "topics")


def publish_job(
    layers: Layers, silver: DataFrame, members: DataFrame, summary: DataFrame, metrics: DataFrame, batch: str | None = None
) -> dict[str, DataFrame]:
    """The four warehouse tables, each one atomic replace. With a ``batch`` id a retry only writes what is not there yet."""
    tables = {
        "reviews_cleaned": prepare.prepare_silver(silver),
        "sentiment_analysis": prepare.prepare_gold_sentiment(members),
        "topic_analysis": summary.select(*S.TOPIC_SUMMARY_SHORT),
        "model_metrics": prepare.prepare_gold_metrics(metrics),
    }
    return {name: layers.write(df, "warehouse", name, batch) for name, df in tables.items()}


def full_job(
    layers: Layers,
    feeds: Mapping[str, DataFrame],
    legacy: DataFrame | None = None,
    spec: TfidfSpec = SPECS["sentiment"],
    topic_spec: TfidfSpec = SPECS["topic_fallback"],
    brand_terms: Sequence[str] = (),
) -> dict[str, DataFrame]:
    """All stages in order."""
    silver = silver_job(layers, bronze_job(layers, feeds, legacy), brand_terms=brand_terms)
    scored, summary = training_job(layers, silver, spec=spec)
    members, topic_rows = topics_job(layers, scored, spec=topic_spec, brand_terms=brand_terms)
    return publish_job(layers, silver, members, topic_rows, summary)
