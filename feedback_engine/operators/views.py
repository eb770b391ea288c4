"""Gold views and load checks."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedback_engine.functions.scalars import month_start
from feedback_engine.operators.prepare import union_by_name
from feedback_engine.schemas import NEGATIVE, NEUTRAL, POSITIVE


def counts(df: DataFrame, *keys: str) -> DataFrame:
    """Rows per key; a null key is a group of its own, as in SQL."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def general_metrics(df: DataFrame) -> DataFrame:
    """Totals over all rows, from per-source partial totals.

    Grouping by source first turns the distinct count into a plain count of groups.
    """
    per_source = df.groupBy("source").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("published_at").alias("first"),
        F.max("published_at").alias("last"),
    )
    return per_source.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_records"),
        F.min("first").alias("period_start"),
        F.max("last").alias("period_end"),
        F.count("source").alias("n_sources"),
    )


def sentiment_by_source(df: DataFrame) -> DataFrame:
    return counts(df, "source", "predicted_label")


def sentiment_by_month(df: DataFrame) -> DataFrame:
    dated = df.where(F.col("published_at").isNotNull())
    return counts(dated.withColumn("month", month_start(F.col("published_at"))), "month", "predicted_label")


def topics_by_sentiment(df: DataFrame) -> DataFrame:
    return counts(df.where(F.col("topic").isNotNull()), "predicted_label", "topic")


def negative_topics(df: DataFrame) -> DataFrame:
    return counts(df.where(F.col("predicted_label") == NEGATIVE), "topic")


def source_summary(df: DataFrame, sentiment: str = "predicted_label") -> DataFrame:
    return df.groupBy("source").agg(
        F.count(F.lit(1)).alias("total_records"),
        *[
            F.count_if(F.col(sentiment) == label).alias(name)
            for label, name in ((POSITIVE, "n_pos"), (NEUTRAL, "n_neu"), (NEGATIVE, "n_neg"))
        ],
    )


def register_views(df: DataFrame) -> dict[str, DataFrame]:
    """The six dashboard views over the gold sentiment table, by name."""
    return {
        "vw_general_metrics": general_metrics(df),
        "vw_sentiment_by_source": sentiment_by_source(df),
        "vw_sentiment_by_month": sentiment_by_month(df),
        "vw_topics_by_sentiment": topics_by_sentiment(df),
        "vw_negative_topics": negative_topics(df),
        "vw_source_summary": source_summary(df),
    }


def table_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    return union_by_name(
        df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table_name"), "n")
        for name, df in tables.items()
    )


def null_profile(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count_if(F.coalesce(F.trim("clean_text"), F.lit("")) == "").alias("without_clean_text"),
        F.count_if(F.col("problem_category").isNull()).alias("without_problem_category"),
        F.count_if(F.col("complaint_status").isNull()).alias("without_complaint_status"),
        F.count_if(F.col("region").isNull()).alias("without_region"),
    )


def recent_sample(df: DataFrame, n: int = 20) -> DataFrame:
    columns = ("record_id", "source", "problem_category", "complaint_status", "region", "app_version")
    return df.orderBy(F.desc_nulls_last("processed_at"), "record_id").limit(n).select(*columns)


def key_violations(df: DataFrame, key: str = "record_id") -> DataFrame:
    """Primary-key check of a written table: null and repeated ids."""
    per_key = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return per_key.agg(
        F.coalesce(F.sum(F.when(F.col(key).isNull(), F.col("n"))), F.lit(0)).alias("null_keys"),
        F.count_if(F.col(key).isNotNull() & (F.col("n") > 1)).alias("repeated_keys"),
    )
