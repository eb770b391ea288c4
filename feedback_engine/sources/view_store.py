"""Gold views kept up to date by batches.

A batch adds its own partial counts, by source, month, class and topic, to a table that commits by manifest; a view sums
partials. No view reads records again, and a batch committed twice counts once. Sources and months are groups of the partials,
so distinct counts are exact.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedback_engine.functions.scalars import month_start
from feedback_engine.schemas import NEGATIVE, NEUTRAL, POSITIVE
from feedback_engine.sources.manifest import ManifestTable

DIMENSIONS = ("source", "month", "predicted_label", "topic")


def partials(df: DataFrame) -> DataFrame:
    """Additive counts and extremes of records: one row per source, month, class and topic, null groups included."""
    named = df.withColumn("month", month_start(F.col("published_at")))
    return named.groupBy(*DIMENSIONS).agg(
        F.count(F.lit(1)).alias("n"), F.min("published_at").alias("first"), F.max("published_at").alias("last")
    )


@dataclass(frozen=True)
class ViewStore:
    """The six views over all batches committed so far."""

    spark: SparkSession
    path: str

    @property
    def _table(self) -> ManifestTable:
        return ManifestTable(self.spark, self.path)

    def commit(self, df: DataFrame, batch: str) -> None:
        self._table.append(partials(df), batch)

    def compact(self) -> None:
        """Sum the partials of all batches into one row a group; the batches stay committed."""
        summed = self._table.read().groupBy(*DIMENSIONS).agg(
            F.sum("n").alias("n"), F.min("first").alias("first"), F.max("last").alias("last")
        )
        self._table.rewrite(summed)

    def _sums(self, *keys: str, where: str = "true") -> DataFrame:
        return self._table.read().where(where).groupBy(*keys).agg(F.sum("n").alias("n"))

    def general_metrics(self) -> DataFrame:
        per_source = self._table.read().groupBy("source").agg(
            F.sum("n").alias("n"), F.min("first").alias("first"), F.max("last").alias("last")
        )
        return per_source.agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("total_records"), F.min("first").alias("period_start"),
            F.max("last").alias("period_end"), F.count("source").alias("n_sources"),
        )

    def sentiment_by_source(self) -> DataFrame:
        return self._sums("source", "predicted_label")

    def sentiment_by_month(self) -> DataFrame:
        return self._sums("month", "predicted_label", where="month is not null")

    def topics_by_sentiment(self) -> DataFrame:
        return self._sums("predicted_label", "topic", where="topic is not null")

    def negative_topics(self) -> DataFrame:
        return self._sums("topic", where=f"predicted_label = '{NEGATIVE}'")

    def source_summary(self) -> DataFrame:
        classes = ((POSITIVE, "n_pos"), (NEUTRAL, "n_neu"), (NEGATIVE, "n_neg"))
        return self._table.read().groupBy("source").agg(
            F.sum("n").alias("total_records"),
            *[F.sum(F.when(F.col("predicted_label") == label, F.col("n")).otherwise(0)).alias(name) for label, name in classes],
        )
