"""Theme priority tables (with and without semantic clusters)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedback_engine import schemas as S
from feedback_engine.functions import rules, text
from feedback_engine.operators.reports import share_of
from feedback_engine.operators.ranking import whole

THEME_COLUMNS = (
    "theme",
    "n",
    "share",
    "dominant_source",
    "dominant_sentiment",
    "cluster_signal",
    "action",
    "example",
    "keywords",
)


def filled_theme(value: Column) -> Column:
    """The trimmed name; null, blank and ``nan`` under the fallback label."""
    trimmed = F.trim(value.cast("string"))
    missing = trimmed.isNull() | trimmed.isin("", "nan")
    return F.when(missing, F.lit(S.NO_INFORMATION)).otherwise(trimmed)


def _first(value: Column, order: Column) -> Column:
    """First non-null value of a group in ``order``."""
    return F.coalesce(F.min_by(value, F.when(value.isNotNull(), order)), F.lit(""))


def _mode(value: Column, missing: str) -> Column:
    """Mode with smallest-value ties. It also makes Spark hash-aggregate the whole group-by."""
    return F.mode(F.coalesce(value.cast("string"), F.lit(missing)), True)


def _top(grouped: DataFrame, n: int) -> DataFrame:
    """Largest themes; the share is over the shown rows only."""
    return grouped.orderBy(F.desc("n"), "theme").limit(n).withColumn("share", share_of(F.col("n")))


def theme_priority(
    df: DataFrame,
    top_n: int = 8,
    sentiment: str = "predicted_label",
    value: str = S.NEGATIVE,
    excluded: Iterable[str] = (),
    theme: str = "theme",
    order: str = "record_id",
    accent_sensitive: bool = False,
) -> DataFrame:
    """Largest themes of one class with source, example and action, in one group-by.

    Uninformative themes are dropped unless nothing else remains.
    """
    grouped = (
        df.where(F.col(sentiment) == value)
        .select(filled_theme(F.col(theme)).alias("theme"), "source", "raw_text", order)
        .groupBy("theme")
        .agg(
            F.count(F.lit(1)).alias("n"),
            _mode(F.col("source"), S.UNKNOWN_SOURCE).alias("_source"),
            _first(F.col("raw_text"), F.col(order)).alias("example"),
        )
    )
    meaningful = ~F.col("theme").isin(*S.UNINFORMATIVE_THEMES, *excluded)
    kept = (
        grouped.withColumn("_m", meaningful)
        .withColumn("_any", F.max("_m").over(whole()))
        .where(F.col("_m") | ~F.col("_any"))
    )
    return (
        _top(kept, top_n)
        .withColumns(
            {
                "dominant_source": text.source_display(F.col("_source")),
                "dominant_sentiment": F.lit(value),
                "cluster_signal": F.lit(value),
                "action": rules.theme_action(F.col("theme"), accent_sensitive),
                "keywords": F.lit(""),
            }
        )
        .select(*THEME_COLUMNS)
    )


def theme_priority_clusters(
    df: DataFrame,
    top_n: int = 8,
    sentiment: str = "predicted_label",
    value: str = S.NEGATIVE,
    excluded: Iterable[str] = (),
    label: str = "cluster_label",
    order: str = "record_id",
    accent_sensitive: bool = False,
) -> DataFrame:
    """Same table over semantic clusters; rows are picked by the cluster's signal.

    Uninformative labels always drop out, even when that leaves nothing. The cluster columns
    other than the label are optional.
    """
    has = set(df.columns)
    rows = df
    if "cluster_signal" in has and value in (S.POSITIVE, S.NEGATIVE, S.MIXED):
        rows = df.where(F.coalesce("cluster_signal", F.lit(S.MIXED)) == value)
    elif value in (S.POSITIVE, S.NEGATIVE):
        rows = df.where(F.col(sentiment) == value)

    def first_of(name: str) -> Column:
        return _first(F.col(name), F.col(order)) if name in has else F.lit("")

    example = F.col("raw_text")
    if "cluster_example" in has:
        example = F.nullif(F.col("cluster_example"), F.lit(""))
    signal = _mode(F.col("cluster_signal"), S.MIXED) if "cluster_signal" in has else F.lit(value)
    grouped = (
        rows.withColumn("theme", filled_theme(F.col(label)))
        .where(~F.col("theme").isin(*S.UNINFORMATIVE_THEMES, *excluded))
        .groupBy("theme")
        .agg(
            F.count(F.lit(1)).alias("n"),
            _mode(F.col("source"), S.UNKNOWN_SOURCE).alias("_source"),
            _mode(F.col(sentiment), S.NO_INFORMATION).alias("dominant_sentiment"),
            signal.alias("cluster_signal"),
            _first(example, F.col(order)).alias("example"),
            first_of("cluster_action").alias("action"),
            first_of("cluster_keywords").alias("keywords"),
        )
    )
    out = _top(grouped, top_n).withColumn("dominant_source", text.source_display(F.col("_source")))
    if "cluster_action" not in has:
        out = out.withColumn("action", rules.theme_action(F.col("theme"), accent_sensitive))
    return out.select(*THEME_COLUMNS)


ATTRIBUTES = ("dominant_source", "dominant_sentiment", "cluster_signal", "action", "example", "keywords")


def theme_attributes(
    df: DataFrame, theme: str = "theme", sentiment: str = "predicted_label", order: str = "record_id",
    accent_sensitive: bool = False,
) -> DataFrame:
    """The six attributes of each theme: most frequent source, class and signal, first action, example and keywords.

    "First" is by ``order``. Cluster columns are optional: without them the signal is the dominant class, the action
    follows from the theme, keywords are empty. Rows without a theme have no attributes.
    """
    has = set(df.columns)

    def first_of(name: str) -> Column:
        return _first(F.col(name), F.col(order)) if name in has else F.lit("")

    example = F.nullif(F.col("cluster_example"), F.lit("")) if "cluster_example" in has else F.col("raw_text")
    sentiment_mode = _mode(F.col(sentiment), S.NO_INFORMATION)
    grouped = df.where(F.col(theme).isNotNull()).groupBy(theme).agg(
        text.source_display(_mode(F.col("source"), S.UNKNOWN_SOURCE)).alias("dominant_source"),
        sentiment_mode.alias("dominant_sentiment"),
        (_mode(F.col("cluster_signal"), S.MIXED) if "cluster_signal" in has else sentiment_mode).alias("cluster_signal"),
        first_of("cluster_action").alias("action"),
        _first(example, F.col(order)).alias("example"),
        first_of("cluster_keywords").alias("keywords"),
    )
    if "cluster_action" not in has:
        grouped = grouped.withColumn("action", rules.theme_action(F.col(theme), accent_sensitive))
    return grouped.select(theme, *ATTRIBUTES)


def join_theme_attributes(themes: DataFrame, attributes: DataFrame, theme: str = "theme") -> DataFrame:
    """Theme rows with their attributes; a theme without any keeps nulls."""
    return themes.join(attributes, theme, "left")
