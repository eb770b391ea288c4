"""Exploratory tables: counts, completeness, describe, token frequencies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedback_engine.functions import scalars
from feedback_engine.operators.ranking import exact_quantiles, explode_terms, head_per_group
from feedback_engine.operators.views import counts


def value_counts(df: DataFrame, column: str, with_null: bool = False) -> DataFrame:
    """Counts and percent per value; the null bucket is optional."""
    kept = df if with_null else df.where(F.col(column).isNotNull())
    grouped = counts(kept.select(F.col(column).cast("string").alias("value")), "value")
    total = kept.agg(F.count(F.lit(1)).alias("n")).scalar()  # no window over all distinct values
    return grouped.withColumn("pct", F.round(scalars.ratio(F.col("n"), total) * 100, 2))


def span_by_source(df: DataFrame) -> DataFrame:
    return df.groupBy("source").agg(
        F.min("published_at").alias("first_date"),
        F.max("published_at").alias("last_date"),
        F.count("published_at").alias("n_dated"),
    )


def _per_column(df: DataFrame, columns: Sequence[str], value, name: str) -> DataFrame:
    """One aggregate pass over all columns, turned to (column_name, value) rows."""
    cells = [F.struct(F.lit(c).alias("column_name"), value(F.col(c)).alias(name)) for c in columns]
    return df.agg(F.array(*cells).alias("_c")).select(F.inline("_c"))


def completeness(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Percent of non-null values per column."""
    share = lambda c: scalars.ratio(F.count(c) * 100, F.count(F.lit(1)))
    return _per_column(df, columns, share, "pct_filled").orderBy(F.desc("pct_filled"), "column_name")


def null_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return _per_column(df, columns, lambda c: F.count_if(c.isNull()), "n_null")


QUARTILES = {"p25": 0.25, "p50": 0.5, "p75": 0.75}


def describe(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """count, mean, sample std, min, exact quartiles, max."""
    rows = df.where(F.col(column).isNotNull())
    basic = rows.groupBy(*by).agg(
        F.count(column).alias("n"),
        F.avg(column).alias("mean"),
        F.stddev_samp(column).alias("std"),
        F.min(column).alias("min"),
        F.max(column).alias("max"),
    )
    quartiles = exact_quantiles(rows, by, column, QUARTILES)
    if by:
        return basic.join(quartiles, list(by))
    # One row each: read the quartiles as scalars.
    return basic.select(
        "*", *[quartiles.select(name).scalar().alias(name) for name in QUARTILES]
    )


def text_length(df: DataFrame, column: str = "raw_text", by: Sequence[str] = ("source",)) -> DataFrame:
    """Characters (mean, median, min, max) and mean words per group."""
    measured = df.where(F.col(column).isNotNull()).select(
        *by,
        F.length(column).alias("chars"),
        F.size(F.filter(F.split(F.trim(column), r"\s+"), lambda w: w != "")).alias("words"),
    )
    basic = measured.groupBy(*by).agg(
        F.avg("chars").alias("mean_chars"),
        F.min("chars").alias("min_chars"),
        F.max("chars").alias("max_chars"),
        F.avg("words").alias("mean_words"),
    )
    return basic.join(exact_quantiles(measured, by, "chars", {"median_chars": 0.5}), list(by))


def crosstab(df: DataFrame, row: str, column: str, values: Sequence[str]) -> DataFrame:
    kept = df.where(F.col(row).isNotNull() & F.col(column).isNotNull())
    return kept.groupBy(row).pivot(column, list(values)).agg(F.count(F.lit(1))).fillna(0)


def nonnull_by_source(df: DataFrame, column: str = "raw_text") -> DataFrame:
    return df.groupBy("source").agg(F.count(column).alias("n_text"))


def source_month(df: DataFrame) -> DataFrame:
    kept = df.where(F.col("published_at").isNotNull() & F.col("source").isNotNull())
    return counts(
        kept.select("source", scalars.year_month(F.col("published_at")).alias("month")),
        "source",
        "month",
    )


def token_frequencies(
    df: DataFrame, tokens: Column, n: int = 30, by: Sequence[str] = ()
) -> DataFrame:
    """Most frequent tokens, overall or per group."""
    exploded = explode_terms(df, by, tokens, ["token"])
    for key in by:
        exploded = exploded.where(F.col(key).isNotNull())
    grouped = counts(exploded, *by, "token")
    if by:
        return head_per_group(grouped, by, [F.desc("n"), F.col("token")], n)
    return grouped.orderBy(F.desc("n"), "token").limit(n)


def random_sample(df: DataFrame, n: int = 10, seed: int = 42) -> DataFrame:
    """n rows in md5 order of (id, seed): the same rows on every run."""
    return df.orderBy(F.md5(F.concat("record_id", F.lit(str(seed)))), "record_id").limit(n)
