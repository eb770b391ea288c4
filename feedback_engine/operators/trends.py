"""Monthly trends. All windows run over month rows, never over records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedback_engine import schemas as S
from feedback_engine.functions import scalars
from feedback_engine.operators.cube import fact_cube
from feedback_engine.operators.insights import as_rows
from feedback_engine.operators.ranking import whole



CLASS_COUNTS = ((S.POSITIVE, "n_pos"), (S.NEGATIVE, "n_neg"), (S.NEUTRAL, "n_neu"))


def _monthly_counts(df: DataFrame, sentiment: str) -> DataFrame:
    """Counts of the three classes per month."""
    kept = df.where(F.col("published_at").isNotNull() & F.col(sentiment).isNotNull())
    return kept.groupBy(scalars.month_start(F.col("published_at")).alias("month")).agg(
        *[F.count_if(F.col(sentiment) == label).alias(name) for label, name in CLASS_COUNTS]
    )


def _with_shares(months: DataFrame) -> DataFrame:
    total = F.col("n_pos") + F.col("n_neg") + F.col("n_neu")
    safe = F.nullif(total.cast("double"), F.lit(0.0))
    return months.withColumns(
        {
            "total": total,
            "neg_share": F.col("n_neg") / safe,
            "pos_share": F.col("n_pos") / safe,
        }
    )


def trend_mix(df: DataFrame, sentiment: str = "predicted_label") -> DataFrame:
    """Month x class counts with negative and positive share (null when the month has none)."""
    return _with_shares(_monthly_counts(df, sentiment)).orderBy("month")


def _ranked(months: DataFrame) -> DataFrame:
    """Position from both ends: 1 is the first (``_up``) or the last (``_down``) month."""
    return months.withColumns(
        {
            "_up": F.row_number().over(whole().orderBy("month")),
            "_down": F.row_number().over(whole().orderBy(F.desc("month"))),
        }
    )


def _delta(share: str) -> Column:
    last = F.max(F.when(F.col("_down") == 1, F.col(share)))
    return last - F.max(F.when(F.col("_up") == 1, F.col(share)))


def trend_deltas(
    df: DataFrame, sentiment: str = "predicted_label", channel: str = S.REVIEW_SOURCE
) -> DataFrame:
    """One row: last minus first month shares, last 3 minus first 3 months, one channel's delta."""
    kept = df.where(F.col("published_at").isNotNull() & F.col(sentiment).isNotNull())
    dims = {
        "month": scalars.month_start(F.col("published_at")),
        "in_channel": F.coalesce("source", F.lit("")) == channel,
    }
    flags = {name: (F.col(sentiment) == label).cast("int") for label, name in CLASS_COUNTS}
    cube = fact_cube(kept, dims, [["month"], ["month", "in_channel"]], flags)
    months = _ranked(_with_shares(cube.by("month")))
    enough = F.count(F.lit(1))
    first3 = F.avg(F.when(F.col("_up") <= 3, F.col("neg_share")))
    last3 = F.avg(F.when(F.col("_down") <= 3, F.col("neg_share")))
    overall = months.agg(
        enough.alias("n_months"),
        F.when(enough >= 2, _delta("neg_share")).alias("neg_delta"),
        F.when(enough >= 2, _delta("pos_share")).alias("pos_delta"),
        F.when(enough >= 3, last3 - first3).alias("neg_window_delta"),
    )
    one = _ranked(_with_shares(cube.by("month", "in_channel").where("in_channel")))
    channel_delta = one.agg(F.when(enough >= 2, _delta("neg_share")).alias("d"))
    return overall.withColumn("channel_neg_delta", channel_delta.scalar())


def trend_totals(df: DataFrame, sentiment: str = "predicted_label") -> DataFrame:
    """Class totals over dated rows and the negative share delta between the end months."""
    months = _ranked(_with_shares(_monthly_counts(df, sentiment)))
    return months.agg(
        F.coalesce(F.sum("total"), F.lit(0)).alias("total"),
        *[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in ("n_pos", "n_neg", "n_neu")],
        _delta("neg_share").alias("neg_delta"),
    )


def trend_insights(
    df: DataFrame, sentiment: str = "predicted_label", channel: str = S.REVIEW_SOURCE
) -> DataFrame:
    """Up to four trend statements as (rank, fact, text)."""
    pct = lambda c: scalars.format_pct(F.abs(F.col(c)))

    def moved(column: str, up: str, down: str, flat: str | None) -> Column:
        out = F.when(F.col(column) > 0, F.concat(F.lit(up), pct(column))).when(
            F.col(column) < 0, F.concat(F.lit(down), pct(column))
        )
        return out if flat is None else out.when(F.col(column) == 0, F.lit(flat))

    facts = [
        (
            "negative_share",
            moved(
                "neg_delta",
                "Negative share, first to last month: up ",
                "Negative share, first to last month: down ",
                "Negative share, first to last month: unchanged",
            ),
        ),
        (
            "positive_share",
            moved(
                "pos_delta",
                "Positive share, first to last month: up ",
                "Positive share, first to last month: down ",
                None,
            ),
        ),
        (
            "three_month_mean",
            moved(
                "neg_window_delta",
                "Three-month mean of the negative share: worse by ",
                "Three-month mean of the negative share: better by ",
                None,
            ),
        ),
        (
            "channel",
            F.concat(
                F.lit("Negative share of the channel, first to last month: moved "),
                pct("channel_neg_delta"),
            ),
        ),
    ]
    return as_rows(trend_deltas(df, sentiment, channel), [("trend", f, t) for f, t in facts], 4).drop(
        "audience"
    )
