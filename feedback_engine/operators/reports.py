"""Report tables: volumes, shares, monthly series, top-N, KPIs.

Everything groups the rows first; windows only run over the small grouped results. Share
denominators differ by table and are stated at each function.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedback_engine import schemas as S
from feedback_engine.functions import scalars, text
from feedback_engine.functions.wordlists import PREVIEW_CHARS
from feedback_engine.operators.cube import fact_cube
from feedback_engine.operators.prepare import union_by_name
from feedback_engine.operators.ranking import explode_terms, head_per_group, whole
from feedback_engine.operators.views import counts



def class_order(label: Column) -> Column:
    """Display position of the three classes."""
    pairs = [F.lit(x) for i, name in enumerate(S.DISPLAY_ORDER) for x in (name, i)]
    return F.create_map(*pairs)[label]


def share_of(n: Column, keys: Sequence[str] = ()) -> Column:
    """n over the sum of n (inside ``keys``), 0 when that sum is zero. For grouped rows only."""
    window = Window.partitionBy(*keys) if keys else whole()
    return scalars.ratio(n, F.sum(n).over(window))


def source_volume(df: DataFrame) -> DataFrame:
    """Rows and share of all rows per source (null counts as unknown)."""
    named = df.select(F.coalesce("source", F.lit(S.UNKNOWN_SOURCE)).alias("source"))
    grouped = counts(named, "source")
    return grouped.select(
        text.source_display(F.col("source")).alias("source"), "n", share_of(F.col("n")).alias("share")
    ).orderBy(F.desc("n"), "source")


def monthly_volume(df: DataFrame) -> DataFrame:
    dated = df.where(F.col("published_at").isNotNull())
    return counts(dated.select(scalars.month_start(F.col("published_at")).alias("month")), "month").orderBy("month")


def sentiment_counts(df: DataFrame, sentiment: str = "predicted_label") -> DataFrame:
    """The three classes with their counts, zero-filled; other values are left out."""
    flags = [
        F.struct(
            F.lit(label).alias("sentiment"),
            F.count_if(F.col(sentiment) == label).alias("n"),
        )
        for label in S.DISPLAY_ORDER
    ]
    return df.agg(F.array(*flags).alias("_c")).select(F.inline("_c"))


def sentiment_summary(df: DataFrame, sentiment: str = "predicted_label") -> DataFrame:
    """Counts per class; the share is over the three classes, as ``x.x%``."""
    return sentiment_counts(df, sentiment).select(
        "sentiment", "n", scalars.format_pct(share_of(F.col("n"))).alias("share")
    )


def monthly_sentiment(df: DataFrame, sentiment: str = "predicted_label") -> DataFrame:
    kept = df.where(F.col("published_at").isNotNull() & F.col(sentiment).isNotNull())
    return counts(
        kept.select(
            scalars.month_start(F.col("published_at")).alias("month"),
            F.col(sentiment).alias("sentiment"),
        ),
        "month",
        "sentiment",
    )


def top_n_counts(
    df: DataFrame, column: str, n: int = 10, fallback: str = S.NO_INFORMATION
) -> DataFrame:
    """Most frequent values of a column, null and blank under the fallback label."""
    value = F.coalesce(F.nullif(F.trim(F.col(column).cast("string")), F.lit("")), F.lit(fallback))
    return counts(df.select(value.alias(column)), column).orderBy(F.desc("n"), column).limit(n)


def frequent_words(df: DataFrame, n: int = 10, sentiment: str = "predicted_label") -> DataFrame:
    """Top words of the clean text per class (three letters or more, not only digits)."""
    rows = df.where(F.col(sentiment).isin(*S.LABELS)).withColumn("sentiment", F.col(sentiment))
    words = explode_terms(rows, ["sentiment"], F.split("clean_text", r"\s+"), ["word"]).where(
        text.is_keyword(F.col("word"))
    )
    grouped = counts(words, "sentiment", "word")
    return head_per_group(grouped, ["sentiment"], [F.desc("n"), F.col("word")], n)


def comment_examples(
    df: DataFrame, n: int = 3, sentiment: str = "predicted_label", preview: int | None = PREVIEW_CHARS
) -> DataFrame:
    """Newest rows per class, undated last; ``preview`` characters of the text, None for all of it."""

    def optional(name: str, default: Column) -> Column:
        return F.col(name) if name in df.columns else default

    title = optional("theme", F.lit("Sem titulo"))
    comment = F.coalesce("raw_text", F.lit(""))
    rows = df.where(F.col(sentiment).isin(*S.LABELS)).select(
        F.col(sentiment).alias("sentiment"),
        "record_id",
        "published_at",
        optional("author", F.lit("Nao informado")).alias("author"),
        optional("title", title).alias("title"),
        (comment if preview is None else F.substring(comment, 1, preview)).alias("comment"),
    )
    order = [F.desc_nulls_last("published_at"), F.col("record_id")]
    return head_per_group(rows, ["sentiment"], order, n).select(
        "sentiment",
        "record_id",
        scalars.format_date(F.col("published_at")).alias("published_at"),
        "author",
        "title",
        "comment",
    )


def primary_snapshot(
    df: DataFrame, sentiment: str = "predicted_label", category: str = "problem_category"
) -> DataFrame:
    """Long table (section, key, n, share): total, classes, negative categories, source mix.

    Class shares are over the three classes. Categories are those of negative rows, or of all
    rows when there is no negative row. All sections come from one stored cube.
    """

    def filled(column: str) -> Column:
        value = F.nullif(F.trim(F.col(column)), F.lit(""))
        return F.coalesce(value, F.lit(S.NO_INFORMATION))

    dims = {"sentiment": F.col(sentiment), "category": filled(category), "source": filled("source")}
    cube = fact_cube(df, dims, [["sentiment"], ["category"], ["sentiment", "category"], ["source"]], {"n": F.lit(1)})

    def top(key: str, rows: DataFrame, limit: int) -> DataFrame:
        return rows.select(F.col(key).alias("key"), "n").orderBy(F.desc("n"), "key").limit(limit)

    classes = cube.by("sentiment")
    total = classes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).select(
        F.lit("total").alias("section"), F.lit("records").alias("key"), "n", F.lit(1.0).alias("share")
    )
    per_class = [
        F.struct(
            F.lit(label).alias("key"),
            F.coalesce(F.sum(F.when(F.col("sentiment") == label, F.col("n"))), F.lit(0)).alias("n"),
        )
        for label in S.DISPLAY_ORDER
    ]
    shown = (
        classes.agg(F.array(*per_class).alias("_c"))
        .select(F.inline("_c"))
        .select(F.lit("sentiment").alias("section"), "key", "n", share_of(F.col("n")).alias("share"))
    )
    negative = F.col("sentiment") == S.NEGATIVE
    some = F.coalesce(classes.agg(F.max(negative).alias("m")).scalar(), F.lit(False))
    friction = cube.by("sentiment", "category").where(negative).select("category", "n").union(
        cube.by("category").where(~some).select("category", "n")
    )
    categories = top("category", friction, 8).select(
        F.lit("negative_category").alias("section"), "key", "n", F.lit(None).cast("double").alias("share")
    )
    sources = top("source", cube.by("source"), 5).select(
        F.lit("source_mix").alias("section"),
        text.source_display(F.col("key")).alias("key"),
        "n",
        F.lit(None).cast("double").alias("share"),
    )
    return union_by_name([total, shown, categories, sources])


def sentiment_by_source(df: DataFrame) -> DataFrame:
    """Count and share inside the source; rows with a null key are left out."""
    kept = df.where(F.col("source").isNotNull() & F.col("predicted_label").isNotNull())
    grouped = counts(kept, "source", "predicted_label")
    return grouped.select(
        text.source_display(F.col("source")).alias("source"),
        F.col("predicted_label").alias("sentiment"),
        "n",
        share_of(F.col("n"), ["source"]).alias("source_share"),
    )


def sentiment_source_pivot(df: DataFrame) -> DataFrame:
    """Source x class share matrix, missing cells 0, sources by volume."""
    long = sentiment_by_source(df)
    wide = (
        long.groupBy("source")
        .pivot("sentiment", list(S.DISPLAY_ORDER))
        .agg(F.sum("source_share"))
        .fillna(0.0)
    )
    totals = long.groupBy("source").agg(F.sum("n").alias("n"))
    names = dict(zip(S.DISPLAY_ORDER, ("share_pos", "share_neg", "share_neu")))
    return wide.join(totals, "source").withColumnsRenamed(names).orderBy(F.desc("n"), "source")


def uncertainty_by_source(df: DataFrame) -> DataFrame:
    """Share of uncertain rows per source, a null flag is certain."""
    flag = scalars.bool_or_false(F.col("is_uncertain")).cast("int")
    return (
        df.where(F.col("source").isNotNull())
        .groupBy("source")
        .agg(F.avg(flag).alias("uncertain_share"))
        .select(text.source_display(F.col("source")).alias("source"), "uncertain_share")
        .orderBy(F.desc("uncertain_share"), "source")
    )


def overview_kpis(df: DataFrame, sources: Sequence[str] = S.ALL_SOURCES) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("total_records"),
        F.count_if(F.trim(F.coalesce("raw_text", F.lit(""))) != "").alias("with_text"),
        *[F.count_if(F.col("source") == s).alias(f"n_{s}") for s in sources],
        F.min("published_at").alias("first_date"),
        F.max("published_at").alias("last_date"),
    )


def class_kpis(df: DataFrame, label: str, theme: str = "theme") -> DataFrame:
    """Rows of a class, share of all rows, its first theme, its strongest source by share."""
    dims = {"label": F.col("predicted_label"), "source": F.col("source"), "theme": F.col(theme)}
    cube = fact_cube(df, dims, [["label"], ["label", "source"], ["label", "theme"]], {"n": F.lit(1)})
    mine = F.col("label") == label
    totals = cube.by("label").agg(
        F.coalesce(F.sum(F.when(mine, F.col("n"))), F.lit(0)).alias("n"),
        F.sum("n").alias("_all"),
    )
    informative = ~F.col("theme").isin(*S.UNINFORMATIVE_THEMES) & F.col("theme").isNotNull()
    themes = cube.by("label", "theme").where(mine)
    best_theme = themes.orderBy(F.desc(informative), F.desc("n"), "theme").limit(1).select(
        F.coalesce("theme", F.lit(S.NO_INFORMATION))
    )
    per_source = (
        cube.by("label", "source")
        .where(F.col("source").isNotNull() & F.col("label").isNotNull())
        .groupBy("source")
        .agg(
            scalars.ratio(F.sum(F.when(mine, F.col("n"))), F.sum("n")).alias("share"),
            F.count_if(mine).alias("hits"),
        )
        .where(F.col("hits") > 0)
    )
    best_source = per_source.orderBy(F.desc("share"), "source").limit(1).select(
        text.source_display(F.col("source"))
    )
    return totals.select(
        F.lit(label).alias("label"),
        "n",
        scalars.ratio(F.col("n"), F.col("_all")).alias("share"),
        F.coalesce(best_theme.scalar(), F.lit("Sem tema predominante")).alias("top_theme"),
        F.coalesce(best_source.scalar(), F.lit("Sem canal dominante")).alias("top_source"),
    )


def complaint_kpis(df: DataFrame, resolved_pattern: str = "Resolvida|Finalizada") -> DataFrame:
    """Mean rating, resolved share over all rows, share of ratings <= 2 over rated rows."""
    resolved = F.coalesce("complaint_status", F.lit("")).rlike(f"(?i){resolved_pattern}")
    return df.agg(
        F.coalesce(F.avg("rating"), F.lit(0.0)).alias("mean_rating"),
        F.coalesce(F.avg(resolved.cast("int")), F.lit(0.0)).alias("resolved_share"),
        F.coalesce(F.avg((F.col("rating") <= 2).cast("int")), F.lit(0.0)).alias("low_rating_share"),
    )


def rating_histogram(df: DataFrame) -> DataFrame:
    """Five bins with edges 0.5 … 5.5; the last bin is closed on the right."""
    rating = F.col("rating")
    bucket = F.least(F.floor(rating + 0.5), F.lit(5)).cast("long")
    return counts(df.where(rating.between(0.5, 5.5)).select(bucket.alias("bin")), "bin")


def low_confidence_preview(df: DataFrame, n: int = 15) -> DataFrame:
    """Least confident rows, formatted."""
    order = [F.asc_nulls_last("predicted_label"), F.asc_nulls_last("confidence"), F.col("record_id")]
    return df.orderBy(*order).limit(n).select(
        "record_id",
        scalars.format_date(F.col("published_at")).alias("published_at"),
        "source",
        "problem_category",
        "raw_text",
        "predicted_label",
        F.coalesce(scalars.format_pct(F.col("confidence")), F.lit("-")).alias("confidence"),
    )


def dataset_status(all_rows: Mapping[str, DataFrame], shown: Mapping[str, DataFrame]) -> DataFrame:
    """Rows per dataset after the date filter and as shown."""

    def size(df: DataFrame, name: str) -> DataFrame:
        return df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("dataset"), "n")

    filtered = union_by_name(size(df, name) for name, df in all_rows.items())
    visible = union_by_name(size(df, name) for name, df in shown.items())
    return filtered.withColumnRenamed("n", "n_filtered").join(
        visible.withColumnRenamed("n", "n_shown"), "dataset", "left"
    )


def global_date_bounds(frames: Sequence[DataFrame]) -> DataFrame:
    """First and last date over several datasets; one row, null when there is none."""
    bounds = union_by_name(
        f.agg(F.min("published_at").alias("lo"), F.max("published_at").alias("hi")) for f in frames
    )
    return bounds.agg(F.min("lo").alias("first_date"), F.max("hi").alias("last_date"))


def require_date_bounds(frames: Sequence[DataFrame]) -> tuple:
    """The bounds as values; an error when no dataset has a date."""
    row = global_date_bounds(frames).first()
    if row["first_date"] is None:
        raise ValueError("no valid date in the filterable datasets")
    return row["first_date"], row["last_date"]
