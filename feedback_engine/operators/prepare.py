"""Conforming, filtering, union and de-duplication of feedback records."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedback_engine import schemas as S
from feedback_engine.functions import rules, scalars, text
from feedback_engine.operators.ranking import head_per_group, keep_first

# ---- projections ---------------------------------------------------------------------------


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Project the schema's columns in order; missing ones become typed nulls."""
    present = set(df.columns)
    return df.select(
        *[
            (F.col(f.name) if f.name in present else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema
        ]
    )


def first_alias(df: DataFrame, aliases: Mapping[str, Sequence[str]]) -> DataFrame:
    """Fill each target from the first alias that exists as a column (not value coalesce)."""
    picks = {
        target: next((name for name in names if name in df.columns), None)
        for target, names in aliases.items()
    }
    return df.withColumns({t: F.col(name) for t, name in picks.items() if name})


def rename_legacy(df: DataFrame, names: Mapping[str, str] = S.LEGACY_NAMES) -> DataFrame:
    return df.withColumnsRenamed(dict(names))


def default_source(df: DataFrame, name: str) -> DataFrame:
    return df.withColumn("source", F.coalesce("source", F.lit(name)))


def fill_strip(value: Column, default: str) -> Column:
    """Null or blank to the default, else trimmed."""
    return F.coalesce(F.nullif(F.trim(value.cast("string")), F.lit("")), F.lit(default))


def to_bronze(df: DataFrame, feed: str) -> DataFrame:
    return default_source(conform(first_alias(df, S.BRONZE_ALIASES), S.BRONZE), feed)


def prepare_silver(df: DataFrame) -> DataFrame:
    return conform(rename_legacy(df), S.SILVER)


def prepare_gold_sentiment(df: DataFrame) -> DataFrame:
    return conform(rename_legacy(df), S.GOLD_SENTIMENT)


def prepare_gold_metrics(df: DataFrame) -> DataFrame:
    """Run id, vectoriser from the provenance, observations from up to three text fields."""

    def optional(name: str, dtype: str = "string") -> Column:
        return (F.col(name) if name in df.columns else F.lit(None)).cast(dtype)

    provenance = F.coalesce(optional("provenance"), F.lit(""))
    neural = provenance.startswith("bert") | (provenance == "benchmark")
    parts = [
        F.trim(F.coalesce(optional(name), F.lit("")))
        for name in ("observations", "insight_summary", "provenance")
    ]
    observations = F.trim(F.concat(parts[0], F.lit(" "), parts[1], F.lit(" "), parts[2]))
    out = df.withColumns(
        {
            "run_id": F.coalesce(optional("run_id"), F.md5(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])))),
            "vectorizer": F.coalesce(
                optional("vectorizer"), F.when(neural, "bertimbau").otherwise("tfidf")
            ),
            "trained_at": F.coalesce(optional("trained_at", "timestamp"), F.current_timestamp()),
            "observations": observations,
        }
    )
    return conform(out, S.GOLD_METRICS)


def normalize_reviews(df: DataFrame) -> DataFrame:
    """App reviews to the 11-column processed form."""
    return df.select(
        "record_id",
        "source",
        _timestamp(df, "published_at").alias("published_at"),
        F.lit(None).cast("string").alias("title"),
        "raw_text",
        "rating",
        F.lit(None).cast("string").alias("author"),
        F.lit(None).cast("string").alias("problem_category"),
        F.lit(None).cast("string").alias("complaint_status"),
        "label",
        "app_version",
    )


def _timestamp(df: DataFrame, name: str) -> Column:
    """Parse text columns, pass real timestamps through."""
    if isinstance(df.schema[name].dataType, T.StringType):
        return scalars.parse_timestamp(F.col(name))
    return F.col(name).cast("timestamp")


def normalize_comments(df: DataFrame, zone: str = scalars.LOCAL_ZONE) -> DataFrame:
    """Video comments to the 15-column processed form; publication date in local time."""
    return df.select(
        F.col("comment_id").alias("record_id"),
        F.lit(S.VIDEO_SOURCE).alias("source"),
        scalars.local_date(_timestamp(df, "review_date"), zone).alias("published_at"),
        F.col("video_title").alias("title"),
        F.col("content").alias("raw_text"),
        F.lit(None).cast("double").alias("rating"),
        F.col("user_name").alias("author"),
        F.col("query").alias("problem_category"),
        F.lit(None).cast("string").alias("complaint_status"),
        F.lit(None).cast("string").alias("label"),
        "video_id",
        "channel_title",
        "like_count",
        "reply_count",
        _timestamp(df, "comment_updated_at").alias("comment_updated_at"),
    )


COMPLAINT_COLUMNS = {
    "company": "Nome Fantasia",
    "opened": "Data Abertura",
    "rating": "Nota do Consumidor",
    "status": "Situação",
    "category": "Grupo Problema",
    "region": "UF",
    "subject": "Assunto",
    "problem": "Problema",
    "city": "Cidade",
}


def normalize_complaints(
    df: DataFrame,
    company_pattern: str,
    dedupe_text: bool = True,
    columns: Mapping[str, str] = COMPLAINT_COLUMNS,
) -> DataFrame:
    """Complaint files to the silver contract plus extras.

    Keeps rows of one company, drops rows without a date or text, and (``dedupe_text``) keeps
    the first record per composed text. Record ids hash the row, so a re-run repeats them.
    """

    def raw(key: str) -> Column:
        name = columns[key]
        return F.col(f"`{name}`").cast("string") if name in df.columns else F.lit(None).cast("string")

    def blank(key: str) -> Column:
        return F.coalesce(raw(key), F.lit(""))

    source_file = F.col("source_file") if "source_file" in df.columns else F.lit("")
    row_hash = F.md5(F.concat_ws("\u0001", source_file, *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\u0002")) for c in df.columns if c != "source_file"]))
    composed = text.compose_complaint_text(raw("subject"), raw("problem"), raw("category"))
    out = (
        company_contains(df, columns["company"], company_pattern)
        .select(
            F.concat(F.lit("cg_"), row_hash).alias("record_id"),
            F.lit(S.COMPLAINT_SOURCE).alias("source"),
            scalars.parse_timestamp(raw("opened")).alias("published_at"),
            composed.alias("raw_text"),
            text.clean_complaint(composed).alias("clean_text"),
            scalars.parse_number(raw("rating")).alias("rating"),
            fill_strip(raw("status"), S.NOT_INFORMED).alias("complaint_status"),
            fill_strip(raw("category"), S.NOT_INFORMED).alias("problem_category"),
            fill_strip(raw("region"), S.NOT_INFORMED).alias("region"),
            F.lit(S.NOT_APPLICABLE).alias("app_version"),
            F.lit(None).cast("string").alias("label"),
            F.current_timestamp().alias("processed_at"),
            blank("subject").alias("subject"),
            blank("problem").alias("problem_detail"),
            blank("city").alias("city"),
            blank("company").alias("company"),
            source_file.alias("source_file"),
        )
        .where(F.col("published_at").isNotNull() & (F.length("clean_text") > 0))
    )
    return dedupe_raw_text(out) if dedupe_text else out


def reclean_passthrough(df: DataFrame) -> DataFrame:
    """Input already in the silver contract: add missing extras, recompute the clean text."""
    missing = [f.name for f in S.COMPLAINT_EXTRAS if f.name not in df.columns]
    out = df.withColumns({name: F.lit("") for name in missing}).withColumn(
        "clean_text", text.clean_complaint(F.col("raw_text"))
    )
    return conform(out, T.StructType([*S.SILVER.fields, *S.COMPLAINT_EXTRAS.fields]))


def is_silver(df: DataFrame) -> bool:
    return {f.name for f in S.SILVER} <= set(df.columns)


def override_label(df: DataFrame) -> DataFrame:
    """A known label replaces the prediction; the model's own answer stays in prediction_raw."""
    return df.withColumn("prediction_raw", F.col("predicted_label")).withColumn(
        "predicted_label",
        F.when(F.col("label").isin(*S.LABELS), F.col("label")).otherwise(F.col("predicted_label")),
    )


def coerce_dates(df: DataFrame, column: str = "published_at") -> DataFrame:
    return df.withColumn(column, _timestamp(df, column)) if column in df.columns else df


def preprocess_reviews(
    df: DataFrame, profile: str = "sentiment", brand_terms: Sequence[str] = ()
) -> DataFrame:
    """Bronze to silver: clean the text, drop rows left empty, stamp the time."""
    return (
        df.withColumn("raw_text", F.coalesce("raw_text", F.lit("")))
        .withColumn("clean_text", text.clean_text(F.col("raw_text"), profile, brand_terms=brand_terms))
        .where(F.length("clean_text") > 0)
        .withColumn("processed_at", F.current_timestamp())
    )


# ---- filters -------------------------------------------------------------------------------


def date_window(df: DataFrame, start: str, end: str, column: str = "published_at") -> DataFrame:
    """Rows whose date lies in [start, end]; null dates drop out.

    Written as a range on the column itself, so that it reaches the file scan.
    """
    if start > end:
        raise ValueError("start date cannot be later than end date")
    return utc_window(df, start, end, column)


def utc_window(df: DataFrame, start: str, end: str, column: str = "published_at") -> DataFrame:
    """start <= ts < end + 1 day."""
    first = F.to_timestamp(F.lit(start))
    after = F.to_timestamp(F.date_add(F.to_date(F.lit(end)), 1))
    return df.where((F.col(column) >= first) & (F.col(column) < after))


def report_date_range(
    df: DataFrame, start: str, end: str, column: str = "published_at"
) -> DataFrame:
    """Same window for reports; tables without the column pass unchanged."""
    return utc_window(df, start[:10], end[:10], column) if column in df.columns else df


def company_contains(df: DataFrame, column: str, pattern: str) -> DataFrame:
    return df.where(
        F.coalesce(F.contains(F.lower(F.col(f"`{column}`")), F.lit(pattern.lower())), F.lit(False))
    )


def textual_subset(df: DataFrame) -> DataFrame:
    return df.where(F.trim("raw_text") != "")


def structured_subset(df: DataFrame) -> DataFrame:
    columns = ("problem_category", "complaint_status", "rating")
    return df.where(F.coalesce(*[F.col(c).cast("string") for c in columns]).isNotNull())


def labeled_rows(df: DataFrame) -> DataFrame:
    return df.where(F.col("label").isin(*S.LABELS) & (F.length("clean_text") > 0))


def labeled_training(df: DataFrame) -> DataFrame:
    """``labeled_rows`` with the guard: an error when nothing or only one class is left."""
    out = labeled_rows(df)
    classes = out.select("label").distinct().limit(2).count()
    if classes == 0:
        raise ValueError("no labelled record with clean text to train on")
    if classes < 2:
        raise ValueError("training data has only one class after the split")
    return out


def drop_noisy_neutral(df: DataFrame) -> DataFrame:
    return df.where(~rules.noisy_neutral(F.col("label"), F.col("clean_text")))


def count_noisy_neutral(df: DataFrame) -> DataFrame:
    flag = rules.noisy_neutral(F.col("label"), F.col("clean_text"))
    return df.agg(F.count_if(flag).alias("removed"), F.count_if(~flag).alias("kept"))


def split_by_label(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    return df.where(F.col("label").isNotNull()), df.where(F.col("label").isNull())


def scorable_rows(df: DataFrame) -> DataFrame:
    """Rows with a non-empty model text, with their business theme.

    The theme reads the base text, where a missing text is an empty one.
    """
    base = F.coalesce("raw_text", F.lit(""))
    return df.where(F.length("model_text") > 0).withColumn("theme", rules.classify_theme(base))


def by_source(df: DataFrame, source: str) -> DataFrame:
    return df.where(F.coalesce("source", F.lit("")) == source)


def by_label(df: DataFrame, label: str, column: str = "predicted_label") -> DataFrame:
    return df if label == "Todos" else df.where(F.col(column) == label)


def primary_rows(df: DataFrame) -> DataFrame:
    if "is_primary" not in df.columns:
        return df.limit(0)
    return df.where(scalars.bool_or_false(F.col("is_primary")))


def benchmark_rows(df: DataFrame) -> DataFrame:
    if "provenance" not in df.columns:
        return df.limit(0)
    return df.where(F.col("provenance") == "benchmark")


# ---- union and de-duplication --------------------------------------------------------------


def union_by_name(frames: Iterable[DataFrame]) -> DataFrame:
    first, *rest = frames
    for frame in rest:
        first = first.unionByName(frame, allowMissingColumns=True)
    return first


def dedupe_id_source(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    return keep_first(df, ["record_id", "source"], order)


def dedupe_raw_text(df: DataFrame, order: Sequence[Column] | None = None) -> DataFrame:
    """First record per text."""
    return keep_first(df, ["raw_text"], order or [F.col("record_id")])


def dedupe_videos(df: DataFrame) -> DataFrame:
    """One row per video: the query that comes first wins."""
    return keep_first(df, ["video_id"], [F.col("query_rank"), F.col("item_rank")])


def dedupe_comments(df: DataFrame) -> DataFrame:
    return keep_first(df, ["comment_id", "content"], [F.col("review_date"), F.col("video_id")])


def latest_first(df: DataFrame) -> DataFrame:
    return df.orderBy(F.desc_nulls_last("published_at"), "record_id", "source")


def unified_dataset(frames: Iterable[DataFrame], order: Sequence[Column]) -> DataFrame:
    """Union of the feeds, dates parsed, one row per (record id, source)."""
    feeds = [conform(coerce_dates(rename_legacy(f)), S.UNIFIED) for f in frames]
    return dedupe_id_source(union_by_name(feeds), order)


def missing_sources(df: DataFrame, expected: Sequence[str] = S.ALL_SOURCES) -> DataFrame:
    """Expected feeds that have no row."""
    wanted = df.sparkSession.createDataFrame([(s,) for s in expected], "source string")
    return wanted.join(df.select("source").distinct(), "source", "left_anti")


def backfill_missing(
    loaded: DataFrame, legacy: DataFrame, expected: Sequence[str] = S.ALL_SOURCES
) -> DataFrame:
    """Add legacy rows, but only of feeds the loaded data does not have."""
    names = legacy.where(F.col("source").isin(*expected))
    extra = names.join(loaded.select("source").distinct(), "source", "left_anti")
    return conform(loaded, S.BRONZE).unionByName(conform(rename_legacy(extra), S.BRONZE))


def missing_columns(df: DataFrame, required: Sequence[str]) -> list[str]:
    return sorted(set(required) - set(df.columns))


def cap_per_group(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int
) -> DataFrame:
    """Collector caps: newest ``n`` per video, first ``n`` per query."""
    return head_per_group(df, keys, order, n)


def newest(df: DataFrame, n: int) -> DataFrame:
    return df.orderBy(F.desc_nulls_last("published_at"), "record_id").limit(n)
