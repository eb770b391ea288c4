"""Gold views and load checks over the reviews view."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedback_engine.catalog import ORACLES, register
from feedback_engine.catalog import sqltext as Q
from feedback_engine.functions.text import clean_text
from feedback_engine.operators import views as V
from feedback_engine.plans.adapters import docs_view, read_table, reviews_view
from feedback_engine.session import scratch_path
from feedback_engine.sources.view_store import ViewStore

R = f"WITH {Q.reviews()}"


@register(
    "vw_general_metrics",
    f"""{R} SELECT count(*) AS total_records, min(published_at) AS period_start,
    max(published_at) AS period_end, count(DISTINCT source) AS n_sources FROM reviews""",
)
def general_metrics(spark, sf_dir):
    return V.general_metrics(reviews_view(spark, sf_dir))


@register(
    "vw_sentiment_by_source",
    f"{R} SELECT source, predicted_label, count(*) AS n FROM reviews GROUP BY ALL",
)
def sentiment_by_source(spark, sf_dir):
    return V.sentiment_by_source(reviews_view(spark, sf_dir))


@register(
    "vw_sentiment_by_month",
    f"""{R} SELECT {Q.month("published_at")} AS month, predicted_label, count(*) AS n
    FROM reviews WHERE published_at IS NOT NULL GROUP BY ALL""",
)
def sentiment_by_month(spark, sf_dir):
    return V.sentiment_by_month(reviews_view(spark, sf_dir))


@register(
    "vw_topics_by_sentiment",
    f"""{R} SELECT predicted_label, topic, count(*) AS n FROM reviews
    WHERE topic IS NOT NULL GROUP BY ALL""",
)
def topics_by_sentiment(spark, sf_dir):
    return V.topics_by_sentiment(reviews_view(spark, sf_dir))


@register(
    "vw_negative_topics",
    f"""{R} SELECT topic, count(*) AS n FROM reviews
    WHERE predicted_label = 'Negativo' GROUP BY ALL""",
)
def negative_topics(spark, sf_dir):
    return V.negative_topics(reviews_view(spark, sf_dir))


SOURCE_SUMMARY = f"""{R} SELECT source, count(*) AS total_records,
    count(*) FILTER (predicted_label = 'Positivo') AS n_pos,
    count(*) FILTER (predicted_label = 'Neutro') AS n_neu,
    count(*) FILTER (predicted_label = 'Negativo') AS n_neg FROM reviews GROUP BY source"""


@register("vw_source_summary", SOURCE_SUMMARY)
def source_summary(spark, sf_dir):
    return V.source_summary(reviews_view(spark, sf_dir))


@register("vw_source_summary_neural", SOURCE_SUMMARY.replace("predicted_label =", "label ="))
def source_summary_neural(spark, sf_dir):
    return V.source_summary(reviews_view(spark, sf_dir), sentiment="label")


@register(
    "chk_table_counts",
    """SELECT 'orders' AS table_name, count(*) AS n FROM orders
    UNION ALL SELECT 'documents', count(*) FROM documents
    UNION ALL SELECT 'lineitem', count(*) FROM lineitem
    UNION ALL SELECT 'events', count(*) FROM events""",
)
def table_counts(spark, sf_dir):
    names = ("orders", "documents", "lineitem", "events")
    return V.table_counts({name: read_table(spark, sf_dir, name) for name in names})


@register("chk_count_by_source", f"{R} SELECT source, count(*) AS n FROM reviews GROUP BY source")
def count_by_source(spark, sf_dir):
    return V.counts(reviews_view(spark, sf_dir), "source")


@register(
    "chk_count_by_prediction",
    f"{R} SELECT predicted_label, count(*) AS n FROM reviews GROUP BY predicted_label",
)
def count_by_prediction(spark, sf_dir):
    return V.counts(reviews_view(spark, sf_dir), "predicted_label")


@register(
    "chk_null_profile",
    f"""WITH {Q.reviews(region=True)}, cleaned AS (SELECT *, {Q.clean("raw_text")} AS c FROM reviews)
    SELECT count(*) FILTER (c = '') AS without_clean_text,
      count(*) FILTER (problem_category IS NULL) AS without_problem_category,
      count(*) FILTER (complaint_status IS NULL) AS without_complaint_status,
      count(*) FILTER (region IS NULL) AS without_region FROM cleaned""",
)
def null_profile(spark, sf_dir):
    df = reviews_view(spark, sf_dir, region=True)
    return V.null_profile(df.withColumn("clean_text", clean_text(F.col("raw_text"))))


@register(
    "chk_recent_sample",
    f"""WITH {Q.reviews(region=True)} SELECT record_id, source, problem_category,
    complaint_status, region, app_version FROM reviews
    ORDER BY published_at DESC NULLS LAST, record_id LIMIT 20""",
)
def recent_sample(spark, sf_dir):
    df = reviews_view(spark, sf_dir, region=True)
    return V.recent_sample(df.withColumn("processed_at", F.col("published_at")))


@register(
    "chk_primary_key",
    f"""WITH {Q.docs(label=False)}, k AS (SELECT md5(raw_text) AS k, count(*) AS n FROM docs GROUP BY 1)
    SELECT 0::BIGINT AS null_keys, count(*) FILTER (n > 1) AS repeated_keys FROM k""",
)
def primary_key(spark, sf_dir):
    df = docs_view(spark, sf_dir, label=False)
    return V.key_violations(df.withColumn("record_id", F.md5("raw_text")))


# ---- views kept by batches -----------------------------------------------------------------


def _view_store(spark, sf_dir) -> ViewStore:
    """Three batches of the records, the second committed twice, compacted before the last."""
    store = ViewStore(spark, scratch_path(spark, "view-store"))
    records = reviews_view(spark, sf_dir)
    part = F.pmod(F.substring("record_id", 2, 20).cast("long"), F.lit(3))
    for i in (0, 1, 1, 2):
        if i == 2:
            store.compact()
        store.commit(records.where(part == i), f"batch-{i}")
    return store


def _register_kept(name: str) -> None:
    @register(f"{name}_kept", ORACLES[name])
    def kept(spark, sf_dir):
        return getattr(_view_store(spark, sf_dir), name.removeprefix("vw_"))()


for _name in ("vw_general_metrics", "vw_sentiment_by_month", "vw_source_summary"):
    _register_kept(_name)
