"""Batch jobs over whole feeds, written to a fresh root in the shared folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedback_engine import schemas as S
from feedback_engine.catalog import register
from feedback_engine.catalog import sqltext as Q
from feedback_engine.operators import prepare as P
from feedback_engine.operators import views as V
from feedback_engine.plans import jobs
from feedback_engine.plans.adapters import reviews_view
from feedback_engine.session import scratch_path

RR = f"WITH {Q.reviews(region=True)}"


def _layers(spark) -> jobs.Layers:
    return jobs.Layers(spark, scratch_path(spark, "layers"))


def _feeds(spark, sf_dir) -> dict:
    records = P.conform(reviews_view(spark, sf_dir, region=True), S.BRONZE)
    return {feed: P.by_source(records, feed) for feed in S.ALL_SOURCES}


BRONZE = f"{RR} SELECT {', '.join(f.name for f in S.BRONZE)} FROM reviews"


@register("job_bronze", BRONZE)
def bronze(spark, sf_dir):
    """Two feeds are loaded, the third comes from the legacy table with its older names."""
    feeds = _feeds(spark, sf_dir)
    names = {new: old for old, new in S.LEGACY_NAMES.items()}
    legacy = reviews_view(spark, sf_dir, region=True).withColumnsRenamed(names)
    del feeds[S.COMPLAINT_SOURCE]
    return jobs.bronze_job(_layers(spark), feeds, legacy)


SILVER = f"""{RR}, s AS (SELECT *, {Q.clean("raw_text")} AS clean_text FROM reviews)
    SELECT record_id, source, published_at, coalesce(raw_text, '') AS raw_text, clean_text, rating, complaint_status,
      problem_category, region, app_version, label FROM s WHERE clean_text <> ''"""


@register("job_silver", SILVER)
def silver(spark, sf_dir):
    layers = _layers(spark)
    out = jobs.silver_job(layers, jobs.bronze_job(layers, _feeds(spark, sf_dir)))
    return out.drop("processed_at")


def _silver(spark, sf_dir, layers):
    return jobs.silver_job(layers, jobs.bronze_job(layers, _feeds(spark, sf_dir)))


@register("job_train")
def train(spark, sf_dir):
    layers = _layers(spark)
    scored, summary = jobs.training_job(layers, _silver(spark, sf_dir, layers))
    return summary


@register("job_topics")
def topics(spark, sf_dir):
    layers = _layers(spark)
    scored = _silver(spark, sf_dir, layers).withColumn(
        "predicted_label", F.coalesce("label", F.lit(S.NEGATIVE))
    )
    members, summary = jobs.topics_job(layers, scored)
    # both tables of the job: the summary, and how many member rows carry each of its clusters
    sizes = members.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n_members"))
    return summary.drop("processed_at").join(sizes, "cluster_id", "left")


@register(
    "job_publish",
    f"""{RR}, s AS (SELECT *, {Q.clean("raw_text")} AS clean_text FROM reviews)
    SELECT t AS table_name, n FROM (SELECT count(*) FILTER (clean_text <> '') AS a, count(*) AS b, count(DISTINCT cluster_id) AS c FROM s),
      LATERAL (VALUES ('reviews_cleaned', a), ('sentiment_analysis', b), ('topic_analysis', c), ('model_metrics', c)) v(t, n)""",
)
def publish(spark, sf_dir):
    layers = _layers(spark)
    df = reviews_view(spark, sf_dir, region=True)
    per_cluster = df.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n_records"))
    summary = P.conform(per_cluster, S.TOPIC_SUMMARY)
    metrics = per_cluster.select(F.col("cluster_id").cast("string").alias("model"))
    published = jobs.publish_job(layers, _silver(spark, sf_dir, layers), df, summary, metrics)
    return V.table_counts(published)


@register("job_full")
def full(spark, sf_dir):
    return V.table_counts(jobs.full_job(_layers(spark), _feeds(spark, sf_dir)))
