"""Scans, sources and sinks, exercised over whole driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedback_engine import schemas as S
from feedback_engine.catalog import register
from feedback_engine.catalog import sqltext as Q
from feedback_engine.catalog.preparing import complaint_feed
from feedback_engine.operators import prepare as P
from feedback_engine.operators import views as V
from feedback_engine.plans.adapters import docs_view, read_table, reviews_view
from feedback_engine.session import scratch_path
from feedback_engine.sources import files, payloads

R = f"WITH {Q.reviews()}"


def _round_trip(df, name: str):
    """Write in the three formats and read each back with the declared schema."""
    frames = []
    for suffix in files.FORMATS:
        path = scratch_path(df.sparkSession, name) + suffix
        files.write_by_suffix(df, path)
        back = files.read_by_suffix(df.sparkSession, path, df.schema)
        frames.append(back.withColumn("format", F.lit(suffix[1:])))
    return P.union_by_name(frames)


_FORMATS = "(SELECT unnest(['csv', 'parquet', 'json']) AS format)"


@register(
    "src_read_by_suffix",
    f"""{R} SELECT format, source, count(*) AS n, count(raw_text) AS n_text, sum(rating) AS rating_sum,
    min(published_at) AS first_date FROM reviews, {_FORMATS} GROUP BY format, source""",
)
def read_by_suffix(spark, sf_dir):
    rows = reviews_view(spark, sf_dir).select("record_id", "source", "published_at", "raw_text", "rating")
    return _round_trip(rows, "read-by-suffix").groupBy("format", "source").agg(
        F.count(F.lit(1)).alias("n"),
        F.count("raw_text").alias("n_text"),
        F.sum("rating").alias("rating_sum"),
        F.min("published_at").alias("first_date"),
    )


@register(
    "snk_write_by_suffix",
    f"""WITH {Q.docs(label=False)} SELECT format, record_id, md5(raw_text) AS text_hash, region
    FROM docs, {_FORMATS}""",
)
def write_by_suffix(spark, sf_dir):
    back = _round_trip(docs_view(spark, sf_dir, label=False), "write-by-suffix")
    return back.select("format", "record_id", F.md5("raw_text").alias("text_hash"), "region")


@register(
    "src_complaint_csv",
    """SELECT c_mktsegment AS company, o_orderstatus AS status, count(*) AS n,
    count(*) AS with_file, count(*) FILTER (o_orderkey % 3 <> 0) AS with_category
    FROM orders LEFT JOIN customer ON o_custkey = c_custkey WHERE o_orderkey % 5 <> 0 GROUP BY ALL
    UNION ALL SELECT c_mktsegment, ' ', count(*), count(*), count(*) FILTER (o_orderkey % 3 <> 0)
    FROM orders LEFT JOIN customer ON o_custkey = c_custkey WHERE o_orderkey % 5 = 0 GROUP BY ALL""",
)
def complaint_csv(spark, sf_dir):
    feed = complaint_feed(spark, sf_dir)
    path = scratch_path(spark, "complaints")
    keep = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    feed.write.csv(path, header=True, sep=";", quote='"', escape='"', **keep)
    raw = files.read_complaint_csv(spark, f"{path}/*.csv", schema=feed.schema)
    return raw.groupBy(
        F.col("Nome Fantasia").alias("company"), F.col("`Situação`").alias("status")
    ).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("source_file").endswith(".csv")).alias("with_file"),
        F.count("`Grupo Problema`").alias("with_category"),
    )


@register(
    "src_fallback_chain",
    f"{R} SELECT record_id, source FROM reviews WHERE source = 'consumidor_gov'",
)
def fallback_chain(spark, sf_dir):
    missing = scratch_path(spark, "no-such-files")
    reviews = reviews_view(spark, sf_dir)
    return files.first_available(
        [
            lambda: spark.read.parquet(missing),
            lambda: reviews.where(F.col("source") == "no such feed"),
            lambda: P.by_source(reviews, S.COMPLAINT_SOURCE),
        ]
    ).select("record_id", "source")


@register(
    "src_backfill_missing",
    f"""{R} SELECT source, source <> 'google_play' AS from_legacy, count(*) AS n FROM reviews GROUP BY ALL""",
)
def backfill_missing(spark, sf_dir):
    df = reviews_view(spark, sf_dir)
    loaded = P.by_source(df, S.REVIEW_SOURCE).withColumn("region", F.lit("loaded"))
    legacy = df.withColumn("UF", F.lit("legacy")).withColumnsRenamed({"complaint_status": "status"})
    out = P.backfill_missing(loaded, legacy)
    return out.groupBy("source", (F.col("region") == "legacy").alias("from_legacy")).agg(
        F.count(F.lit(1)).alias("n")
    )


@register(
    "src_table_where",
    f"{R} SELECT record_id, rating FROM reviews WHERE source = 'consumidor_gov'",
)
def table_where(spark, sf_dir):
    reviews_view(spark, sf_dir).createOrReplaceTempView("reviews_cleaned")
    where = F.col("source") == S.COMPLAINT_SOURCE
    return files.table_where(spark, "reviews_cleaned", where).select("record_id", "rating")


@register(
    "src_named_query",
    f"""{R} SELECT source, count(*) AS total_records,
    count(*) FILTER (predicted_label = 'Negativo') AS n_neg FROM reviews GROUP BY source""",
)
def named_query(spark, sf_dir):
    queries = files.NamedQueries(spark)
    queries.register(V.register_views(reviews_view(spark, sf_dir)))
    return queries.run("SELECT source, total_records, n_neg FROM vw_source_summary")


@register(
    "src_report_bundle",
    f"""WITH {Q.reviews()} SELECT 'unified' AS dataset, count(*) AS n FROM reviews
    UNION ALL SELECT 'video_sentiment', count(*) FROM reviews WHERE source = 'youtube'
    UNION ALL SELECT 'complaints', count(*) FROM reviews WHERE source = 'consumidor_gov'
    UNION ALL SELECT 'model_summary', count(DISTINCT problem_category) FROM reviews""",
)
def report_bundle(spark, sf_dir):
    df = reviews_view(spark, sf_dir)
    summary = df.select(F.col("problem_category").alias("model")).distinct()
    bundle = files.report_bundle(df, df, summary)
    return V.table_counts(bundle).withColumnRenamed("table_name", "dataset")


@register(
    "src_optional_dataset",
    f"""{R} SELECT 'present' AS dataset, count(*) AS n, count(rating) AS n_rating FROM reviews
    UNION ALL SELECT 'missing', 0, 0""",
)
def optional_dataset(spark, sf_dir):
    absent = scratch_path(spark, "no-such-dataset")
    loads = {
        "present": lambda: reviews_view(spark, sf_dir),
        "missing": lambda: spark.read.parquet(absent),
    }
    return P.union_by_name(
        P.conform(files.optional_dataset(load, spark, S.BRONZE), S.BRONZE)
        .agg(F.count(F.lit(1)).alias("n"), F.count("rating").alias("n_rating"))
        .withColumn("dataset", F.lit(name))
        for name, load in loads.items()
    )


@register("snk_full_refresh", f"{R} SELECT source, count(*) AS n FROM reviews GROUP BY source")
def full_refresh(spark, sf_dir):
    path, df = scratch_path(spark, "full-refresh"), reviews_view(spark, sf_dir)
    for _ in range(2):  # the second run must leave one copy
        files.full_refresh(df, path)
    return V.counts(files.committed(spark, path), "source")


@register("snk_append_replace", f"{R} SELECT source, 2 * count(*) AS n FROM reviews GROUP BY source")
def append_replace(spark, sf_dir):
    path, df = scratch_path(spark, "append"), reviews_view(spark, sf_dir)
    for mode in ("append", "replace", "append"):
        files.append_or_replace(df, path, mode)
    return V.counts(files.committed(spark, path), "source")


@register(
    "snk_prepare_silver",
    f"""{R} SELECT record_id, source, published_at, raw_text, CAST(NULL AS VARCHAR) AS clean_text, rating,
    complaint_status, problem_category, CAST(NULL AS VARCHAR) AS region, app_version, label,
    CAST(NULL AS TIMESTAMP) AS processed_at FROM reviews""",
)
def prepare_silver(spark, sf_dir):
    old = reviews_view(spark, sf_dir).withColumnsRenamed(
        {"complaint_status": "status", "problem_category": "category"}
    )
    return P.prepare_silver(old)


@register(
    "snk_prepare_gold_sentiment",
    f"""WITH {Q.reviews(region=True)} SELECT record_id, source, published_at, raw_text,
    CAST(NULL AS VARCHAR) AS clean_text, rating, complaint_status, problem_category, region, app_version,
    label, predicted_label, topic, CAST(NULL AS TIMESTAMP) AS processed_at FROM reviews""",
)
def prepare_gold_sentiment(spark, sf_dir):
    names = {new: old for old, new in S.LEGACY_NAMES.items()}
    return P.prepare_gold_sentiment(reviews_view(spark, sf_dir, region=True).withColumnsRenamed(names))


# ---- landed payloads -----------------------------------------------------------------------


@register(
    "src_flatten_search_results",
    """SELECT 'v' || (c_custkey % 500) AS video_id, c_name AS video_title,
    'about ' || c_name AS video_description, 'ch' || c_nationkey AS channel_id, c_mktsegment AS channel_title,
    '2024-01-01T00:00:00Z' AS video_published_at, c_mktsegment AS query, 0 AS item_rank FROM customer""",
)
def flatten_search_results(spark, sf_dir):
    def item(video_id):
        snippet = F.struct(
            F.col("c_name").alias("title"),
            F.concat(F.lit("about "), "c_name").alias("description"),
            F.concat(F.lit("ch"), F.col("c_nationkey").cast("string")).alias("channelId"),
            F.col("c_mktsegment").alias("channelTitle"),
            F.lit("2024-01-01T00:00:00Z").alias("publishedAt"),
        )
        return F.struct(F.struct(video_id.alias("videoId")).alias("id"), snippet.alias("snippet"))

    found = F.concat(F.lit("v"), (F.col("c_custkey") % 500).cast("string"))
    pages = read_table(spark, sf_dir, "customer").select(
        F.col("c_mktsegment").alias("query"),
        # The second hit is a channel: it has no video id.
        F.to_json(F.struct(F.array(item(found), item(F.lit(None).cast("string"))).alias("items"))).alias("payload"),
    )
    return payloads.flatten_search_results(pages)


@register(
    "src_flatten_comment_threads",
    """SELECT 'youtube_comments' AS source, 'v' || (o_custkey % 500) AS video_id, 'c' || o_orderkey AS comment_id,
    o_orderdate AS review_date, o_orderpriority AS content, 'u' || o_custkey AS user_name,
    CASE WHEN o_custkey % 3 <> 0 THEN 'uc' || o_custkey END AS author_channel_id,
    o_orderkey % 13 AS like_count, o_orderkey % 4 AS reply_count, CAST(NULL AS VARCHAR) AS comment_updated_at,
    CAST(NULL AS VARCHAR) AS sentiment FROM orders""",
)
def flatten_comment_threads(spark, sf_dir):
    customer = F.col("o_custkey")
    comment = F.struct(
        F.col("o_orderpriority").alias("textOriginal"),
        F.concat(F.lit("u"), customer.cast("string")).alias("authorDisplayName"),
        F.when(customer % 3 != 0, F.struct(F.concat(F.lit("uc"), customer.cast("string")).alias("value"))).alias("authorChannelId"),
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("publishedAt"),
        (F.col("o_orderkey") % 13).alias("likeCount"),
    )
    top = F.struct(
        F.concat(F.lit("c"), F.col("o_orderkey").cast("string")).alias("id"), comment.alias("snippet")
    )
    thread = F.struct(
        F.concat(F.lit("v"), (customer % 500).cast("string")).alias("videoId"),
        (F.col("o_orderkey") % 4).alias("totalReplyCount"),
        top.alias("topLevelComment"),
    )
    landed = read_table(spark, sf_dir, "orders").select(
        F.to_json(F.struct(thread.alias("snippet"))).alias("payload")
    )
    return payloads.flatten_comment_threads(landed)


@register(
    "src_project_reviews",
    f"""SELECT 'r' || o_orderkey AS record_id, 'google_play' AS source, CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) AS published_at,
    o_orderpriority AS raw_text, o_orderkey % 6 AS rating,
    CASE WHEN o_orderkey % 3 = 0 THEN 'v' || (o_orderkey % 5) ELSE 'app' END AS app_version,
    {Q.rating_label("(o_orderkey % 6)")} AS label FROM orders""",
)
def project_reviews(spark, sf_dir):
    key = F.col("o_orderkey")
    landed = read_table(spark, sf_dir, "orders").select(
        F.concat(F.lit("r"), key.cast("string")).alias("reviewId"),
        F.col("o_orderdate").alias("at"),
        F.col("o_orderpriority").alias("content"),
        (key % 6).alias("score"),
        F.when(key % 3 == 0, F.concat(F.lit("v"), (key % 5).cast("string")))
        .when(key % 3 == 1, "")
        .alias("reviewCreatedVersion"),
        F.lit("app").alias("appVersion"),
    )
    return payloads.project_reviews(landed)


@register(
    "src_manifest_select",
    """SELECT o_orderkey AS item, 'Base ' || strftime(o_orderdate, '%m/%Y') AS title,
    '/set/download/a' || o_orderkey || '.csv' AS url, 'a' || o_orderkey || '.csv' AS file_name
    FROM orders WHERE strftime(o_orderdate, '%m/%Y') IN ('03/1996', '04/1996')""",
)
def manifest_select(spark, sf_dir):
    key = F.col("o_orderkey").cast("string")
    links = F.array(
        F.concat(F.lit("/set/info/"), key),
        F.concat(F.lit("/set/download/a"), key, F.lit(".csv")),
        F.concat(F.lit("/set/download/b"), key, F.lit(".csv ")),
    )
    manifest = read_table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("item"),
        F.concat(F.lit(" Base "), F.date_format("o_orderdate", "MM/yyyy")).alias("title"),
        F.posexplode(links).alias("link_rank", "href"),
    )
    return payloads.manifest_select(manifest, ["03/1996", "04/1996"])
