"""Projections, filters, unions, de-duplication and joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedback_engine import schemas as S
from feedback_engine.catalog import register
from feedback_engine.catalog import sqltext as Q
from feedback_engine.functions import rules, text
from feedback_engine.functions.wordlists import NEGATIVE_NOISE, POSITIVE_NOISE
from feedback_engine.operators import prepare as P
from feedback_engine.operators import themes as TH
from feedback_engine.operators import topics
from feedback_engine.plans.adapters import clustered_reviews, docs_view, read_table, reviews_view, themed_reviews
from feedback_engine.session import scratch_path
from feedback_engine.sources import payloads
from feedback_engine.sources.key_index import dedupe_batch, key_index

R = f"WITH {Q.reviews()}"
D = f"WITH {Q.docs()}"
DATED = f"WITH {Q.docs(dates=True)}"
BRONZE_COLUMNS = ", ".join(f.name for f in S.BRONZE)


@register(
    "prj_rating_to_label",
    f"""{R} SELECT record_id, {Q.rating_label("rating")} AS label,
    {Q.rating_label("rating + 0.5")} AS label_between FROM reviews""",
)
def rating_to_label(spark, sf_dir):
    return reviews_view(spark, sf_dir).select(
        "record_id",
        rules.rating_to_label(F.col("rating")).alias("label"),
        rules.rating_to_label(F.col("rating") + 0.5).alias("label_between"),
    )


@register(
    "flt_date_window_inclusive",
    f"""{R} SELECT record_id, published_at FROM reviews
    WHERE CAST(published_at AS DATE) BETWEEN DATE '1996-03-01' AND DATE '1997-08-31'""",
)
def date_window(spark, sf_dir):
    df = P.date_window(reviews_view(spark, sf_dir), "1996-03-01", "1997-08-31")
    return df.select("record_id", "published_at")


@register(
    "flt_utc_window_half_open",
    """SELECT event_id, ts FROM events WHERE ts >= TIMESTAMP '2024-01-02'
    AND ts < TIMESTAMP '2024-01-11'""",
)
def utc_window(spark, sf_dir):
    events = read_table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return P.utc_window(events, "2024-01-02", "2024-01-10", "ts").select("event_id", "ts")


@register(
    "flt_report_date_range",
    f"""{R} SELECT source, count(*) AS n FROM reviews WHERE published_at >= TIMESTAMP '1998-01-01'
    AND published_at < TIMESTAMP '1999-01-01' GROUP BY source""",
)
def report_date_range(spark, sf_dir):
    df = P.report_date_range(reviews_view(spark, sf_dir), "1998-01-01 13:30:00", "1998-12-31")
    return df.groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@register(
    "flt_company_contains",
    "SELECT c_custkey, c_mktsegment FROM customer WHERE lower(c_mktsegment) LIKE '%build%'",
)
def company_contains(spark, sf_dir):
    df = P.company_contains(read_table(spark, sf_dir, "customer"), "c_mktsegment", "Build")
    return df.select("c_custkey", "c_mktsegment")


@register(
    "prj_conform_schema",
    f"""{R} SELECT record_id, source, published_at, raw_text, rating, complaint_status,
    problem_category, CAST(NULL AS VARCHAR) AS region, app_version, label FROM reviews""",
)
def conform_schema(spark, sf_dir):
    return P.conform(reviews_view(spark, sf_dir), S.BRONZE)


@register(
    "prj_first_alias",
    f"{R} SELECT record_id, complaint_status, problem_category, app_version FROM reviews",
)
def first_alias(spark, sf_dir):
    old = reviews_view(spark, sf_dir).withColumnsRenamed(
        {"complaint_status": "status", "problem_category": "category"}
    )
    aliased = P.first_alias(old, S.BRONZE_ALIASES)
    return aliased.select("record_id", "complaint_status", "problem_category", "app_version")


@register(
    "prj_rename_legacy",
    f"""WITH {Q.reviews(region=True)}
    SELECT record_id, complaint_status, problem_category, region FROM reviews""",
)
def rename_legacy(spark, sf_dir):
    names = {new: old for old, new in S.LEGACY_NAMES.items()}
    old = reviews_view(spark, sf_dir, region=True).withColumnsRenamed(names)
    return P.rename_legacy(old).select(
        "record_id", "complaint_status", "problem_category", "region"
    )


@register(
    "prj_default_source",
    f"""{R} SELECT coalesce(CASE WHEN rating IS NOT NULL THEN source END, 'youtube') AS source,
    count(*) AS n FROM reviews GROUP BY 1""",
)
def default_source(spark, sf_dir):
    df = reviews_view(spark, sf_dir).withColumn(
        "source", F.when(F.col("rating").isNotNull(), F.col("source"))
    )
    return P.default_source(df, "youtube").groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@register(
    "prj_fill_strip_default",
    f"""{R} SELECT record_id, coalesce(nullif(trim(complaint_status), ''), 'Não informado') AS status,
    coalesce(nullif(trim(raw_text), ''), 'Não informado') AS text FROM reviews""",
)
def fill_strip_default(spark, sf_dir):
    return reviews_view(spark, sf_dir).select(
        "record_id",
        P.fill_strip(F.col("complaint_status"), S.NOT_INFORMED).alias("status"),
        P.fill_strip(F.col("raw_text"), S.NOT_INFORMED).alias("text"),
    )


@register(
    "prj_normalize_reviews",
    f"""{R} SELECT record_id, source, published_at, CAST(NULL AS VARCHAR) AS title, raw_text, rating,
    CAST(NULL AS VARCHAR) AS author, CAST(NULL AS VARCHAR) AS problem_category,
    CAST(NULL AS VARCHAR) AS complaint_status, label, app_version FROM reviews""",
)
def normalize_reviews(spark, sf_dir):
    raw = reviews_view(spark, sf_dir)
    landed = raw.withColumn("published_at", F.date_format("published_at", "yyyy-MM-dd HH:mm:ss"))
    return P.normalize_reviews(landed)


@register(
    "prj_normalize_comments",
    """SELECT 'c' || event_id AS record_id, 'youtube' AS source,
    CAST(CAST((ts - INTERVAL 3 HOUR) AS DATE) AS TIMESTAMP) AS published_at, event_type AS title,
    props AS raw_text, CAST(NULL AS DOUBLE) AS rating, 'u' || user_id AS author,
    event_type AS problem_category, CAST(NULL AS VARCHAR) AS complaint_status,
    CAST(NULL AS VARCHAR) AS label, 'v' || (user_id % 40) AS video_id,
    'ch' || (user_id % 7) AS channel_title, user_id % 11 AS like_count, user_id % 3 AS reply_count,
    ts AS comment_updated_at FROM events""",
)
def normalize_comments(spark, sf_dir):
    raw = read_table(spark, sf_dir, "events").select(
        F.concat(F.lit("c"), F.col("event_id").cast("string")).alias("comment_id"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("review_date"),
        F.col("event_type").alias("video_title"),
        F.col("props").alias("content"),
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("user_name"),
        F.col("event_type").alias("query"),
        F.concat(F.lit("v"), (F.col("user_id") % 40).cast("string")).alias("video_id"),
        F.concat(F.lit("ch"), (F.col("user_id") % 7).cast("string")).alias("channel_title"),
        (F.col("user_id") % 11).alias("like_count"),
        (F.col("user_id") % 3).alias("reply_count"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("comment_updated_at"),
    )
    return P.normalize_comments(raw)


def complaint_feed(spark, sf_dir):
    """Orders in the layout of the complaint files (text columns, blank and bad values)."""
    key = F.col("o_orderkey")
    return read_table(spark, sf_dir, "orders").join(
        read_table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left"
    ).select(
        F.col("c_mktsegment").alias("Nome Fantasia"),
        F.when(key % 29 == 0, "sem data").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("Data Abertura"),
        F.when(key % 7 == 0, "x").otherwise(F.substring("o_orderpriority", 1, 1)).alias("Nota do Consumidor"),
        F.when(key % 5 == 0, " ").otherwise(F.col("o_orderstatus")).alias("Situação"),
        F.when(key % 3 == 0, None).otherwise(F.col("o_orderpriority")).alias("Grupo Problema"),
        F.concat(F.lit("Café "), (F.col("o_custkey") % 50).cast("string"), F.lit(" Às 10h http://a.b/c")).alias("Assunto"),
        F.when(key % 4 == 0, "").otherwise(F.concat(F.lit("Não "), F.col("o_orderstatus"))).alias("Problema"),
        F.col("c_name").alias("Cidade"),
    )


def _complaint_sql() -> str:
    subject = "'Café ' || (o_custkey % 50) || ' Às 10h http://a.b/c'"
    problem = "CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE 'Não ' || o_orderstatus END"
    category = "CASE WHEN o_orderkey % 3 <> 0 THEN o_orderpriority END"
    text_ = (
        f"'Assunto: ' || {subject} || ' | ' || CASE WHEN ({problem}) <> '' THEN 'Problema: ' || "
        f"({problem}) ELSE '' END || ' | ' || coalesce('Categoria: ' || ({category}), '')"
    )
    return rf"""feed AS (
      SELECT regexp_replace({text_}, '^[ |]+|[ |]+$', '', 'g') AS raw_text,
        CASE WHEN o_orderkey % 29 <> 0 THEN o_orderdate END AS published_at,
        CASE WHEN o_orderkey % 7 <> 0 THEN CAST(substr(o_orderpriority, 1, 1) AS DOUBLE) END AS rating,
        CASE WHEN o_orderkey % 5 = 0 THEN 'Não informado' ELSE o_orderstatus END AS complaint_status,
        coalesce({category}, 'Não informado') AS problem_category, c_mktsegment AS company
      FROM orders LEFT JOIN customer ON o_custkey = c_custkey
      WHERE lower(c_mktsegment) LIKE '%build%' AND o_orderkey % 29 <> 0)"""


def complaint_clean_sql(x: str) -> str:
    out = rf"regexp_replace(lower(coalesce({x}, '')), 'http[^\s\x0B\x1C-\x1F\x{{85}}\p{{Z}}]+', '', 'g')"
    out = rf"regexp_replace({out}, '[^a-zà-ú0-9\s]', ' ', 'g')"
    return rf"trim(regexp_replace({out}, '\s+', ' ', 'g'))"


@register(
    "prj_normalize_complaints",
    f"""WITH {_complaint_sql()} SELECT raw_text, {complaint_clean_sql("raw_text")} AS clean_text,
    problem_category, count(*) AS n, {Q.r6("avg(rating)")} AS mean_rating,
    count(*) FILTER (complaint_status = 'Não informado') AS without_status,
    min(published_at) AS first_date FROM feed GROUP BY ALL""",
)
def normalize_complaints(spark, sf_dir):
    feed = complaint_feed(spark, sf_dir)
    return P.normalize_complaints(feed, "build", dedupe_text=False).groupBy(
        "raw_text", "clean_text", "problem_category"
    ).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("rating").alias("mean_rating"),
        F.count_if(F.col("complaint_status") == S.NOT_INFORMED).alias("without_status"),
        F.min("published_at").alias("first_date"),
    )


@register(
    "prj_normalize_complaints_deduped",
    f"WITH {_complaint_sql()} SELECT DISTINCT raw_text, {complaint_clean_sql('raw_text')} AS clean_text FROM feed",
)
def normalize_complaints_deduped(spark, sf_dir):
    return P.normalize_complaints(complaint_feed(spark, sf_dir), "build").select("raw_text", "clean_text")


@register(
    "prj_reclean_passthrough",
    f"""{R} SELECT record_id, {complaint_clean_sql("raw_text")} AS clean_text, '' AS city FROM reviews""",
)
def reclean_passthrough(spark, sf_dir):
    silver = P.prepare_silver(reviews_view(spark, sf_dir))
    return P.reclean_passthrough(silver).select("record_id", "clean_text", "city")


@register(
    "flt_textual_subset",
    f"{R} SELECT record_id, raw_text FROM reviews WHERE trim(raw_text) <> ''",
)
def textual_subset(spark, sf_dir):
    return P.textual_subset(reviews_view(spark, sf_dir)).select("record_id", "raw_text")


STRUCTURED = "CASE WHEN is_uncertain THEN problem_category END"


@register(
    "flt_structured_subset",
    f"""{R} SELECT record_id FROM reviews WHERE rating IS NOT NULL OR complaint_status IS NOT NULL
    OR {STRUCTURED} IS NOT NULL""",
)
def structured_subset(spark, sf_dir):
    df = reviews_view(spark, sf_dir).withColumn(
        "problem_category", F.when(F.col("is_uncertain"), F.col("problem_category"))
    )
    return P.structured_subset(df).select("record_id")


def labelled_reviews(spark, sf_dir):
    return reviews_view(spark, sf_dir).withColumn("clean_text", text.clean_text(F.col("raw_text")))


LABELLED = f"""{R}, cleaned AS (SELECT *, {Q.clean("raw_text")} AS clean_text FROM reviews)"""
_NOISY = (
    f"(label = 'Neutro' AND regexp_matches(clean_text, '{'|'.join(POSITIVE_NOISE)}') "
    f"<> regexp_matches(clean_text, '{'|'.join(NEGATIVE_NOISE)}'))"
)


@register(
    "flt_labeled_training",
    f"{LABELLED} SELECT record_id, label, clean_text FROM cleaned WHERE label IS NOT NULL AND clean_text <> ''",
)
def labeled_training(spark, sf_dir):
    return P.labeled_training(labelled_reviews(spark, sf_dir)).select("record_id", "label", "clean_text")


@register(
    "flt_noisy_neutral",
    f"""{LABELLED} SELECT count(*) FILTER ({_NOISY}) AS removed,
    count(*) FILTER (NOT {_NOISY}) AS kept FROM cleaned WHERE label IS NOT NULL AND clean_text <> ''""",
)
def noisy_neutral(spark, sf_dir):
    return P.count_noisy_neutral(P.labeled_rows(labelled_reviews(spark, sf_dir)))


@register(
    "flt_noisy_neutral_rows",
    f"""{LABELLED} SELECT record_id FROM cleaned WHERE label IS NOT NULL AND clean_text <> ''
    AND NOT {_NOISY}""",
)
def noisy_neutral_rows(spark, sf_dir):
    return P.drop_noisy_neutral(P.labeled_rows(labelled_reviews(spark, sf_dir))).select("record_id")


@register(
    "flt_labeled_unlabeled_split",
    f"""{D} SELECT record_id, CASE WHEN label IS NULL THEN 'predict' ELSE 'train' END AS part FROM docs""",
)
def labeled_unlabeled_split(spark, sf_dir):
    train, predict = P.split_by_label(docs_view(spark, sf_dir).select("record_id", "label"))
    return P.union_by_name(
        [train.withColumn("part", F.lit("train")), predict.withColumn("part", F.lit("predict"))]
    ).drop("label")


@register(
    "flt_scorable_rows",
    f"""{R} SELECT record_id, {Q.theme("coalesce(raw_text, '')")} AS theme FROM reviews
    WHERE length(raw_text) > 0""",
)
def scorable_rows(spark, sf_dir):
    df = reviews_view(spark, sf_dir).withColumn("model_text", F.col("raw_text"))
    return P.scorable_rows(df).select("record_id", "theme")


@register("flt_by_source", f"{R} SELECT record_id FROM reviews WHERE source = 'youtube'")
def by_source(spark, sf_dir):
    return P.by_source(reviews_view(spark, sf_dir), S.VIDEO_SOURCE).select("record_id")


@register(
    "flt_by_label",
    f"""{R} SELECT 'Negativo' AS choice, count(*) FILTER (predicted_label = 'Negativo') AS n FROM reviews
    UNION ALL SELECT 'Todos', count(*) FROM reviews""",
)
def by_label(spark, sf_dir):
    df = reviews_view(spark, sf_dir)
    return P.union_by_name(
        P.by_label(df, choice).agg(F.count(F.lit(1)).alias("n")).withColumn("choice", F.lit(choice))
        for choice in ("Negativo", "Todos")
    )


@register(
    "prj_label_override",
    f"""{R} SELECT record_id, coalesce(label, predicted_label) AS predicted_label,
    predicted_label AS prediction_raw, {Q.r6("confidence")} AS confidence FROM reviews""",
)
def label_override(spark, sf_dir):
    return P.override_label(reviews_view(spark, sf_dir)).select(
        "record_id", "predicted_label", "prediction_raw", "confidence"
    )


@register(
    "prj_source_display",
    f"""{R}, named AS (SELECT source FROM reviews UNION ALL SELECT lower(n_name) FROM nation
      UNION ALL SELECT 'portal_' || source FROM documents)
    SELECT source, {Q.display("source")} AS name, count(*) AS n FROM named GROUP BY ALL""",
)
def source_display(spark, sf_dir):
    named = P.union_by_name(
        [
            reviews_view(spark, sf_dir).select("source"),
            read_table(spark, sf_dir, "nation").select(F.lower("n_name").alias("source")),
            read_table(spark, sf_dir, "documents").select(F.concat(F.lit("portal_"), "source").alias("source")),
        ]
    )
    return named.groupBy("source", text.source_display(F.col("source")).alias("name")).agg(
        F.count(F.lit(1)).alias("n")
    )


@register(
    "prj_coerce_dates",
    f"{R} SELECT record_id, published_at FROM reviews",
)
def coerce_dates(spark, sf_dir):
    landed = reviews_view(spark, sf_dir).select(
        "record_id",
        F.coalesce(F.date_format("published_at", "yyyy-MM-dd HH:mm:ss"), F.lit("sem data")).alias("published_at"),
    )
    return P.coerce_dates(landed)


# ---- joins ---------------------------------------------------------------------------------


@register(
    "join_theme_attributes",
    f"""WITH {Q.clustered()}, t AS (SELECT DISTINCT cluster_label AS theme FROM clustered
        UNION ALL SELECT 'a theme of no record'),
      a AS (SELECT cluster_label AS theme, {Q.display("mode(source ORDER BY source)")} AS dominant_source,
        mode(coalesce(predicted_label, 'Sem informacao') ORDER BY coalesce(predicted_label, 'Sem informacao')) AS dominant_sentiment,
        mode(coalesce(cluster_signal, 'Misto') ORDER BY coalesce(cluster_signal, 'Misto')) AS cluster_signal,
        coalesce(arg_min(cluster_action, record_id) FILTER (cluster_action IS NOT NULL), '') AS action,
        coalesce(arg_min(cluster_example, record_id) FILTER (cluster_example <> ''), '') AS example,
        coalesce(arg_min(cluster_keywords, record_id) FILTER (cluster_keywords IS NOT NULL), '') AS keywords
      FROM clustered WHERE cluster_label IS NOT NULL GROUP BY 1)
    SELECT t.theme, dominant_source, dominant_sentiment, cluster_signal, action, example, keywords FROM t LEFT JOIN a USING (theme)""",
)
def theme_attributes(spark, sf_dir):
    rows = clustered_reviews(spark, sf_dir).withColumn("theme", F.col("cluster_label"))
    names = rows.select("theme").distinct().union(spark.sql("SELECT 'a theme of no record'"))
    return TH.join_theme_attributes(names, TH.theme_attributes(rows))


_SHARES = ", ".join(
    f"avg(CASE WHEN predicted_label = '{label}' THEN 1.0 ELSE 0.0 END) AS {name}"
    for label, name in (("Positivo", "share_pos"), ("Negativo", "share_neg"), ("Neutro", "share_neu"))
)


@register(
    "join_scatter_cluster",
    f"""{R}, dim AS (SELECT cluster_id, {_SHARES} FROM reviews GROUP BY cluster_id)
    SELECT record_id, cluster_id, 'Topico ' || (cluster_id + 1) AS cluster_label,
    {Q.r6("share_pos")} AS share_pos FROM reviews JOIN dim USING (cluster_id)""",
)
def scatter_cluster(spark, sf_dir):
    df = reviews_view(spark, sf_dir)
    dim = topics.cluster_shares(df).select(
        "cluster_id",
        F.format_string("Topico %d", F.col("cluster_id") + 1).alias("topic_name"),
        *[F.lit("").alias(c) for c in ("keywords", "suggested_action", "representative_example")],
        rules.cluster_signal(F.col("share_pos"), F.col("share_neg")).alias("cluster_signal"),
        "share_pos",
        "share_neg",
        "share_neu",
    )
    return topics.scatter_clusters(df, dim).select(
        "record_id", "cluster_id", "cluster_label", F.col("cluster_share_pos").alias("share_pos")
    )


@register(
    "join_scatter_topic",
    f"""{R} SELECT record_id, CASE WHEN predicted_label = 'Negativo'
    THEN 'Topico ' || (cluster_id + 1) END AS topic FROM reviews""",
)
def scatter_topic(spark, sf_dir):
    df = reviews_view(spark, sf_dir)
    clustered = df.where(F.col("predicted_label") == S.NEGATIVE).select("record_id", "cluster_id")
    return topics.scatter_topic(df.select("record_id"), clustered)


@register(
    "join_missing_sources",
    """SELECT s AS source FROM (SELECT unnest(['google_play', 'youtube', 'src0', 'src1']) AS s)
    WHERE s NOT IN (SELECT source FROM documents)""",
)
def missing_sources(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    return P.missing_sources(docs, ("google_play", "youtube", "src0", "src1"))


@register(
    "set_difference_keys",
    f"""{R}, loaded AS (SELECT DISTINCT source FROM reviews WHERE rating IS NULL)
    SELECT s AS source FROM (SELECT unnest(['google_play', 'youtube', 'consumidor_gov']) AS s)
    WHERE s NOT IN (SELECT source FROM loaded)""",
)
def difference_keys(spark, sf_dir):
    return P.missing_sources(reviews_view(spark, sf_dir).where(F.col("rating").isNull()))


def comments(spark, sf_dir):
    return read_table(spark, sf_dir, "orders").select(
        F.concat(F.lit("c"), F.col("o_orderkey").cast("string")).alias("comment_id"),
        F.concat(F.lit("v"), (F.col("o_custkey") % 500).cast("string")).alias("video_id"),
        F.col("o_orderdate").cast("timestamp").alias("review_date"),
        F.col("o_orderpriority").alias("content"),
    )


def videos(spark, sf_dir):
    """Search hits: each customer's page found one video, many pages the same one."""
    segment = F.col("c_mktsegment")
    return read_table(spark, sf_dir, "customer").select(
        F.concat(F.lit("v"), (F.col("c_custkey") % 500).cast("string")).alias("video_id"),
        F.col("c_name").alias("video_title"),
        F.lit(None).cast("string").alias("video_description"),
        F.concat(F.lit("ch"), F.col("c_nationkey").cast("string")).alias("channel_id"),
        segment.alias("channel_title"),
        F.lit("2024-01-01").alias("video_published_at"),
        segment.alias("query"),
        F.ascii(segment).alias("query_rank"),
        F.col("c_custkey").alias("item_rank"),
    )


VIDEOS = """videos AS (SELECT 'v' || (c_custkey % 500) AS video_id, c_name AS video_title,
      c_mktsegment AS query, c_custkey AS item_rank, row_number() OVER (PARTITION BY c_custkey % 500
        ORDER BY ascii(c_mktsegment), c_custkey) AS rn FROM customer)"""


@register(
    "join_video_attrs",
    f"""WITH {VIDEOS} SELECT 'c' || o_orderkey AS comment_id, video_id, video_title, query
    FROM orders JOIN videos ON video_id = 'v' || (o_custkey % 500) WHERE rn = 1""",
)
def video_attrs(spark, sf_dir):
    joined = payloads.attach_video_attributes(
        comments(spark, sf_dir), P.dedupe_videos(videos(spark, sf_dir))
    )
    return joined.select("comment_id", "video_id", "video_title", "query")


# ---- union and de-duplication --------------------------------------------------------------


@register(
    "set_union_by_name",
    f"""{R}, {Q.docs(label=False)}, u AS (SELECT record_id, source, raw_text, rating, CAST(NULL AS VARCHAR) AS region
      FROM reviews UNION ALL SELECT record_id, source, raw_text, NULL, region FROM docs)
    SELECT source, count(*) AS n, count(rating) AS n_rating, count(region) AS n_region FROM u GROUP BY source""",
)
def union_by_name(spark, sf_dir):
    reviews = reviews_view(spark, sf_dir).select("record_id", "source", "raw_text", "rating")
    both = P.union_by_name([reviews, docs_view(spark, sf_dir, label=False)])
    return both.groupBy("source").agg(
        F.count(F.lit(1)).alias("n"),
        F.count("rating").alias("n_rating"),
        F.count("region").alias("n_region"),
    )


def three_feeds(spark, sf_dir):
    """One feed per source; the video feed repeats the review feed's ids, one feed comes twice."""
    df = reviews_view(spark, sf_dir)
    reviews, videos_, complaints = (P.by_source(df, s) for s in S.ALL_SOURCES)
    return [reviews, videos_, complaints, reviews]


UNIFIED = f"""{R}, u AS (
      SELECT record_id, source, published_at, raw_text, rating, complaint_status, problem_category, label
      FROM reviews)"""


@register("set_unified_dataset", f"{UNIFIED} SELECT * FROM u")
def unified_dataset(spark, sf_dir):
    out = P.unified_dataset(three_feeds(spark, sf_dir), [F.desc_nulls_last("published_at")])
    return out.drop("title", "author")


@register(
    "set_unified_textual",
    f"{UNIFIED} SELECT source, count(*) AS n FROM u WHERE trim(raw_text) <> '' GROUP BY source",
)
def unified_textual(spark, sf_dir):
    out = P.unified_dataset(three_feeds(spark, sf_dir), [F.desc_nulls_last("published_at")])
    return P.textual_subset(out).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@register(
    "set_dedupe_id_source",
    """SELECT md5(text) AS record_id, source, min(doc_id) AS doc_id FROM documents
    GROUP BY text, source""",
)
def dedupe_id_source(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select(F.col("text").alias("record_id"), "source", "doc_id")
    kept = P.dedupe_id_source(docs, [F.col("doc_id")])
    return kept.withColumn("record_id", F.md5("record_id"))


@register(
    "set_dedupe_text",
    """SELECT min(doc_id) AS doc_id, md5(text) AS text_hash FROM documents GROUP BY text""",
)
def dedupe_text(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select(F.col("text").alias("raw_text"), "doc_id")
    return P.dedupe_raw_text(docs, [F.col("doc_id")]).select("doc_id", F.md5("raw_text").alias("text_hash"))


def _in_batches(spark, docs, keys, order, name):
    """Four batches by id, the third run twice, each against the index of the keys before it."""
    index = key_index(spark, scratch_path(spark, name), docs, keys, 16)
    size = docs.agg(F.max("doc_id")).first()[0] // 4 + 1
    out = []
    for i in (0, 1, 2, 2, 3):
        rows = docs.where(F.floor(F.col("doc_id") / size) == i)
        out.append(dedupe_batch(index, rows, order, f"batch-{i}"))
    return P.union_by_name([*out[:3], out[4]])


@register(
    "set_dedupe_id_source_batches",
    """SELECT md5(text) AS record_id, source, min(doc_id) AS doc_id FROM documents
    GROUP BY text, source""",
)
def dedupe_id_source_batches(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select(F.col("text").alias("record_id"), "source", "doc_id")
    kept = _in_batches(spark, docs, ["record_id", "source"], [F.col("doc_id")], "id-source-index")
    return kept.withColumn("record_id", F.md5("record_id"))


@register(
    "set_dedupe_text_batches",
    """SELECT min(doc_id) AS doc_id, md5(text) AS text_hash FROM documents GROUP BY text""",
)
def dedupe_text_batches(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select(F.col("text").alias("raw_text"), "doc_id")
    kept = _in_batches(spark, docs, ["raw_text"], [F.col("doc_id")], "text-index")
    return kept.select("doc_id", F.md5("raw_text").alias("text_hash"))


@register(
    "set_dedupe_videos",
    f"WITH {VIDEOS} SELECT video_id, video_title, query, item_rank FROM videos WHERE rn = 1",
)
def dedupe_videos(spark, sf_dir):
    return P.dedupe_videos(videos(spark, sf_dir)).select("video_id", "video_title", "query", "item_rank")


def repeated_comments(spark, sf_dir):
    """Line items as comments: the part is the comment, its flag the content."""
    return read_table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("comment_id"),
        F.col("l_returnflag").alias("content"),
        F.col("l_shipdate").cast("timestamp").alias("review_date"),
        F.col("l_orderkey").alias("video_id"),
    )


@register(
    "set_dedupe_comments",
    """SELECT comment_id, content, review_date, video_id FROM (
      SELECT l_partkey AS comment_id, l_returnflag AS content, l_shipdate AS review_date,
        l_orderkey AS video_id, row_number() OVER (PARTITION BY l_partkey, l_returnflag
          ORDER BY l_shipdate, l_orderkey) AS rn FROM lineitem) WHERE rn = 1""",
)
def dedupe_comments(spark, sf_dir):
    return P.dedupe_comments(repeated_comments(spark, sf_dir))


@register(
    "set_union_all_sql",
    """SELECT kind, name, count(*) AS n FROM (SELECT n_name AS name, 'nation' AS kind FROM nation
      UNION ALL SELECT c_mktsegment, 'customer' FROM customer
      UNION ALL SELECT o_orderpriority, 'order' FROM orders) GROUP BY ALL""",
)
def union_all_sql(spark, sf_dir):
    for name in ("nation", "customer", "orders"):
        read_table(spark, sf_dir, name).createOrReplaceTempView(f"ua_{name}")
    return spark.sql(
        """SELECT kind, name, count(*) AS n FROM (
             SELECT n_name AS name, 'nation' AS kind FROM ua_nation
             UNION ALL SELECT c_mktsegment, 'customer' FROM ua_customer
             UNION ALL SELECT o_orderpriority, 'order' FROM ua_orders) GROUP BY kind, name"""
    )
