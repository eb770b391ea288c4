"""Window-shaped computations, sorts, limits and caps."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedback_engine.catalog import register
from feedback_engine.catalog import sqltext as Q
from feedback_engine.catalog.preparing import comments, videos
from feedback_engine.functions import rules
from feedback_engine.operators import metrics as M
from feedback_engine.operators import prepare as P
from feedback_engine.operators import ranking as RK
from feedback_engine.operators import reports as RP
from feedback_engine.operators import topics
from feedback_engine.operators.views import counts
from feedback_engine.plans.adapters import read_table, reviews_view, themed_reviews, vec_view

R = f"WITH {Q.reviews()}"
T = f"WITH {Q.themed()}"


@register(
    "win_share_of_partition",
    f"""SELECT source, lang, n, {Q.r6("n / sum(n) OVER (PARTITION BY source)")} AS share FROM (
      SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL)""",
)
def share_of_partition(spark, sf_dir):
    grouped = counts(read_table(spark, sf_dir, "documents"), "source", "lang")
    return grouped.withColumn("share", RP.share_of(F.col("n"), ["source"]))


@register(
    "win_share_of_total",
    f"""SELECT event_type, n, {Q.r6("n / sum(n) OVER ()")} AS share FROM (
      SELECT event_type, count(*) AS n FROM events GROUP BY ALL)""",
)
def share_of_total(spark, sf_dir):
    grouped = counts(read_table(spark, sf_dir, "events"), "event_type")
    return grouped.withColumn("share", RP.share_of(F.col("n")))


@register(
    "win_keep_first",
    """SELECT l_partkey, l_orderkey, l_linenumber FROM lineitem QUALIFY row_number() OVER (
      PARTITION BY l_partkey ORDER BY l_shipdate DESC, l_orderkey, l_linenumber) = 1""",
)
def keep_first(spark, sf_dir):
    rows = read_table(spark, sf_dir, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", "l_shipdate")
    order = [F.desc("l_shipdate"), F.col("l_orderkey"), F.col("l_linenumber")]
    return RK.keep_first(rows, ["l_partkey"], order).drop("l_shipdate")


@register(
    "win_head_per_group",
    """SELECT l_returnflag, l_orderkey, l_linenumber FROM lineitem QUALIFY row_number() OVER (
      PARTITION BY l_returnflag ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) <= 5""",
)
def head_per_group(spark, sf_dir):
    order = [F.desc("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber")]
    rows = read_table(spark, sf_dir, "lineitem")
    return RK.head_per_group(rows, ["l_returnflag"], order, 5).select(
        "l_returnflag", "l_orderkey", "l_linenumber"
    )


@register(
    "win_head_per_group_large",
    """SELECT l_returnflag, l_orderkey, l_linenumber FROM lineitem QUALIFY row_number() OVER (
      PARTITION BY l_returnflag ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) <= 3000""",
)
def head_per_group_large(spark, sf_dir):
    order = [("l_extendedprice", True), ("l_orderkey", False), ("l_linenumber", False)]
    rows = read_table(spark, sf_dir, "lineitem").select("l_returnflag", *[c for c, _ in order])
    return RK.head_per_group_large(rows, ["l_returnflag"], order, 3000).select(
        "l_returnflag", "l_orderkey", "l_linenumber"
    )


@register(
    "win_mode_per_group",
    """WITH c AS (SELECT l_suppkey, l_shipdate AS d, count(*) AS n FROM lineitem GROUP BY ALL)
    SELECT l_suppkey, d AS top_date FROM c
    QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY n DESC, d) = 1""",
)
def mode_per_group(spark, sf_dir):
    rows = read_table(spark, sf_dir, "lineitem")
    return RK.most_frequent(rows, ["l_suppkey"], F.col("l_shipdate"), "top_date")


@register(
    "win_first_nonempty",
    f"""{R} SELECT problem_category, source,
    arg_min(raw_text, record_id) FILTER (trim(raw_text) <> '') AS example FROM reviews GROUP BY ALL""",
)
def first_nonempty(spark, sf_dir):
    filled = F.trim("raw_text") != ""
    return reviews_view(spark, sf_dir).groupBy("problem_category", "source").agg(
        F.min_by("raw_text", F.when(filled, F.col("record_id"))).alias("example")
    )


@register(
    "win_first_last_period",
    f"""WITH m AS (SELECT {Q.month("ts")} AS month, count(*) AS n FROM events GROUP BY 1)
    SELECT min(month) AS first_month, max(month) AS last_month, arg_min(n, month) AS n_first,
      arg_max(n, month) AS n_last FROM m""",
)
def first_last_period(spark, sf_dir):
    events = read_table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("published_at"))
    months = RP.monthly_volume(events)
    return months.agg(
        F.min("month").alias("first_month"),
        F.max("month").alias("last_month"),
        F.min_by("n", "month").alias("n_first"),
        F.max_by("n", "month").alias("n_last"),
    )


@register(
    "win_dense_id_after_sort",
    f"""{T}, g AS (SELECT theme, count(*) AS n_records FROM themed GROUP BY theme)
    SELECT theme, n_records, row_number() OVER (ORDER BY n_records DESC, theme) AS topic_id FROM g""",
)
def dense_id_after_sort(spark, sf_dir):
    grouped = counts(themed_reviews(spark, sf_dir), "theme").withColumnRenamed("n", "n_records")
    return grouped.withColumn(
        "topic_id", F.row_number().over(RK.whole().orderBy(F.desc("n_records"), "theme"))
    )


@register(
    "win_representative",
    """WITH e AS (SELECT vec_id, label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
      m AS (SELECT label, i, avg(CAST(x AS DOUBLE)) AS mx FROM e GROUP BY ALL),
      s AS (SELECT e.label, vec_id, round(sum(CAST(x AS DOUBLE) * mx), 9) AS sim FROM e JOIN m ON m.label = e.label AND m.i = e.i GROUP BY ALL)
    SELECT label AS cluster_id, 'v' || vec_id AS record_id, round(sim, 6) AS similarity FROM s
    QUALIFY row_number() OVER (PARTITION BY label ORDER BY sim DESC, 'v' || vec_id) = 1""",
)
def representative(spark, sf_dir):
    rows = vec_view(spark, sf_dir).withColumnRenamed("label", "cluster_id")
    return topics.representative_example(rows, vector="embedding", text="record_id").select(
        "cluster_id", "record_id", "similarity"
    )


# ---- sorts and limits ----------------------------------------------------------------------


@register(
    "srt_latest_first",
    f"{R} SELECT record_id, published_at FROM reviews ORDER BY published_at DESC NULLS LAST, record_id",
)
def latest_first(spark, sf_dir):
    return P.latest_first(reviews_view(spark, sf_dir)).select("record_id", "published_at")


@register(
    "srt_topic_summary",
    f"""{R}, g AS (SELECT cluster_id, count(*) AS n_records,
        avg(CASE WHEN predicted_label = 'Positivo' THEN 1 ELSE 0 END) AS share_pos,
        avg(CASE WHEN predicted_label = 'Negativo' THEN 1 ELSE 0 END) AS share_neg,
        avg(CASE WHEN predicted_label = 'Neutro' THEN 1 ELSE 0 END) AS share_neu FROM reviews GROUP BY 1)
    SELECT row_number() OVER (ORDER BY n_records DESC, cluster_id) AS topic_id, cluster_id, n_records,
      'Misto' AS cluster_signal, CASE WHEN share_pos >= greatest(share_neg, share_neu) THEN 'Positivo'
        WHEN share_neg >= greatest(share_pos, share_neu) THEN 'Negativo' ELSE 'Neutro' END AS predominant_label,
      {Q.r6("share_pos")} AS share_pos FROM g""",
)
def sort_topic_summary(spark, sf_dir):
    shares = topics.cluster_shares(reviews_view(spark, sf_dir))
    pos, neg, neu = (F.col(c) for c in ("share_pos", "share_neg", "share_neu"))
    rows = shares.select(
        "cluster_id",
        F.col("n").alias("n_records"),
        F.lit("topic").alias("topic_name"),
        rules.cluster_signal(pos, neg).alias("cluster_signal"),
        rules.predominant_label(pos, neg, neu).alias("predominant_label"),
        "share_pos",
    )
    return topics.topic_summary(rows, "given").select(
        "topic_id", "cluster_id", "n_records", "cluster_signal", "predominant_label", "share_pos"
    )


def metric_table(spark, sf_dir):
    """A model row per supplier: mean discount, tax and flags play the metrics; some are missing."""
    key = F.col("l_suppkey")
    return read_table(spark, sf_dir, "lineitem").groupBy(key.alias("supplier")).agg(
        F.format_string("m%05d", F.first(key)).alias("model"),
        F.avg((F.col("l_returnflag") == "A").cast("double")).alias("accuracy"),
        F.avg((F.col("l_returnflag") == "N").cast("double")).alias("f1_macro"),
        F.when(F.first(key) % 7 != 0, F.round(F.avg((F.col("l_linestatus") == "O").cast("double")), 1)).alias("roc_auc_macro"),
        F.avg((F.col("l_linestatus") == "F").cast("double")).alias("recall_macro"),
        F.when(F.first(key) % 5 != 0, F.avg((F.col("l_linenumber") == 7).cast("double"))).alias("f1_neu"),
        F.when(F.first(key) % 3 == 0, "benchmark").when(F.first(key) % 3 == 1, "bert_runtime").alias("provenance"),
    ).drop("supplier")


METRICS = """metric_rows AS (SELECT printf('m%05d', l_suppkey) AS model,
      avg(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END) AS accuracy,
      avg(CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END) AS f1_macro,
      CASE WHEN l_suppkey % 7 <> 0 THEN round(avg(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END), 1) END AS roc_auc_macro,
      avg(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END) AS recall_macro,
      CASE WHEN l_suppkey % 5 <> 0 THEN avg(CASE WHEN l_linenumber = 7 THEN 1 ELSE 0 END) END AS f1_neu,
      CASE l_suppkey % 3 WHEN 0 THEN 'benchmark' WHEN 1 THEN 'bert_runtime' END AS provenance
    FROM lineitem GROUP BY l_suppkey)"""
RANK_ORDER = """CASE WHEN f1_neu >= 0.05 THEN 1 ELSE 0 END DESC, roc_auc_macro DESC NULLS LAST,
      f1_macro DESC NULLS LAST, recall_macro DESC NULLS LAST, f1_neu DESC NULLS LAST, accuracy DESC NULLS LAST, model"""


@register(
    "srt_model_rank",
    f"WITH {METRICS} SELECT model, row_number() OVER (ORDER BY {RANK_ORDER}) AS model_rank FROM metric_rows",
)
def model_rank(spark, sf_dir):
    return M.rank_models(metric_table(spark, sf_dir)).select("model", "model_rank")


@register(
    "lim_top_k",
    """SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, 1 LIMIT 25""",
)
def top_k(spark, sf_dir):
    rows = read_table(spark, sf_dir, "lineitem")
    return counts(rows, "l_partkey").orderBy(F.desc("n"), "l_partkey").limit(25)


@register(
    "lim_per_query",
    """SELECT 'v' || (c_custkey % 500) AS video_id, c_mktsegment AS query, c_custkey AS item_rank FROM customer
    QUALIFY row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) <= 50""",
)
def per_query(spark, sf_dir):
    capped = P.cap_per_group(videos(spark, sf_dir), ["query"], [F.col("item_rank")], 50)
    return capped.select("video_id", "query", "item_rank")


@register(
    "lim_per_video",
    """SELECT 'c' || o_orderkey AS comment_id, 'v' || (o_custkey % 500) AS video_id FROM orders
    QUALIFY row_number() OVER (PARTITION BY o_custkey % 500 ORDER BY o_orderdate DESC, 'c' || o_orderkey) <= 300""",
)
def per_video(spark, sf_dir):
    order = [F.desc("review_date"), F.col("comment_id")]
    capped = P.cap_per_group(comments(spark, sf_dir), ["video_id"], order, 300)
    return capped.select("comment_id", "video_id")


@register(
    "lim_global",
    f"{R} SELECT record_id FROM reviews ORDER BY published_at DESC NULLS LAST, record_id LIMIT 7500",
)
def global_cap(spark, sf_dir):
    return P.newest(reviews_view(spark, sf_dir), 7500).select("record_id")


@register(
    "win_running_total",
    """SELECT l_returnflag, l_extendedprice, n, sum(n) OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice)::BIGINT AS cum_n
    FROM (SELECT l_returnflag, l_extendedprice, count(*) AS n FROM lineitem GROUP BY ALL)""",
)
def running_total(spark, sf_dir):
    """Prefix sums over a long order, cut into value buckets."""
    grouped = counts(read_table(spark, sf_dir, "lineitem"), "l_returnflag", "l_extendedprice")
    return RK.running_totals(
        RK.with_value_bucket(grouped, "l_extendedprice"),
        ["l_returnflag"],
        F.col("_vb"),
        [F.col("l_extendedprice")],
        {"n": F.col("n")},
    ).drop("_vb", "all_n")
