"""Report and exploratory tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedback_engine import schemas as S
from feedback_engine.catalog import register
from feedback_engine.catalog import sqltext as Q
from feedback_engine.functions.text import clean_text, clean_tokens
from feedback_engine.operators import eda, insights, trends
from feedback_engine.operators import reports as RP
from feedback_engine.operators import themes as TH
from feedback_engine.plans.adapters import (
    clustered_reviews,
    docs_view,
    read_table,
    reviews_view,
    text_docs,
    themed_reviews,
)

R = f"WITH {Q.reviews()}"
T = f"WITH {Q.themed()}"
_CLASSES = "(SELECT unnest(['Positivo', 'Negativo', 'Neutro']) AS sentiment)"


@register(
    "rpt_source_volume",
    f"""WITH {Q.docs(label=False)}, g AS (SELECT source, count(*) AS n FROM docs GROUP BY source)
    SELECT {Q.display("source")} AS source, n, {Q.r6("n / sum(n) OVER ()")} AS share FROM g""",
)
def source_volume(spark, sf_dir):
    return RP.source_volume(docs_view(spark, sf_dir, label=False))


@register(
    "rpt_monthly_volume",
    f"""{R} SELECT {Q.month("published_at")} AS month, count(*) AS n FROM reviews
    WHERE published_at IS NOT NULL GROUP BY 1""",
)
def monthly_volume(spark, sf_dir):
    return RP.monthly_volume(reviews_view(spark, sf_dir))


@register(
    "rpt_sentiment_summary",
    f"""{R}, g AS (SELECT sentiment, count(record_id) AS n FROM {_CLASSES}
      LEFT JOIN reviews ON predicted_label = sentiment GROUP BY sentiment)
    SELECT sentiment, n, {Q.pct("n / sum(n) OVER ()")} AS share FROM g""",
)
def sentiment_summary(spark, sf_dir):
    return RP.sentiment_summary(reviews_view(spark, sf_dir))


@register(
    "rpt_monthly_sentiment",
    f"""{R} SELECT {Q.month("published_at")} AS month, predicted_label AS sentiment, count(*) AS n FROM reviews
    WHERE published_at IS NOT NULL AND predicted_label IS NOT NULL GROUP BY ALL""",
)
def monthly_sentiment(spark, sf_dir):
    return RP.monthly_sentiment(reviews_view(spark, sf_dir))


@register(
    "rpt_top_n",
    f"""{R} SELECT coalesce(nullif(trim(raw_text), ''), 'Sem informacao') AS raw_text, count(*) AS n
    FROM reviews GROUP BY 1 ORDER BY n DESC, 1 LIMIT 10""",
)
def top_n(spark, sf_dir):
    return RP.top_n_counts(reviews_view(spark, sf_dir), "raw_text")


@register(
    "rpt_frequent_words",
    rf"""WITH {Q.docs()}, w AS (SELECT label AS sentiment, unnest(string_split({Q.clean("raw_text")}, ' ')) AS word
      FROM docs WHERE label IS NOT NULL), g AS (SELECT sentiment, word, count(*) AS n FROM w
      WHERE length(word) >= 3 AND NOT regexp_full_match(word, '\d+') GROUP BY ALL)
    SELECT sentiment, word, n FROM g
    QUALIFY row_number() OVER (PARTITION BY sentiment ORDER BY n DESC, word) <= 10""",
)
def frequent_words(spark, sf_dir):
    df = text_docs(spark, sf_dir).withColumn("clean_text", clean_text(F.col("raw_text")))
    return RP.frequent_words(df, sentiment="label")


@register(
    "rpt_comment_examples",
    f"""{T} SELECT predicted_label AS sentiment, record_id, strftime(published_at, '%d/%m/%Y') AS published_at,
    'Nao informado' AS author, theme AS title, coalesce(raw_text, '') AS comment
    FROM themed WHERE predicted_label IS NOT NULL QUALIFY row_number() OVER (
      PARTITION BY predicted_label ORDER BY published_at DESC NULLS LAST, record_id) <= 3""",
)
def comment_examples(spark, sf_dir):
    return RP.comment_examples(themed_reviews(spark, sf_dir), preview=None)


@register(
    "rpt_primary_snapshot",
    f"""{R}, c AS (SELECT coalesce(nullif(trim(problem_category), ''), 'Sem informacao') AS key, count(*) AS n
        FROM reviews WHERE predicted_label = 'Negativo' GROUP BY 1),
      k AS (SELECT sentiment AS key, count(record_id) AS n FROM {_CLASSES}
        LEFT JOIN reviews ON predicted_label = sentiment GROUP BY 1),
      s AS (SELECT {Q.display("source")} AS key, count(*) AS n FROM reviews GROUP BY source)
    SELECT 'total' AS section, 'records' AS key, count(*) AS n, 1.0 AS share FROM reviews
    UNION ALL SELECT 'sentiment', key, n, {Q.r6("n / sum(n) OVER ()")} FROM k
    UNION ALL (SELECT 'negative_category', key, n, NULL FROM c ORDER BY n DESC, key LIMIT 8)
    UNION ALL (SELECT 'source_mix', key, n, NULL FROM s ORDER BY n DESC, key LIMIT 5)""",
)
def primary_snapshot(spark, sf_dir):
    return RP.primary_snapshot(reviews_view(spark, sf_dir))


def _theme_sql(value: str, top: int, accent_sensitive: bool = False, excluded: str = "") -> str:
    bad = f"('Outros temas', 'Sem texto', 'Sem informacao'{excluded})"
    return f"""{T}, g AS (SELECT coalesce(nullif(trim(theme), ''), 'Sem informacao') AS theme, count(*) AS n,
        mode(source ORDER BY source) AS src, arg_min(raw_text, record_id) FILTER (raw_text IS NOT NULL) AS example
      FROM themed WHERE predicted_label = '{value}' GROUP BY 1),
      t AS (SELECT * FROM g WHERE theme NOT IN {bad} ORDER BY n DESC, theme LIMIT {top})
    SELECT theme, n, {Q.r6("n / sum(n) OVER ()")} AS share, {Q.display("src")} AS dominant_source,
      '{value}' AS dominant_sentiment, '{value}' AS cluster_signal,
      {Q.theme_action("theme", accent_sensitive)} AS action, coalesce(example, '') AS example, '' AS keywords FROM t"""


@register("rpt_theme_priority", _theme_sql("Negativo", 8))
def theme_priority(spark, sf_dir):
    return TH.theme_priority(themed_reviews(spark, sf_dir))


@register(
    "rpt_theme_priority_positive",
    _theme_sql("Positivo", 3, accent_sensitive=True, excluded=", 'Cartão e fatura'"),
)
def theme_priority_positive(spark, sf_dir):
    return TH.theme_priority(
        themed_reviews(spark, sf_dir), 3, value="Positivo", excluded=["Cartão e fatura"], accent_sensitive=True
    )


@register(
    "rpt_theme_priority_uninformative",
    f"""{R}, g AS (SELECT CASE WHEN raw_text IS NULL THEN 'Sem texto' ELSE 'Outros temas' END AS theme, count(*) AS n,
        mode(source ORDER BY source) AS src, arg_min(raw_text, record_id) FILTER (raw_text IS NOT NULL) AS example
      FROM reviews WHERE predicted_label = 'Negativo' GROUP BY 1)
    SELECT theme, n, {Q.r6("n / sum(n) OVER ()")} AS share, {Q.display("src")} AS dominant_source,
      'Negativo' AS dominant_sentiment, 'Negativo' AS cluster_signal, {Q.theme_action("theme")} AS action,
      coalesce(example, '') AS example, '' AS keywords FROM g""",
)
def theme_priority_uninformative(spark, sf_dir):
    """Only uninformative themes: they stay."""
    theme = F.when(F.col("raw_text").isNull(), S.NO_TEXT).otherwise(S.OTHER_THEMES)
    return TH.theme_priority(reviews_view(spark, sf_dir).withColumn("theme", theme))


@register(
    "rpt_theme_priority_clusters",
    f"""WITH {Q.clustered()}, g AS (SELECT coalesce(cluster_label, 'Sem informacao') AS theme, count(*) AS n,
        mode(source ORDER BY source) AS src,
        mode(coalesce(predicted_label, 'Sem informacao') ORDER BY coalesce(predicted_label, 'Sem informacao')) AS dominant_sentiment,
        mode(coalesce(cluster_signal, 'Misto') ORDER BY coalesce(cluster_signal, 'Misto')) AS cluster_signal,
        arg_min(cluster_example, record_id) FILTER (cluster_example <> '') AS example,
        arg_min(cluster_action, record_id) FILTER (cluster_action IS NOT NULL) AS action,
        arg_min(cluster_keywords, record_id) FILTER (cluster_keywords IS NOT NULL) AS keywords
      FROM clustered WHERE coalesce(cluster_signal, 'Misto') = 'Negativo' GROUP BY 1),
      t AS (SELECT * FROM g WHERE theme NOT IN ('Outros temas', 'Sem texto', 'Sem informacao')
        ORDER BY n DESC, theme LIMIT 8)
    SELECT theme, n, {Q.r6("n / sum(n) OVER ()")} AS share, {Q.display("src")} AS dominant_source,
      dominant_sentiment, cluster_signal, coalesce(action, '') AS action, coalesce(example, '') AS example,
      coalesce(keywords, '') AS keywords FROM t""",
)
def theme_priority_clusters(spark, sf_dir):
    return TH.theme_priority_clusters(clustered_reviews(spark, sf_dir))


BY_SOURCE = f"""{R}, g AS (SELECT source AS s, predicted_label AS sentiment, count(*) AS n FROM reviews
      WHERE predicted_label IS NOT NULL GROUP BY ALL), h AS (SELECT s, {Q.display("s")} AS source, sentiment, n,
      n / sum(n) OVER (PARTITION BY s) AS x FROM g)"""


@register(
    "rpt_sentiment_by_source",
    f"{BY_SOURCE} SELECT source, sentiment, n, {Q.r6('x')} AS source_share FROM h",
)
def sentiment_by_source(spark, sf_dir):
    return RP.sentiment_by_source(reviews_view(spark, sf_dir))


@register(
    "rpt_sentiment_source_pivot",
    f"""{BY_SOURCE} SELECT source, {Q.big("sum(n)")} AS n, {", ".join(
        Q.r6(f"coalesce(sum(x) FILTER (sentiment = '{label}'), 0)") + f" AS {name}"
        for label, name in (("Positivo", "share_pos"), ("Negativo", "share_neg"), ("Neutro", "share_neu")))}
    FROM h GROUP BY source""",
)
def sentiment_source_pivot(spark, sf_dir):
    return RP.sentiment_source_pivot(reviews_view(spark, sf_dir))


@register(
    "rpt_uncertainty_by_source",
    f"""{R} SELECT {Q.display("source")} AS source,
    {Q.r6("avg(CASE WHEN is_uncertain THEN 1 ELSE 0 END)")} AS uncertain_share FROM reviews GROUP BY reviews.source""",
)
def uncertainty_by_source(spark, sf_dir):
    return RP.uncertainty_by_source(reviews_view(spark, sf_dir))


def _mix(where: str = "TRUE") -> str:
    count = lambda label: f"count(*) FILTER (predicted_label = '{label}')"
    return f"""SELECT {Q.month("published_at")} AS month, {count("Positivo")} AS n_pos, {count("Negativo")} AS n_neg,
      {count("Neutro")} AS n_neu, count(*) AS total, {count("Negativo")} / count(*) AS neg_share,
      {count("Positivo")} / count(*) AS pos_share, row_number() OVER (ORDER BY {Q.month("published_at")}) AS up,
      row_number() OVER (ORDER BY {Q.month("published_at")} DESC) AS down
    FROM reviews WHERE published_at IS NOT NULL AND predicted_label IS NOT NULL AND {where} GROUP BY 1"""


@register(
    "rpt_trend_mix",
    f"""{R}, m AS ({_mix()}) SELECT month, n_pos, n_neg, n_neu, total, {Q.r6("neg_share")} AS neg_share,
    {Q.r6("pos_share")} AS pos_share FROM m""",
)
def trend_mix(spark, sf_dir):
    return trends.trend_mix(reviews_view(spark, sf_dir))


_END = "max({0}) FILTER (down = 1) - max({0}) FILTER (up = 1)"
DELTAS = f"""{R}, m AS ({_mix()}), c AS ({_mix("source = 'google_play'")}), d AS (
    SELECT count(*) AS n_months, {_END.format("neg_share")} AS neg_delta, {_END.format("pos_share")} AS pos_delta,
      avg(neg_share) FILTER (down <= 3) - avg(neg_share) FILTER (up <= 3) AS neg_window_delta,
      (SELECT {_END.format("neg_share")} FROM c) AS channel_neg_delta FROM m)"""


@register(
    "rpt_trend_deltas",
    f"""{DELTAS} SELECT n_months, {", ".join(f"{Q.r6(c)} AS {c}" for c in
        ("neg_delta", "pos_delta", "neg_window_delta", "channel_neg_delta"))} FROM d""",
)
def trend_deltas(spark, sf_dir):
    return trends.trend_deltas(reviews_view(spark, sf_dir))


@register(
    "rpt_trend_insights",
    f"""{DELTAS}, t AS (SELECT 1 AS i, 'negative_share' AS fact, 'Negative share, first to last month: ' ||
        CASE WHEN neg_delta > 0 THEN 'up ' || {Q.pct("abs(neg_delta)")} WHEN neg_delta < 0 THEN 'down ' ||
        {Q.pct("abs(neg_delta)")} ELSE 'unchanged' END AS text FROM d
      UNION ALL SELECT 2, 'positive_share', 'Positive share, first to last month: ' ||
        CASE WHEN pos_delta > 0 THEN 'up ' WHEN pos_delta < 0 THEN 'down ' END || {Q.pct("abs(pos_delta)")} FROM d
      UNION ALL SELECT 3, 'three_month_mean', 'Three-month mean of the negative share: ' ||
        CASE WHEN neg_window_delta > 0 THEN 'worse by ' WHEN neg_window_delta < 0 THEN 'better by ' END ||
        {Q.pct("abs(neg_window_delta)")} FROM d
      UNION ALL SELECT 4, 'channel', 'Negative share of the channel, first to last month: moved ' ||
        {Q.pct("abs(channel_neg_delta)")} FROM d)
    SELECT row_number() OVER (ORDER BY i) AS rank, fact, text FROM t WHERE text IS NOT NULL""",
)
def trend_insights(spark, sf_dir):
    return trends.trend_insights(reviews_view(spark, sf_dir))


@register(
    "rpt_trend_totals",
    f"""{R}, m AS ({_mix()}) SELECT {", ".join(Q.big(f"sum({c})") + f" AS {c}" for c in
        ("total", "n_pos", "n_neg", "n_neu"))}, {Q.r6(_END.format("neg_share"))} AS neg_delta FROM m""",
)
def trend_totals(spark, sf_dir):
    return trends.trend_totals(reviews_view(spark, sf_dir))


# ---- narrative facts -----------------------------------------------------------------------


def _share_facts(rows: str, over_all: bool = False) -> str:
    """SELECT of total, class shares and uncertain share over ``rows``."""
    known = "count(*)" if over_all else "nullif(count(predicted_label), 0)"
    shares = ", ".join(
        f"count(*) FILTER (predicted_label = '{label}') / {known} AS {name}"
        for label, name in (("Positivo", "pos_share"), ("Negativo", "neg_share"), ("Neutro", "neu_share"))
    )
    return f"""SELECT count(*) AS total, {shares},
      count(*) FILTER (is_uncertain) / count(*) AS uncertain_share FROM {rows}"""


def _ranked_themes(rows: str) -> str:
    return f"""SELECT theme, count(*) AS n, mode(source ORDER BY source) AS src,
      row_number() OVER (ORDER BY count(*) DESC, theme) AS r FROM {rows} WHERE predicted_label = 'Negativo'
      AND theme NOT IN ('Outros temas', 'Sem texto', 'Sem informacao') GROUP BY theme"""


@register(
    "rpt_channel_insights",
    f"""{T}, ch AS (SELECT * FROM themed WHERE source = 'google_play'), f AS ({_share_facts("ch")}),
      th AS ({_ranked_themes("ch")})
    SELECT 'google_play' AS channel, total AS n, {Q.r6("total / (SELECT count(*) FROM themed)")} AS base_share,
      {", ".join(f"{Q.r6(c)} AS {c}" for c in ("pos_share", "neg_share", "neu_share", "uncertain_share"))},
      theme AS top_theme, {Q.theme_action("theme")} AS top_action FROM f, th WHERE r = 1""",
)
def channel_insights(spark, sf_dir):
    df = themed_reviews(spark, sf_dir)
    return insights.channel_insights(df, df)


@register(
    "rpt_channel_statements",
    f"""{T}, ch AS (SELECT * FROM themed WHERE source = 'google_play'), f AS ({_share_facts("ch")}),
      th AS ({_ranked_themes("ch")}), x AS (SELECT *, total / (SELECT count(*) FROM themed) AS base_share FROM f, th WHERE r = 1)
    SELECT 1 AS rank, 'channel' AS audience, 'base_share' AS fact,
      'Google Play holds ' || {Q.pct("base_share")} || ' of the base.' AS text FROM x
    UNION ALL SELECT 2, 'channel', 'sentiment', 'Google Play: ' || {Q.pct("pos_share")} || ' positive, ' || {Q.pct("neg_share")} || ' negative.' FROM x
    UNION ALL SELECT 3, 'channel', 'top_theme', 'Most sensitive theme: ' || theme || '. Action: ' || {Q.theme_action("theme")} FROM x
    UNION ALL SELECT 4, 'channel', 'uncertain', {Q.pct("uncertain_share")} || ' of the predictions have low confidence.' FROM x""",
)
def channel_statements(spark, sf_dir):
    df = themed_reviews(spark, sf_dir)
    return insights.channel_statements(insights.channel_insights(df, df))


_FACTS = f"""{T}, f AS ({_share_facts("themed")}), th AS ({_ranked_themes("themed")}),
      t1 AS (SELECT theme AS theme1, n AS n1, {Q.display("src")} AS src1, {Q.theme_action("theme")} AS act1 FROM th WHERE r = 1),
      t2 AS (SELECT theme AS theme2, {Q.display("src")} AS src2 FROM th WHERE r = 2),
      base AS (SELECT {Q.display("source")} AS base_source FROM themed GROUP BY source ORDER BY count(*) DESC, themed.source LIMIT 1),
      neg AS (SELECT {Q.display("source")} AS neg_source FROM themed WHERE predicted_label = 'Negativo'
        GROUP BY source ORDER BY count(*) DESC, themed.source LIMIT 1),
      cat AS (SELECT theme AS category, count(*) AS category_n FROM themed WHERE predicted_label = 'Negativo'
        GROUP BY theme ORDER BY count(*) DESC, theme LIMIT 1),
      x AS (SELECT * FROM f, t1, t2, base, neg, cat)"""


def _statements(rows: list[tuple[str, str, str, str]], facts: str = _FACTS) -> str:
    """rows: (audience, fact, condition, text expression) in rule order."""
    parts = " UNION ALL ".join(
        f"SELECT {i} AS i, '{a}' AS audience, '{fact}' AS fact, {text} AS text FROM x WHERE {cond}"
        for i, (a, fact, cond, text) in enumerate(rows)
    )
    return f"""{facts}, s AS ({parts}) SELECT row_number() OVER (PARTITION BY audience ORDER BY i) AS rank,
      audience, fact, text FROM s"""


def models_frame(spark, sf_dir):
    """A primary model row whose neutral F1 comes from the data (mean discount, below 0.4)."""
    return read_table(spark, sf_dir, "lineitem").agg(F.avg("l_discount").alias("f1_neu")).withColumn(
        "is_primary", F.lit(True)
    )


@register(
    "rpt_business_insights",
    _statements(
        [
            ("business", "overall", "TRUE", f"{Q.pct('pos_share')} || ' positive and ' || {Q.pct('neg_share')} || ' negative records.'"),
            ("business", "neutral", "neu_share > 0", f"{Q.pct('neu_share')} || ' of the records are neutral.'"),
            ("business", "category", "TRUE", "'Largest friction: ' || category || ', ' || category_n || ' negative records.'"),
            ("business", "theme", "TRUE", "'Most sensitive theme: ' || theme1 || ', ' || n1 || ' negative records, mostly on ' || src1 || '.'"),
            ("business", "negative_source", "TRUE", "'Most negative records come from ' || neg_source || '.'"),
            ("business", "neutral_f1", "TRUE", f"'Neutral class is weak: F1 ' || {Q.pct('(SELECT avg(l_discount) FROM lineitem)')} || '.'"),
            ("business", "base_source", "TRUE", "'The base is dominated by ' || base_source || '.'"),
            ("business", "uncertain", "uncertain_share > 0", f"{Q.pct('uncertain_share')} || ' of the predictions have low confidence.'"),
        ]
    ),
)
def business_insights(spark, sf_dir):
    """All eight statements; callers keep the first five."""
    df = themed_reviews(spark, sf_dir)
    return insights.business_insights(df, df, models_frame(spark, sf_dir), cap=8)


@register(
    "rpt_audience_insights",
    _statements(
        [
            ("investor", "overall", "TRUE", f"{Q.pct('pos_share')} || ' positive; ' || {Q.pct('neg_share')} || ' is a reputation risk.'"),
            ("user", "theme", "TRUE", "'Most frequent negative theme: ' || theme1 || ', mostly on ' || src1 || '.'"),
            ("internal", "priority", "TRUE", "'First priority: ' || act1 || ' ' || n1 || ' negative records.'"),
            ("internal", "second", "TRUE", "'After ' || theme1 || ' comes ' || theme2 || ', mostly on ' || src2 || '.'"),
            ("investor", "uncertain", "uncertain_share > 0", f"{Q.pct('uncertain_share')} || ' of the predictions are only indicative.'"),
            ("internal", "uncertain", "uncertain_share > 0", f"{Q.pct('uncertain_share')} || ' of the rows need manual sampling.'"),
            ("investor", "base_source", "TRUE", "'The result mostly reflects ' || base_source || '.'"),
            ("user", "base_source", "TRUE", "'Most conversation happens on ' || base_source || '.'"),
            ("user", "account", "contains(lower(theme1), 'conta') OR contains(lower(theme1), 'acesso')", "'Access and account problems hit daily use at once.'"),
        ]
    ),
)
def audience_insights(spark, sf_dir):
    df = themed_reviews(spark, sf_dir)
    return insights.audience_insights(df, df)


@register(
    "rpt_storyline",
    _statements(
        [
            ("headline", "headline", "TRUE", "'Friction concentrates on theme ' || theme1 || ' and channel ' || neg_source || '.'"),
            ("risk", "overall", "TRUE", f"{Q.pct('pos_share')} || ' positive predictions, ' || {Q.pct('neg_share')} || ' at risk.'"),
            ("risk", "pressure", "TRUE", "'Main pressure on ' || neg_source || ', theme ' || theme1 || '.'"),
            ("risk", "neutral", "neu_share > 0", f"{Q.pct('neu_share')} || ' of the content is neutral.'"),
            ("risk", "uncertain", "uncertain_share > 0", f"{Q.pct('uncertain_share')} || ' of the predictions have low confidence.'"),
        ],
        _FACTS.replace(_share_facts("themed"), _share_facts("themed", over_all=True)),
    ),
)
def storyline(spark, sf_dir):
    return insights.storyline(themed_reviews(spark, sf_dir))


# ---- KPIs ----------------------------------------------------------------------------------


@register(
    "rpt_overview_kpis",
    f"""{R} SELECT count(*) AS total_records, count(*) FILTER (trim(raw_text) <> '') AS with_text,
    {", ".join(f"count(*) FILTER (source = '{s}') AS n_{s}" for s in S.ALL_SOURCES)},
    min(published_at) AS first_date, max(published_at) AS last_date FROM reviews""",
)
def overview_kpis(spark, sf_dir):
    return RP.overview_kpis(reviews_view(spark, sf_dir))


def _class_kpis(label: str) -> str:
    return f"""{T}, s AS (SELECT {Q.display("source")} AS top_source, themed.source AS raw,
        count(*) FILTER (predicted_label = '{label}') / count(*) AS share FROM themed
        WHERE predicted_label IS NOT NULL GROUP BY themed.source ORDER BY share DESC, raw LIMIT 1),
      t AS (SELECT theme FROM themed WHERE predicted_label = '{label}' AND theme <> 'Outros temas'
        GROUP BY theme ORDER BY count(*) DESC, theme LIMIT 1)
    SELECT '{label}' AS label, count(*) FILTER (predicted_label = '{label}') AS n,
      {Q.r6(f"count(*) FILTER (predicted_label = '{label}') / count(*)")} AS share,
      (SELECT theme FROM t) AS top_theme, (SELECT top_source FROM s) AS top_source FROM themed"""


@register("rpt_class_kpis", _class_kpis("Positivo"))
def class_kpis(spark, sf_dir):
    return RP.class_kpis(themed_reviews(spark, sf_dir), "Positivo")


@register("rpt_class_kpis_negative", _class_kpis("Negativo"))
def class_kpis_negative(spark, sf_dir):
    return RP.class_kpis(themed_reviews(spark, sf_dir), "Negativo")


@register(
    "rpt_complaint_kpis",
    f"""{R} SELECT {Q.r6("avg(rating)")} AS mean_rating,
    {Q.r6("avg(CASE WHEN complaint_status ILIKE '%resolvida%' OR complaint_status ILIKE '%finalizada%' THEN 1 ELSE 0 END)")} AS resolved_share,
    {Q.r6("avg(CASE WHEN rating <= 2 THEN 1 WHEN rating > 2 THEN 0 END)")} AS low_rating_share
    FROM reviews WHERE source = 'consumidor_gov'""",
)
def complaint_kpis(spark, sf_dir):
    return RP.complaint_kpis(reviews_view(spark, sf_dir).where(F.col("source") == S.COMPLAINT_SOURCE))


@register(
    "rpt_rating_histogram",
    """WITH q AS (SELECT l_quantity / 8 AS rating FROM lineitem)
    SELECT CASE WHEN rating < 1.5 THEN 1 WHEN rating < 2.5 THEN 2 WHEN rating < 3.5 THEN 3
      WHEN rating < 4.5 THEN 4 ELSE 5 END AS bin, count(*) AS n
    FROM q WHERE rating >= 0.5 AND rating <= 5.5 GROUP BY 1""",
)
def rating_histogram(spark, sf_dir):
    rows = read_table(spark, sf_dir, "lineitem").select((F.col("l_quantity") / 8).alias("rating"))
    return RP.rating_histogram(rows)


@register(
    "rpt_low_confidence_preview",
    f"""{R} SELECT record_id, strftime(published_at, '%d/%m/%Y') AS published_at, source, problem_category,
    raw_text, predicted_label, coalesce({Q.pct("confidence")}, '-') AS confidence FROM reviews
    ORDER BY reviews.predicted_label NULLS LAST, reviews.confidence NULLS LAST, record_id LIMIT 15""",
)
def low_confidence_preview(spark, sf_dir):
    return RP.low_confidence_preview(reviews_view(spark, sf_dir))


@register(
    "rpt_dataset_status",
    f"""{R} SELECT 'unified' AS dataset, count(*) AS n_filtered, count(*) AS n_shown FROM reviews
    UNION ALL SELECT 'videos', count(*), count(*) FILTER (predicted_label = 'Negativo') FROM reviews
    WHERE source = 'youtube'""",
)
def dataset_status(spark, sf_dir):
    df = reviews_view(spark, sf_dir)
    videos = df.where(F.col("source") == S.VIDEO_SOURCE)
    shown = videos.where(F.col("predicted_label") == S.NEGATIVE)
    return RP.dataset_status({"unified": df, "videos": videos}, {"unified": df, "videos": shown})


@register(
    "rpt_global_date_bounds",
    f"""{R}, d AS (SELECT published_at FROM reviews UNION ALL SELECT ts FROM events)
    SELECT min(published_at) AS first_date, max(published_at) AS last_date FROM d""",
)
def global_date_bounds(spark, sf_dir):
    events = read_table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("published_at"))
    return RP.global_date_bounds([reviews_view(spark, sf_dir), events])


# ---- exploration ---------------------------------------------------------------------------


@register(
    "eda_value_counts",
    f"""{R}, a AS (SELECT 'with_null' AS mode, complaint_status AS value, count(*) AS n FROM reviews GROUP BY 2),
      b AS (SELECT 'no_null' AS mode, value, n FROM a WHERE value IS NOT NULL)
    SELECT *, round(n / sum(n) OVER (PARTITION BY mode) * 100, 2) AS pct FROM (SELECT * FROM a UNION ALL SELECT * FROM b)""",
)
def value_counts(spark, sf_dir):
    df = reviews_view(spark, sf_dir)
    with_null = eda.value_counts(df, "complaint_status", with_null=True)
    without = eda.value_counts(df, "complaint_status")
    return with_null.withColumn("mode", F.lit("with_null")).unionByName(
        without.withColumn("mode", F.lit("no_null"))
    )


@register(
    "eda_span_by_source",
    f"""WITH {Q.docs(label=False, dates=True)} SELECT source, min(published_at) AS first_date,
    max(published_at) AS last_date, count(published_at) AS n_dated FROM docs GROUP BY source""",
)
def span_by_source(spark, sf_dir):
    return eda.span_by_source(docs_view(spark, sf_dir, label=False, dates=True))


COLUMNS = ("published_at", "raw_text", "rating", "complaint_status", "app_version", "label")


@register(
    "eda_completeness",
    f"{R} " + " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, {Q.r6(f'count({c}) * 100 / count(*)')} AS pct_filled FROM reviews" for c in COLUMNS
    ),
)
def completeness(spark, sf_dir):
    return eda.completeness(reviews_view(spark, sf_dir), COLUMNS)


@register(
    "eda_null_counts",
    f"{R} " + " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) - count({c}) AS n_null FROM reviews" for c in COLUMNS
    ),
)
def null_counts(spark, sf_dir):
    return eda.null_counts(reviews_view(spark, sf_dir), COLUMNS)


_DESCRIBE = """count({0}) AS n, round(avg({0}), 6) AS mean, round(stddev_samp({0}), 6) AS std, min({0}) AS min,
    max({0}) AS max, round(quantile_cont({0}, 0.25), 6) AS p25, round(quantile_cont({0}, 0.5), 6) AS p50,
    round(quantile_cont({0}, 0.75), 6) AS p75"""


@register("eda_describe", f"SELECT {_DESCRIBE.format('o_totalprice')} FROM orders")
def describe(spark, sf_dir):
    return eda.describe(read_table(spark, sf_dir, "orders"), "o_totalprice")


@register(
    "eda_describe_by_source",
    f"{R} SELECT source, {_DESCRIBE.format('rating')} FROM reviews WHERE rating IS NOT NULL GROUP BY source",
)
def describe_by_source(spark, sf_dir):
    return eda.describe(reviews_view(spark, sf_dir), "rating", ["source"])


@register(
    "eda_text_length",
    r"""SELECT source, round(avg(length(text)), 6) AS mean_chars, median(length(text)) AS median_chars,
    min(length(text)) AS min_chars, max(length(text)) AS max_chars,
    round(avg(len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> ''))), 6) AS mean_words
    FROM documents GROUP BY source""",
)
def text_length(spark, sf_dir):
    return eda.text_length(docs_view(spark, sf_dir, label=False))


@register(
    "eda_crosstab",
    f"""{R} SELECT rating, count(*) FILTER (label = 'Negativo') AS Negativo, count(*) FILTER (label = 'Neutro') AS Neutro,
    count(*) FILTER (label = 'Positivo') AS Positivo FROM reviews WHERE label IS NOT NULL GROUP BY rating""",
)
def crosstab(spark, sf_dir):
    return eda.crosstab(reviews_view(spark, sf_dir), "rating", "label", S.LABELS)


@register(
    "eda_nonnull_by_source",
    f"{R} SELECT source, count(raw_text) AS n_text FROM reviews GROUP BY source",
)
def nonnull_by_source(spark, sf_dir):
    return eda.nonnull_by_source(reviews_view(spark, sf_dir))


@register(
    "eda_source_month",
    f"""{R} SELECT source, strftime(published_at, '%Y-%m') AS month, count(*) AS n FROM reviews
    WHERE published_at IS NOT NULL GROUP BY ALL""",
)
def source_month(spark, sf_dir):
    return eda.source_month(reviews_view(spark, sf_dir))


TOKENS = f"""WITH {Q.docs()}, t AS (SELECT label, source, unnest({Q.clean_tokens("raw_text")}) AS token FROM docs)"""


@register(
    "eda_token_freq",
    f"{TOKENS} SELECT token, count(*) AS n FROM t GROUP BY token ORDER BY n DESC, token LIMIT 30",
)
def token_freq(spark, sf_dir):
    return eda.token_frequencies(text_docs(spark, sf_dir, label=False), clean_tokens(F.col("raw_text")))


def _grouped_tokens(key: str) -> str:
    return f"""{TOKENS}, g AS (SELECT {key}, token, count(*) AS n FROM t WHERE {key} IS NOT NULL GROUP BY ALL)
    SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY n DESC, token) <= 20"""


@register("eda_token_freq_by_source", _grouped_tokens("source"))
def token_freq_by_source(spark, sf_dir):
    df = text_docs(spark, sf_dir, label=False)
    return eda.token_frequencies(df, clean_tokens(F.col("raw_text")), 20, ["source"])


@register("eda_token_freq_by_label", _grouped_tokens("label"))
def token_freq_by_label(spark, sf_dir):
    return eda.token_frequencies(text_docs(spark, sf_dir), clean_tokens(F.col("raw_text")), 20, ["label"])


@register(
    "eda_random_sample",
    f"{R} SELECT record_id, raw_text FROM reviews ORDER BY md5(record_id || '42'), record_id LIMIT 10",
)
def random_sample(spark, sf_dir):
    return eda.random_sample(reviews_view(spark, sf_dir)).select("record_id", "raw_text")
