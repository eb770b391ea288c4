"""Scalar functions over whole texts and columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedback_engine import schemas as S
from feedback_engine.catalog import register
from feedback_engine.catalog import sqltext as Q
from feedback_engine.catalog.preparing import complaint_clean_sql
from feedback_engine.functions import rules, text
from feedback_engine.functions import scalars as SC
from feedback_engine.functions import wordlists as W
from feedback_engine.operators import prepare as P
from feedback_engine.operators.ranking import explode_terms
from feedback_engine.operators.topics import cluster_shares
from feedback_engine.plans.adapters import read_table, reviews_view, text_docs, themed_reviews

D = f"WITH {Q.docs(label=False)}"
R = f"WITH {Q.reviews()}"


def both_texts(spark, sf_dir):
    """Document and review texts together, null texts included."""
    columns = ("record_id", "raw_text")
    docs = text_docs(spark, sf_dir, label=False).select(*columns)
    return docs.unionByName(reviews_view(spark, sf_dir).select(*columns))


BOTH = f"""WITH {Q.docs(label=False)}, {Q.reviews()}, t AS (
    SELECT record_id, raw_text FROM docs UNION ALL SELECT record_id, raw_text FROM reviews)"""


@register("fn_normalize_text", f"{BOTH} SELECT record_id, {Q.normalize('raw_text')} AS normalized FROM t")
def normalize_text(spark, sf_dir):
    return both_texts(spark, sf_dir).select(
        "record_id", text.normalize_text(F.col("raw_text")).alias("normalized")
    )


@register(
    "fn_tokenize",
    f"""{BOTH} SELECT record_id, len(regexp_extract_all(lower(raw_text), '[a-z0-9]+')) AS n_tokens,
    array_to_string(regexp_extract_all(lower(raw_text), '[a-z0-9]+'), ' ') AS tokens FROM t WHERE raw_text IS NOT NULL""",
)
def tokenize(spark, sf_dir):
    tokens = text.tokenize(F.col("raw_text"))
    return both_texts(spark, sf_dir).where(F.col("raw_text").isNotNull()).select(
        "record_id", F.size(tokens).alias("n_tokens"), F.array_join(tokens, " ").alias("tokens")
    )


@register(
    "fn_tokenize_ws",
    f"""{BOTH} SELECT record_id, array_to_string({Q.words(Q.normalize("raw_text"))}, '|') AS tokens FROM t
    WHERE raw_text IS NOT NULL""",
)
def tokenize_ws(spark, sf_dir):
    tokens = text.split_words(text.normalize_text(F.col("raw_text")))
    return both_texts(spark, sf_dir).where(F.col("raw_text").isNotNull()).select(
        "record_id", F.array_join(tokens, "|").alias("tokens")
    )


_PROFILES = ("sentiment", "pipeline", "topic_neutral", "topic", "topic_cluster")


@register(
    "fn_remove_stopwords",
    f"""{BOTH}, n AS (SELECT record_id, {Q.words(Q.normalize("coalesce(raw_text, '')"))} AS w FROM t)
    SELECT record_id, {", ".join(f"array_to_string({Q.drop_words('w', W.STOPWORD_PROFILES[p])}, ' ') AS {p}" for p in _PROFILES)} FROM n""",
)
def remove_stopwords(spark, sf_dir):
    normalized = both_texts(spark, sf_dir).select(
        "record_id", text.normalize_text(F.coalesce("raw_text", F.lit(""))).alias("_n")
    )
    return normalized.select(
        "record_id", *[text.remove_stopwords(F.col("_n"), p).alias(p) for p in _PROFILES]
    )


@register("fn_clean_text", f"{BOTH} SELECT record_id, {Q.clean('raw_text')} AS clean_text FROM t")
def clean_text(spark, sf_dir):
    return both_texts(spark, sf_dir).select(
        "record_id", text.clean_text(F.col("raw_text")).alias("clean_text")
    )


@register(
    "fn_clean_text_pipeline",
    f"{BOTH} SELECT record_id, {Q.clean('raw_text', 'pipeline')} AS clean_text FROM t",
)
def clean_text_pipeline(spark, sf_dir):
    return both_texts(spark, sf_dir).select(
        "record_id", text.clean_text(F.col("raw_text"), "pipeline").alias("clean_text")
    )


@register(
    "fn_clean_complaint",
    f"{BOTH} SELECT record_id, {complaint_clean_sql('raw_text')} AS clean_text FROM t",
)
def clean_complaint(spark, sf_dir):
    return both_texts(spark, sf_dir).select(
        "record_id", text.clean_complaint(F.col("raw_text")).alias("clean_text")
    )


@register(
    "fn_preprocess_reviews",
    f"""{BOTH}, c AS (SELECT record_id, coalesce(raw_text, '') AS raw_text, {Q.clean("raw_text")} AS clean_text FROM t)
    SELECT record_id, md5(raw_text) AS text_hash, clean_text FROM c WHERE clean_text <> ''""",
)
def preprocess_reviews(spark, sf_dir):
    return P.preprocess_reviews(both_texts(spark, sf_dir)).select(
        "record_id", F.md5("raw_text").alias("text_hash"), "clean_text"
    )


@register(
    "fn_compose_complaint_text",
    r"""SELECT l_orderkey, l_linenumber, regexp_replace(
      CASE WHEN trim(coalesce(CASE WHEN l_partkey % 3 <> 0 THEN ' ' || l_returnflag || ' ' END, '')) <> '' THEN 'Assunto: ' || l_returnflag ELSE '' END
      || ' | ' || CASE WHEN l_partkey % 4 <> 0 THEN 'Problema: ' || l_linestatus ELSE '' END
      || ' | ' || CASE WHEN l_partkey % 5 <> 0 THEN 'Categoria: ' || l_suppkey ELSE '' END,
      '^[ |]+|[ |]+$', '', 'g') AS text FROM lineitem""",
)
def compose_complaint_text(spark, sf_dir):
    part = F.col("l_partkey")
    composed = text.compose_complaint_text(
        F.when(part % 3 != 0, F.concat(F.lit(" "), "l_returnflag", F.lit(" "))),
        F.when(part % 4 != 0, F.col("l_linestatus")).otherwise("  "),
        F.when(part % 5 != 0, F.col("l_suppkey").cast("string")),
    )
    return read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", composed.alias("text"))


@register("fn_classify_theme", f"{BOTH} SELECT record_id, {Q.theme('raw_text')} AS theme FROM t")
def classify_theme(spark, sf_dir):
    return both_texts(spark, sf_dir).select(
        "record_id", rules.classify_theme(F.col("raw_text")).alias("theme")
    )


@register(
    "fn_classify_theme_accent_sensitive",
    f"{BOTH} SELECT record_id, {Q.theme('raw_text', accent_sensitive=True)} AS theme FROM t",
)
def classify_theme_accent_sensitive(spark, sf_dir):
    return both_texts(spark, sf_dir).select(
        "record_id", rules.classify_theme(F.col("raw_text"), accent_sensitive=True).alias("theme")
    )


@register(
    "fn_theme_action",
    f"""WITH {Q.themed()} SELECT theme, {Q.theme_action("theme")} AS action,
    {Q.theme_action("theme", accent_sensitive=True)} AS action_accent_sensitive, count(*) AS n FROM themed GROUP BY ALL""",
)
def theme_action(spark, sf_dir):
    return themed_reviews(spark, sf_dir).groupBy("theme").agg(F.count(F.lit(1)).alias("n")).withColumns(
        {
            "action": rules.theme_action(F.col("theme")),
            "action_accent_sensitive": rules.theme_action(F.col("theme"), accent_sensitive=True),
        }
    )


# ---- topic labels: the first words of each text play the keyword list ----------------------

KEYWORDS = f"""WITH {Q.docs(label=False)}, {Q.reviews()}, k AS (
      SELECT record_id, {Q.words(Q.normalize("coalesce(raw_text, '')"))} AS kw,
        CASE length(record_id) % 3 WHEN 0 THEN 'Positivo' WHEN 1 THEN 'Negativo' ELSE 'Misto' END AS signal
      FROM (SELECT record_id, raw_text FROM docs UNION ALL SELECT record_id, raw_text FROM reviews)),
    j AS (SELECT *, array_to_string(kw, ' ') AS t FROM k)"""


def _has(markers) -> str:
    return "(" + " OR ".join(f"contains(t, {Q.lit(m)})" for m in markers) + ")"


_CAP = "upper(left({0}, 1)) || substr({0}, 2)"
_FALLBACK = (
    f"CASE WHEN len(kw) = 0 THEN 'Tema sem rotulo' ELSE {_CAP.format('kw[1]')} || coalesce(' / ' || "
    f"{_CAP.format('list_filter(kw, lambda w: w <> kw[1])[1]')}, '') END"
)
TOPIC_LABEL = (
    "CASE "
    + " ".join(f"WHEN {_has(m)} THEN {Q.lit(v)}" for m, v in W.TOPIC_LABELS)
    + f" WHEN {_has(['cartao'])} THEN CASE WHEN {_has(W.CARD_MARKERS)} THEN 'Cartão / fatura' ELSE 'Cartão / uso' END"
    + f" WHEN {_has(['conta'])} AND {_has(W.ACCOUNT_MARKERS)} THEN 'Conta / movimentação' ELSE {_FALLBACK} END"
)


def keyword_rows(spark, sf_dir):
    words = text.split_words(text.normalize_text(F.coalesce("raw_text", F.lit(""))))
    turn = F.length("record_id") % 3
    return both_texts(spark, sf_dir).select(
        "record_id",
        words.alias("kw"),
        F.when(turn == 0, S.POSITIVE).when(turn == 1, S.NEGATIVE).otherwise(S.MIXED).alias("signal"),
    )


@register("fn_topic_label", f"{KEYWORDS} SELECT record_id, {TOPIC_LABEL} AS topic FROM j")
def topic_label(spark, sf_dir):
    return keyword_rows(spark, sf_dir).select("record_id", rules.topic_label(F.col("kw")).alias("topic"))


_SIGNAL = "CASE signal WHEN 'Positivo' THEN '{0}' WHEN 'Negativo' THEN '{1}' ELSE '{2}' END"
REFINED = f"""CASE WHEN {_has(["emprest", "credito"])} OR starts_with(topic, 'Empréstimo')
      THEN {_SIGNAL.format("Crédito / oferta", "Empréstimo / crédito", "Crédito / elegibilidade")}
    WHEN {_has(["cartao"])} OR starts_with(topic, 'Cartão')
      THEN {_SIGNAL.format("Cartão / uso", "Cartão / fatura", "Cartão / suporte")}
    WHEN {_has(W.ACCESS_MARKERS)} OR ({_has(["conta"])} AND signal = 'Negativo') THEN 'Conta bloqueada / acesso'
    ELSE trim(topic) END"""


@register(
    "fn_refine_topic_label",
    f"{KEYWORDS}, l AS (SELECT *, {TOPIC_LABEL} AS topic FROM j) SELECT record_id, {REFINED} AS topic FROM l",
)
def refine_topic_label(spark, sf_dir):
    rows = keyword_rows(spark, sf_dir).withColumn("topic", rules.topic_label(F.col("kw")))
    return rows.select(
        "record_id",
        rules.refine_topic_label(F.col("topic"), F.col("signal"), F.col("kw")).alias("topic"),
    )


@register(
    "fn_cluster_action",
    f"""{KEYWORDS}, l AS (SELECT *, {TOPIC_LABEL} AS topic FROM j)
    SELECT record_id, {Q.cluster_action("topic", "signal")} AS action FROM l""",
)
def cluster_action(spark, sf_dir):
    rows = keyword_rows(spark, sf_dir).withColumn("topic", rules.topic_label(F.col("kw")))
    return rows.select("record_id", rules.cluster_action(F.col("topic"), F.col("signal")).alias("action"))


_CLUSTERS = """g AS (SELECT l_suppkey AS cluster_id, avg(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END) AS p,
    avg(CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END) AS q, avg(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS r
    FROM lineitem GROUP BY 1)"""


def supplier_shares(spark, sf_dir):
    flags = {"A": S.POSITIVE, "N": S.NEGATIVE, "R": S.NEUTRAL}
    names = F.create_map(*[F.lit(x) for kv in flags.items() for x in kv])
    rows = read_table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("cluster_id"), names[F.col("l_returnflag")].alias("predicted_label")
    )
    return cluster_shares(rows)


@register(
    "fn_cluster_signal",
    f"""WITH {_CLUSTERS} SELECT cluster_id, CASE WHEN p >= 0.55 AND p - q >= 0.15 THEN 'Positivo'
    WHEN q >= 0.55 AND q - p >= 0.15 THEN 'Negativo' ELSE 'Misto' END AS signal FROM g""",
)
def cluster_signal(spark, sf_dir):
    return supplier_shares(spark, sf_dir).select(
        "cluster_id", rules.cluster_signal(F.col("share_pos"), F.col("share_neg")).alias("signal")
    )


@register(
    "fn_predominant_sentiment",
    f"""WITH {_CLUSTERS} SELECT cluster_id, CASE WHEN p >= greatest(q, r) THEN 'Positivo'
    WHEN q >= greatest(p, r) THEN 'Negativo' ELSE 'Neutro' END AS label FROM g""",
)
def predominant_sentiment(spark, sf_dir):
    pos, neg, neu = (F.col(f"share_{x}") for x in ("pos", "neg", "neu"))
    return supplier_shares(spark, sf_dir).select(
        "cluster_id", rules.predominant_label(pos, neg, neu).alias("label")
    )


@register(
    "fn_format_keyword",
    """SELECT c_custkey, upper(left(k, 1)) || substr(k, 2) AS keyword FROM (
      SELECT c_custkey, trim(replace(' ' || lower(c_mktsegment) || '_' || lower(c_name), '_', ' ')) AS k FROM customer)""",
)
def format_keyword(spark, sf_dir):
    keyword = F.concat(F.lit(" "), F.lower("c_mktsegment"), F.lit("_"), F.lower("c_name"))
    return read_table(spark, sf_dir, "customer").select(
        "c_custkey", text.format_keyword(keyword).alias("keyword")
    )


_WS = r"[\s\x0B\x1C-\x1F\x{85}\p{Z}]+"


def _context(x: str) -> str:
    collapsed = f"trim(regexp_replace(coalesce({x}, ''), '{_WS}', ' ', 'g'))"
    return f"CASE WHEN lower({collapsed}) IN ('', 'nan', 'none', 'sem informacao', 'nao informado') THEN '' ELSE {collapsed} END"


@register(
    "fn_clean_context_value",
    f"""{BOTH} SELECT record_id, {_context("raw_text")} AS value FROM t
    UNION ALL SELECT 'n' || n_nationkey, '' FROM nation""",
)
def clean_context_value(spark, sf_dir):
    nullish = read_table(spark, sf_dir, "nation").select(
        F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("record_id"),
        F.when(F.col("n_nationkey") % 2 == 0, " Sem  informacao ").otherwise("NaN").alias("raw_text"),
    )
    return both_texts(spark, sf_dir).unionByName(nullish).select(
        "record_id", text.clean_context_value(F.col("raw_text")).alias("value")
    )


@register(
    "fn_context_text",
    f"""WITH {Q.themed()}, p AS (SELECT record_id, raw_text, {Q.display("source")} AS a,
        CASE WHEN rating IS NULL THEN theme ELSE problem_category END AS b,
        nullif({_context("complaint_status")}, '') AS c, nullif({_context("raw_text")}, '') AS d FROM themed)
    SELECT record_id, concat_ws(' | ', 'fonte: ' || a, 'categoria: ' || b, 'status: ' || c, 'texto: ' || d) AS context FROM p""",
)
def context_text(spark, sf_dir):
    category = F.when(F.col("rating").isNotNull(), F.col("problem_category")).otherwise(" nao informado ")
    context = text.context_text(
        F.col("source"), category, F.col("theme"), F.col("complaint_status"), F.col("raw_text"), F.lit(None).cast("string")
    )
    return themed_reviews(spark, sf_dir).select("record_id", context.alias("context"))


# ---- class scores --------------------------------------------------------------------------

LOGITS = """z AS (SELECT l_orderkey, l_linenumber, l_quantity / 10 AS a, l_discount * 40 AS b, l_tax * 50 AS c FROM lineitem),
    e AS (SELECT *, exp(a - greatest(a, b, c)) AS x, exp(b - greatest(a, b, c)) AS y, exp(c - greatest(a, b, c)) AS w FROM z),
    p AS (SELECT *, x / (x + y + w) AS p0, y / (x + y + w) AS p1, w / (x + y + w) AS p2 FROM e)"""


def probabilities(spark, sf_dir):
    logits = F.array(F.col("l_quantity") / 10, F.col("l_discount") * 40, F.col("l_tax") * 50)
    rows = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", logits.alias("_z"))
    return rows.withColumn("_p", SC.softmax(F.col("_z")))


@register(
    "fn_softmax_annotate",
    f"""WITH {LOGITS} SELECT l_orderkey, l_linenumber, {Q.r6("p0")} AS score_neg, {Q.r6("p1")} AS score_neu, {Q.r6("p2")} AS score_pos,
    CASE WHEN p0 >= greatest(p1, p2) THEN 'Negativo' WHEN p1 >= p2 THEN 'Neutro' ELSE 'Positivo' END AS label,
    {Q.r6("greatest(p0, p1, p2)")} AS confidence FROM p""",
)
def softmax_annotate(spark, sf_dir):
    return probabilities(spark, sf_dir).select(
        "l_orderkey",
        "l_linenumber",
        *SC.score_columns(F.col("_p")),
        SC.index_label(SC.argmax(F.col("_p"))).alias("label"),
        F.array_max("_p").alias("confidence"),
    )


@register(
    "fn_uncertainty",
    f"""WITH {LOGITS}, m AS (SELECT *, greatest(p0, p1, p2) AS top, greatest(least(p0, p1), least(p1, p2), least(p0, p2)) AS second FROM p)
    SELECT l_orderkey, l_linenumber, {Q.r6("top - second")} AS margin, top < 0.55 OR top - second < 0.15 AS is_uncertain FROM m""",
)
def uncertainty(spark, sf_dir):
    return probabilities(spark, sf_dir).select(
        "l_orderkey",
        "l_linenumber",
        SC.margin(F.col("_p")).alias("margin"),
        SC.is_uncertain(F.col("_p")).alias("is_uncertain"),
    )


# ---- parsing and formatting ----------------------------------------------------------------


@register(
    "fn_parse_ts",
    f"""{R} SELECT record_id, published_at AS parsed FROM reviews""",
)
def parse_ts(spark, sf_dir):
    landed = F.coalesce(F.date_format("published_at", "yyyy-MM-dd HH:mm:ss"), F.lit("ontem"))
    return reviews_view(spark, sf_dir).select("record_id", SC.parse_timestamp(landed).alias("parsed"))


@register(
    "fn_parse_num",
    f"""{R} SELECT record_id, rating AS parsed FROM reviews""",
)
def parse_num(spark, sf_dir):
    landed = F.coalesce(F.concat(F.lit(" "), F.col("rating").cast("string")), F.lit("n/a"))
    return reviews_view(spark, sf_dir).select("record_id", SC.parse_number(landed).alias("parsed"))


@register(
    "fn_local_date",
    """SELECT event_id, CAST(CAST(ts - INTERVAL 3 HOUR AS DATE) AS TIMESTAMP) AS local_date,
    ts - INTERVAL 3 HOUR AS local_ts FROM events""",
)
def local_date(spark, sf_dir):
    ts = F.col("ts").cast("timestamp")
    return read_table(spark, sf_dir, "events").select(
        "event_id", SC.local_date(ts).alias("local_date"), SC.local_timestamp(ts).alias("local_ts")
    )


@register(
    "fn_month_start",
    f"SELECT l_orderkey, l_linenumber, {Q.month('l_shipdate')} AS month FROM lineitem",
)
def month_start(spark, sf_dir):
    return read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", SC.month_start(F.col("l_shipdate")).alias("month")
    )


@register(
    "fn_year_month",
    "SELECT strftime(l_shipdate, '%Y-%m') AS month, count(*) AS n FROM lineitem GROUP BY 1",
)
def year_month(spark, sf_dir):
    months = read_table(spark, sf_dir, "lineitem").select(SC.year_month(F.col("l_shipdate")).alias("month"))
    return months.groupBy("month").agg(F.count(F.lit(1)).alias("n"))


@register(
    "fn_format_date",
    """SELECT o_orderkey, strftime(o_orderdate, '%d/%m/%Y') AS day,
    strftime(o_orderdate, '%d/%m/%Y') || ' ate ' || strftime(o_orderdate + INTERVAL 1 DAY, '%d/%m/%Y') AS span FROM orders""",
)
def format_date(spark, sf_dir):
    day = F.col("o_orderdate")
    return read_table(spark, sf_dir, "orders").select(
        "o_orderkey",
        SC.format_date(day).alias("day"),
        SC.format_span(day, F.date_add(F.to_date(day), 1)).alias("span"),
    )


@register(
    "fn_format_int",
    "SELECT o_orderkey, replace(format('{:,}', o_orderkey * 977), ',', '.') AS text FROM orders",
)
def format_int(spark, sf_dir):
    return read_table(spark, sf_dir, "orders").select(
        "o_orderkey", SC.format_int(F.col("o_orderkey") * 977).alias("text")
    )


@register(
    "fn_format_pct",
    "SELECT l_orderkey, l_linenumber, printf('%.1f%%', l_discount * 100) AS text FROM lineitem",
)
def format_pct(spark, sf_dir):
    return read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", SC.format_pct(F.col("l_discount")).alias("text")
    )


@register(
    "fn_digits_filter",
    rf"""{D}, w AS (SELECT unnest({Q.words(Q.normalize("raw_text"))}) AS word FROM docs)
    SELECT length(word) >= 3 AND NOT regexp_full_match(word, '\d+') AS is_keyword, count(*) AS n FROM w GROUP BY 1""",
)
def digits_filter(spark, sf_dir):
    split = text.split_words(text.normalize_text(F.col("raw_text")))
    words = explode_terms(text_docs(spark, sf_dir, label=False), [], split, ["word"])
    return words.groupBy(text.is_keyword(F.col("word")).alias("is_keyword")).agg(F.count(F.lit(1)).alias("n"))


@register("fn_bool_or_false", f"{R} SELECT record_id, coalesce(is_uncertain, FALSE) AS flag FROM reviews")
def bool_or_false(spark, sf_dir):
    return reviews_view(spark, sf_dir).select(
        "record_id", SC.bool_or_false(F.col("is_uncertain")).alias("flag")
    )


@register(
    "fn_last_path_segment",
    "SELECT page_id, string_split(url, '/')[-1] AS segment FROM pages",
)
def last_path_segment(spark, sf_dir):
    return read_table(spark, sf_dir, "pages").select(
        "page_id", text.last_path_segment(F.col("url")).alias("segment")
    )
