"""SQL building blocks of the oracle twins: the views and the text rules in plain SQL."""

from __future__ import annotations

from feedback_engine.functions import wordlists as W
from feedback_engine.plans import adapters as A
from feedback_engine.schemas import NEGATIVE, NEUTRAL, POSITIVE


def lit(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, str):
        return "'" + value.replace("'", "''") + "'"
    return str(value)


def str_list(values) -> str:
    return "[" + ", ".join(lit(v) for v in sorted(values)) + "]"


def pick(values, index: str) -> str:
    whens = " ".join(f"WHEN {i} THEN {lit(v)}" for i, v in enumerate(values) if v is not None)
    return f"CASE {index} {whens} END"


def rating_label(x: str) -> str:
    return (
        f"CASE WHEN {x} IN (1, 2) THEN '{NEGATIVE}' WHEN {x} = 3 THEN '{NEUTRAL}' "
        f"WHEN {x} IN (4, 5) THEN '{POSITIVE}' END"
    )


_SOURCE = (
    "CASE WHEN o_orderkey % 10 < 6 THEN 'google_play' WHEN o_orderkey % 10 < 8 THEN 'youtube' "
    "ELSE 'consumidor_gov' END"
)
_RATING = (
    "CASE WHEN o_orderkey % 10 NOT IN (6, 7) "
    "THEN CAST(substr(o_orderpriority, 1, 1) AS DOUBLE) END"
)
_CONFIDENCE = (
    "CASE WHEN o_orderkey % 17 <> 0 "
    "THEN CAST(0.4 AS DOUBLE) + CAST(o_orderkey % 60 AS DOUBLE) / CAST(100 AS DOUBLE) END"
)


def reviews(region: bool = False) -> str:
    """CTE ``reviews``: the SQL twin of ``adapters.reviews_view``."""
    joins = (
        "LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey"
        if region
        else ""
    )
    status = " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in A.STATUS.items())
    return f"""reviews AS (
  SELECT 'o' || o_orderkey AS record_id, {_SOURCE} AS source,
    CASE WHEN o_orderkey % 29 <> 0 THEN o_orderdate END AS published_at,
    {pick(A.PHRASES, "o_orderkey % 12")} AS raw_text, {_RATING} AS rating,
    CASE o_orderstatus {status} END AS complaint_status, o_orderpriority AS problem_category,
    CASE WHEN o_orderkey % 10 < 6 THEN '7.' || (o_orderkey % 5) END AS app_version,
    CASE WHEN o_orderkey % 10 < 6 THEN {rating_label("(" + _RATING + ")")} END AS label,
    CASE WHEN o_orderkey % 17 = 0 THEN NULL WHEN o_totalprice < {A.LOW_PRICE} THEN '{NEGATIVE}'
      WHEN o_totalprice < {A.HIGH_PRICE} THEN '{NEUTRAL}' ELSE '{POSITIVE}' END AS predicted_label,
    {_CONFIDENCE} AS confidence, ({_CONFIDENCE}) < CAST(0.55 AS DOUBLE) AS is_uncertain,
    CASE WHEN o_custkey % 8 <> 7 THEN 'Topico ' || (o_custkey % 8 + 1) END AS topic,
    o_custkey % 8 AS cluster_id{", n_name AS region" if region else ""}
  FROM orders {joins})"""


def docs(label: bool = True, dates: bool = False) -> str:
    """CTE ``docs``: the SQL twin of ``adapters.docs_view``."""
    columns = ["'d' || d.doc_id AS record_id", "d.source", "d.text AS raw_text", "d.lang AS region"]
    joins = ""
    if label:
        joins += " LEFT JOIN labels l ON l.doc_id = d.doc_id"
        columns.append(
            f"CASE WHEN l.toxic = 1 THEN '{NEGATIVE}' WHEN l.quality = 1 THEN '{POSITIVE}' "
            f"WHEN l.quality IS NOT NULL THEN '{NEUTRAL}' END AS label"
        )
    if dates:
        joins += " LEFT JOIN events e ON e.event_id = d.doc_id"
        columns.append("e.ts AS published_at")
    return f"docs AS (SELECT {', '.join(columns)} FROM documents d{joins})"


def translit(x: str) -> str:
    out = rf"regexp_replace(lower({x}), '[\x{{0300}}-\x{{036F}}\x{{10000}}-\x{{10FFFF}}]', '', 'g')"
    spellings = (("ß", "ss"), ("æ", "ae"), ("œ", "oe"), ("þ", "th"), ("ĳ", "ij"), ("ŋ", "ng"))
    for a, b in spellings:
        out = f"replace({out}, '{a}', '{b}')"
    return f"strip_accents(translate({out}, 'øđðłħŧıªº¹²³', 'oddlhtiao123'))"


def normalize(x: str) -> str:
    out = rf"regexp_replace({translit(x)}, 'http\S+|www\.\S+', ' ', 'g')"
    out = rf"regexp_replace({out}, '[^a-z0-9\s]', ' ', 'g')"
    return rf"trim(regexp_replace({out}, '\s+', ' ', 'g'))"


def words(x: str) -> str:
    return f"list_filter(string_split({x}, ' '), lambda w: w <> '')"


def drop_words(tokens: str, stopwords) -> str:
    return f"list_filter({tokens}, lambda w: NOT list_contains({str_list(stopwords)}, w))"


def clean_tokens(x: str, profile: str = "sentiment") -> str:
    return drop_words(words(normalize(f"coalesce({x}, '')")), W.STOPWORD_PROFILES[profile])


def clean(x: str, profile: str = "sentiment") -> str:
    return f"array_to_string({clean_tokens(x, profile)}, ' ')"


def theme(x: str, accent_sensitive: bool = False) -> str:
    text = f"lower({x})" if accent_sensitive else translit(x)
    whens = " ".join(
        f"WHEN regexp_matches({text}, '{pattern}') THEN {lit(name)}" for name, pattern in W.THEME_RULES
    )
    return f"CASE WHEN {x} IS NULL THEN 'Sem texto' {whens} ELSE 'Outros temas' END"


def substring_rules(text: str, rules, default: str, first: str = "") -> str:
    whens = " ".join(
        "WHEN " + " OR ".join(f"contains({text}, {lit(m)})" for m in markers) + f" THEN {lit(value)}"
        for markers, value in rules
    )
    return f"CASE {first} {whens} ELSE {default} END"


def theme_action(x: str, accent_sensitive: bool = False) -> str:
    text = f"lower({x})" if accent_sensitive else translit(x)
    return substring_rules(text, W.THEME_ACTIONS, lit(W.DEFAULT_ACTION))


def cluster_action(topic: str, signal: str) -> str:
    first = f"WHEN {signal} = 'Misto' THEN {lit(W.MIXED_ACTION)}"
    return substring_rules(f"lower({topic})", W.CLUSTER_ACTIONS, lit(W.DEFAULT_ACTION), first)


def display(x: str) -> str:
    whens = " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in W.SOURCE_DISPLAY.items())
    words_ = (
        f"array_to_string(list_transform(string_split(replace({x}, '_', ' '), ' '), "
        "lambda w: upper(left(w, 1)) || lower(substr(w, 2))), ' ')"
    )
    return f"CASE {x} {whens} ELSE {words_} END"


def pct(x: str) -> str:
    """One decimal, half away from zero, as text."""
    return f"printf('%.1f%%', round(({x}) * 100, 1))"


def month(x: str) -> str:
    return f"CAST(date_trunc('month', {x}) AS TIMESTAMP)"


def r6(x: str) -> str:
    return f"round(CAST({x} AS DOUBLE), 6)"


def big(x: str) -> str:
    return f"CAST({x} AS BIGINT)"


def ratio(a: str, b: str) -> str:
    return f"coalesce(CAST({a} AS DOUBLE) / nullif(CAST({b} AS DOUBLE), 0), 0)"


def themed() -> str:
    """CTEs ``reviews`` and ``themed`` (reviews with their theme)."""
    return f"""{reviews()}, themed AS (
  SELECT *, {theme("coalesce(raw_text, '')")} AS theme FROM reviews)"""


def clustered() -> str:
    label, signal = pick(A.CLUSTER_LABELS, "cluster_id"), pick(A.CLUSTER_SIGNALS, "cluster_id")
    return f"""{reviews()}, clustered AS (
  SELECT *, {label} AS cluster_label, {signal} AS cluster_signal,
    CASE WHEN cluster_id % 3 <> 0 THEN coalesce(raw_text, '') END AS cluster_example,
    {cluster_action("(" + label + ")", "(" + signal + ")")} AS cluster_action,
    'k' || cluster_id AS cluster_keywords
  FROM reviews)"""
