"""Record layouts of the bronze, silver and gold layers and the label order."""

from __future__ import annotations

from pyspark.sql import types as T

NEGATIVE, NEUTRAL, POSITIVE = "Negativo", "Neutro", "Positivo"
LABELS = (NEGATIVE, NEUTRAL, POSITIVE)
DISPLAY_ORDER = (POSITIVE, NEGATIVE, NEUTRAL)
LABEL_INDEX = {NEGATIVE: 0, NEUTRAL: 1, POSITIVE: 2}
MIXED = "Misto"
NO_INFORMATION = "Sem informacao"
NO_TEXT = "Sem texto"
OTHER_THEMES = "Outros temas"
UNKNOWN_SOURCE = "desconhecido"
UNINFORMATIVE_THEMES = (OTHER_THEMES, NO_TEXT, NO_INFORMATION)
NOT_INFORMED = "Não informado"
NOT_APPLICABLE = "Não aplicável"

REVIEW_SOURCE, VIDEO_SOURCE, COMPLAINT_SOURCE = "google_play", "youtube", "consumidor_gov"
ALL_SOURCES = (REVIEW_SOURCE, VIDEO_SOURCE, COMPLAINT_SOURCE)


def _struct(fields: list[tuple[str, T.DataType]]) -> T.StructType:
    return T.StructType([T.StructField(name, dtype) for name, dtype in fields])


_S, _D, _TS, _B, _I = T.StringType(), T.DoubleType(), T.TimestampType(), T.BooleanType(), T.IntegerType()

BRONZE = _struct(
    [
        ("record_id", _S),
        ("source", _S),
        ("published_at", _TS),
        ("raw_text", _S),
        ("rating", _D),
        ("complaint_status", _S),
        ("problem_category", _S),
        ("region", _S),
        ("app_version", _S),
        ("label", _S),
    ]
)
SILVER = _struct(
    [(f.name, f.dataType) for f in BRONZE[:4]]
    + [("clean_text", _S)]
    + [(f.name, f.dataType) for f in BRONZE[4:]]
    + [("processed_at", _TS)]
)
GOLD_SENTIMENT = _struct(
    [(f.name, f.dataType) for f in SILVER[:-1]]
    + [("predicted_label", _S), ("topic", _S), ("processed_at", _TS)]
)
GOLD_METRICS = _struct(
    [
        ("run_id", _S),
        ("model", _S),
        ("vectorizer", _S),
        ("accuracy", _D),
        ("precision_macro", _D),
        ("recall_macro", _D),
        ("f1_macro", _D),
        ("trained_at", _TS),
        ("observations", _S),
    ]
)
METRIC_NAMES = (
    "accuracy",
    "precision_macro",
    "recall_macro",
    "f1_macro",
    "roc_auc_macro",
    "roc_auc_weighted",
    "f1_neg",
    "f1_neu",
    "f1_pos",
)
MODEL_SUMMARY = _struct(
    [("model", _S)]
    + [(name, _D) for name in METRIC_NAMES]
    + [("is_primary", _B), ("insight_summary", _S), ("provenance", _S)]
)
UNIFIED = _struct(
    [
        ("record_id", _S),
        ("source", _S),
        ("published_at", _TS),
        ("title", _S),
        ("raw_text", _S),
        ("rating", _D),
        ("author", _S),
        ("problem_category", _S),
        ("complaint_status", _S),
        ("label", _S),
    ]
)
COMPLAINT_EXTRAS = _struct(
    [("subject", _S), ("problem_detail", _S), ("city", _S), ("company", _S), ("source_file", _S)]
)
TOPIC_SUMMARY = _struct(
    [
        ("topic_id", _I),
        ("cluster_id", _I),
        ("topic_name", _S),
        ("keywords", _S),
        ("n_records", T.LongType()),
        ("predominant_label", _S),
        ("dominant_source", _S),
        ("cluster_signal", _S),
        ("share_pos", _D),
        ("share_neg", _D),
        ("share_neu", _D),
        ("suggested_action", _S),
        ("representative_example", _S),
        ("method", _S),
        ("processed_at", _TS),
    ]
)
TOPIC_SUMMARY_SHORT = (
    "topic_id",
    "topic_name",
    "keywords",
    "n_records",
    "predominant_label",
    "dominant_source",
    "processed_at",
)
# Older column names still found in landed files.
LEGACY_NAMES = {"status": "complaint_status", "category": "problem_category", "UF": "region"}
BRONZE_ALIASES = {
    "complaint_status": ("complaint_status", "status"),
    "problem_category": ("problem_category", "category"),
    "region": ("region", "UF"),
    "app_version": ("app_version",),
}
