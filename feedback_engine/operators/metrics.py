"""Classification metrics from counts, ROC, ranking and merging of model rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedback_engine import schemas as S
from feedback_engine.functions.scalars import not_nan, ratio
from feedback_engine.functions.wordlists import NEUTRAL_GUARD
from feedback_engine.operators.ranking import running_totals, with_value_bucket
from feedback_engine.session import materialize

SHORT = dict(zip(S.LABELS, ("neg", "neu", "pos")))
SCORES = {label: f"score_{short}" for label, short in SHORT.items()}


def confusion_counts(
    df: DataFrame, truth: str = "label", predicted: str = "predicted_label", by: Sequence[str] = ()
) -> DataFrame:
    kept = df.where(F.col(truth).isin(*S.LABELS) & F.col(predicted).isNotNull())
    return kept.groupBy(*by, truth, predicted).agg(F.count(F.lit(1)).alias("n"))


def confusion_matrix(
    df: DataFrame, truth: str = "label", predicted: str = "predicted_label"
) -> DataFrame:
    counts = confusion_counts(df, truth, predicted)
    wide = counts.groupBy(truth).pivot(predicted, list(S.LABELS)).agg(F.sum("n")).fillna(0)
    return wide.withColumnsRenamed({k: f"as_{v}" for k, v in SHORT.items()})


def _class_sums(truth: str, predicted: str) -> list[Column]:
    """tp, support and predicted count of each class as aggregates over confusion counts."""

    def total(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0))

    out = []
    for label, short in SHORT.items():
        t, p = F.col(truth) == label, F.col(predicted) == label
        out += [total(t & p).alias(f"tp_{short}"), total(t).alias(f"sup_{short}"), total(p).alias(f"pre_{short}")]
    return out


def _prf(short: str) -> dict[str, Column]:
    tp, sup, pre = (F.col(f"{kind}_{short}") for kind in ("tp", "sup", "pre"))
    return {
        "precision": ratio(tp, pre),
        "recall": ratio(tp, sup),
        "f1": ratio(2 * tp, sup + pre),
        "present": (sup + pre > 0).cast("double"),
    }


def class_report(
    df: DataFrame, truth: str = "label", predicted: str = "predicted_label"
) -> DataFrame:
    """Precision, recall, F1 and support per class."""
    sums = confusion_counts(df, truth, predicted).agg(*_class_sums(truth, predicted))
    rows = [
        F.struct(
            F.lit(label).alias("class"),
            *[_prf(short)[m].alias(m) for m in ("precision", "recall", "f1")],
            F.col(f"sup_{short}").alias("support"),
        )
        for label, short in SHORT.items()
    ]
    return sums.select(F.inline(F.array(*rows)))


def metric_rows(
    df: DataFrame,
    by: Sequence[str] = ("model",),
    truth: str = "label",
    predicted: str = "predicted_label",
) -> DataFrame:
    """Accuracy, macro P/R/F1 over the classes that occur, F1 per class (0 when undefined)."""
    sums = confusion_counts(df, truth, predicted, by).groupBy(*by).agg(
        *_class_sums(truth, predicted), F.sum("n").alias("n_rows")
    )
    parts = {short: _prf(short) for short in SHORT.values()}
    add = lambda cols: reduce(lambda a, b: a + b, cols)
    present = add([p["present"] for p in parts.values()])

    def macro(metric: str) -> Column:
        return ratio(add([p[metric] * p["present"] for p in parts.values()]), present)

    hits = add([F.col(f"tp_{short}") for short in parts])
    return sums.select(
        *by,
        "n_rows",
        ratio(hits, F.col("n_rows")).alias("accuracy"),
        *[macro(m).alias(f"{m}_macro") for m in ("precision", "recall", "f1")],
        *[parts[short]["f1"].alias(f"f1_{short}") for short in parts],
    )


def _score_counts(
    df: DataFrame, scores: Mapping[str, str], truth: str, by: Sequence[str]
) -> DataFrame:
    """(by, class, score) with positives and negatives: one row per distinct score."""
    cells = [
        F.struct(
            F.lit(label).alias("class"),
            F.col(column).cast("double").alias("score"),
            (F.col(truth) == label).alias("hit"),
        )
        for label, column in scores.items()
    ]
    rows = df.where(F.col(truth).isin(*S.LABELS)).select(*by, F.inline(F.array(*cells)))
    return rows.where(F.col("score").isNotNull()).groupBy(*by, "class", "score").agg(
        F.count_if(F.col("hit")).alias("pos"), F.count_if(~F.col("hit")).alias("neg")
    )


def _cumulated(
    df: DataFrame, scores: Mapping[str, str], truth: str, by: Sequence[str], descending: bool
) -> DataFrame:
    counts = _score_counts(df, scores, truth, by)
    return running_totals(
        with_value_bucket(counts, "score", [*by, "class"]),
        [*by, "class"],
        F.col("_vb"),
        [F.desc("score") if descending else F.asc("score")],
        {"pos": F.col("pos"), "neg": F.col("neg")},
        bucket_descending=descending,
    ).drop("_vb")


def roc_auc_by_class(
    df: DataFrame,
    scores: Mapping[str, str] = SCORES,
    truth: str = "label",
    by: Sequence[str] = (),
) -> DataFrame:
    """One-vs-rest AUC per class as a tie-aware rank statistic; null without both outcomes."""
    rows = _cumulated(df, scores, truth, by, descending=False)
    below = (F.col("cum_neg") - F.col("neg")).cast("double") + F.col("neg") / 2.0
    wins = F.sum(F.col("pos") * below)
    pairs = F.max(F.col("all_pos").cast("double") * F.col("all_neg"))
    return rows.groupBy(*by, "class").agg(
        (wins / F.nullif(pairs, F.lit(0.0))).alias("auc"), F.max("all_pos").alias("support")
    )


def roc_auc_ovr(
    df: DataFrame,
    scores: Mapping[str, str] = SCORES,
    truth: str = "label",
    by: Sequence[str] = (),
) -> DataFrame:
    """Macro and support-weighted AUC; null unless every class has a score and an AUC."""
    per_class = roc_auc_by_class(df, scores, truth, by)
    complete = F.count("auc") == len(S.LABELS)
    return per_class.groupBy(*by).agg(
        F.when(complete, F.avg("auc")).alias("roc_auc_macro"),
        F.when(complete, F.sum(F.col("auc") * F.col("support")) / F.sum("support")).alias(
            "roc_auc_weighted"
        ),
    )


def roc_curve(
    df: DataFrame,
    scores: Mapping[str, str] = SCORES,
    truth: str = "label",
    by: Sequence[str] = (),
) -> DataFrame:
    """Curve points at every distinct threshold, from high to low; the origin is implied."""
    rows = _cumulated(df, scores, truth, by, descending=True)
    return rows.select(
        *by,
        "class",
        F.col("score").alias("threshold"),
        ratio(F.col("cum_neg"), F.col("all_neg")).alias("fpr"),
        ratio(F.col("cum_pos"), F.col("all_pos")).alias("tpr"),
    )


def _clean(name: str, df: DataFrame) -> Column:
    return not_nan(F.col(name).cast("double")) if name in df.columns else F.lit(None).cast("double")


def rank_order(df: DataFrame, tie: str = "model") -> list[Column]:
    """Neutral guard, then the metrics, all descending with missing values lowest.

    A missing neutral F1 fails the guard; a table without that column passes it.
    """
    guard = []
    if "f1_neu" in df.columns:
        guard = [F.desc(F.coalesce((_clean("f1_neu", df) >= NEUTRAL_GUARD).cast("int"), F.lit(0)))]
    names = [n for n in ("roc_auc_macro", "f1_macro", "recall_macro", "f1_neu", "accuracy") if n in df.columns]
    return [*guard, *[F.desc_nulls_last(_clean(n, df)) for n in names], F.col(tie)]


def rank_models(df: DataFrame, tie: str = "model") -> DataFrame:
    """Add ``model_rank``, a running count over buckets of the leading metric: no task sees the whole table."""
    guarded = F.lit(0)
    if "f1_neu" in df.columns:
        guarded = F.coalesce((_clean("f1_neu", df) < NEUTRAL_GUARD).cast("int"), F.lit(1))
    auc = F.coalesce(_clean("roc_auc_macro", df), F.lit(-1.0))
    bucket = guarded * 1_000 + F.greatest(F.lit(0.0), F.least(F.lit(999.0), F.floor((1 - auc) * 100)))
    ranked = running_totals(df, [], bucket, rank_order(df, tie), {"n": F.lit(1).cast("long")})
    return ranked.withColumn("model_rank", F.col("cum_n").cast("int")).drop("cum_n", "all_n")


def choose_primary(df: DataFrame, tie: str = "model") -> DataFrame:
    """The first model in ``rank_order``; no row where there is none."""
    return df.orderBy(*rank_order(df, tie)).limit(1)


def merge_summaries(classic: DataFrame, neural: DataFrame | None = None, tie: str = "model") -> DataFrame:
    """One primary flag; benchmark rows cannot win unless there is nothing else.

    Of rows that are equal in the whole order, one is flagged.
    """
    rows = classic if neural is None else classic.unionByName(neural, allowMissingColumns=True)
    numbered = materialize(rows.withColumn("_row", F.monotonically_increasing_id()), "summaries")
    comparable = F.coalesce(F.col("provenance") != "benchmark", F.lit(True))
    best = numbered.orderBy(F.desc(comparable), *rank_order(rows, tie), "_row").limit(1).select("_row").scalar()
    return numbered.withColumn("is_primary", F.col("_row") == best).drop("_row")


def summary_rows(metrics: DataFrame, primary: str | Column, provenance: str) -> DataFrame:
    """13-column summary with a note on missing metrics. ``primary`` is the winner's name."""
    checked = [n for n in S.METRIC_NAMES if n not in ("accuracy", "f1_macro")]
    values = {n: _clean(n, metrics) for n in S.METRIC_NAMES}
    missing = F.concat_ws(", ", *[F.when(values[n].isNull(), F.lit(n)) for n in checked])
    role = F.when(
        F.col("model") == primary, "Selected by stratified cross-validation."
    ).otherwise("Competing baseline under the same validation.")
    note = F.when(missing != "", F.concat(role, F.lit(" Missing metrics: "), missing, F.lit(".")))
    return metrics.select(
        "model",
        *[values[n].alias(n) for n in S.METRIC_NAMES],
        F.lit(False).alias("is_primary"),
        F.coalesce(note, role).alias("insight_summary"),
        F.lit(provenance).alias("provenance"),
    )


REQUIRED_BENCHMARK = ("accuracy", "f1_macro", "roc_auc_macro")


def benchmark_gate(df: DataFrame, model: str, set_id: str = "set_id") -> DataFrame:
    """One row: the model's metrics in the last well-formed set, or why it is unavailable.

    A set is well formed when all its rows name their model and have a parsable metric.
    """
    values = {n: _clean(n, df) for n in REQUIRED_BENCHMARK}
    mine = F.col("model") == model
    missing = F.concat_ws(", ", *[F.when(values[n].isNull(), F.lit(n)) for n in sorted(values)])
    usable = F.col("model").isNotNull() & F.coalesce(*values.values()).isNotNull()
    sets = df.groupBy(set_id).agg(
        F.min(usable).alias("_ok"),
        F.count_if(mine).alias("_hits"),
        F.min(F.when(mine, F.struct(*[values[n].alias(n) for n in values], missing.alias("_missing")))).alias("_m"),
    )
    last = sets.agg(
        F.count(F.lit(1)).alias("_sets"),
        F.max(F.when(F.col("_ok"), F.struct(set_id, "_hits", "_m"))).alias("_l"),
    )
    reason = (
        F.when(F.col("_sets") == 0, "no benchmark rows")
        .when(F.col("_l").isNull(), "no well-formed benchmark set")
        .when(F.col("_l._hits") == 0, f"no row for {model}")
        .when(F.col("_l._m._missing") != "", F.concat(F.lit("missing: "), F.col("_l._m._missing")))
    )
    return last.select(
        F.lit(model).alias("model"),
        reason.isNull().alias("available"),
        reason.alias("reason"),
        F.col(f"_l.{set_id}").alias(set_id),
        *[F.col(f"_l._m.{n}").alias(n) for n in values],
    )
