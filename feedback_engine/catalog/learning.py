"""Features, folds, metrics, classifiers and topics."""

from __future__ import annotations

from dataclasses import replace

from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from feedback_engine import schemas as S
from feedback_engine.catalog import register
from feedback_engine.catalog import sqltext as Q
from feedback_engine.catalog.ordering import METRICS, RANK_ORDER, metric_table
from feedback_engine.functions import scalars, text
from feedback_engine.functions import wordlists as W
from feedback_engine.operators import features as FT
from feedback_engine.operators import metrics as M
from feedback_engine.operators import models, sampling, topics
from feedback_engine.operators import prepare as P
from feedback_engine.plans.adapters import docs_view, read_table, reviews_view, scored_reviews, text_docs, vec_view


def clean_docs(spark, sf_dir, label: bool = True):
    df = text_docs(spark, sf_dir, label)
    return df.withColumn("clean_text", text.clean_text(F.col("raw_text")))


CLEAN = f"""WITH {Q.docs()}, cleaned AS (SELECT *, {Q.clean_tokens("raw_text")} AS tok FROM docs)"""


# ---- features ------------------------------------------------------------------------------


def _grams_cte(spec: FT.TfidfSpec, rows: str = "cleaned", by: str = "'all'") -> str:
    """CTEs ``tk`` (kept tokens), ``gr`` (doc, term, tf) in SQL."""
    kept = "tok"
    if spec.min_chars > 1:
        kept = f"list_filter(tok, lambda w: length(w) >= {spec.min_chars})"
    if spec.stopwords:
        kept = Q.drop_words(kept, W.STOPWORD_PROFILES[spec.stopwords] | set(spec.brand_terms))
    return f"""tk AS (SELECT record_id, {by} AS grp, {kept} AS k FROM {rows}),
    al AS (SELECT record_id, grp, unnest(list_concat(k, list_transform(list_zip(k[:-2], k[2:]),
        lambda p: p[1] || ' ' || p[2]))) AS term FROM tk),
    gr AS (SELECT record_id, grp, term, count(*) AS tf FROM al GROUP BY ALL)"""


def _tfidf_cte(spec: FT.TfidfSpec, rows: str = "cleaned", by: str = "'all'") -> str:
    tf = "1 + ln(tf)" if spec.sublinear else "tf"
    return f"""{_grams_cte(spec, rows, by)},
    nn AS (SELECT grp, count(*) AS n_docs FROM tk GROUP BY grp),
    st AS (SELECT grp, term, count(*) AS df, sum(tf) AS cf FROM gr GROUP BY ALL),
    vo AS (SELECT grp, term, ln((1 + n_docs) / (1 + df)) + 1 AS idf FROM st JOIN nn USING (grp)
      WHERE df >= {spec.min_df} AND df <= {spec.max_df} * n_docs
      QUALIFY row_number() OVER (PARTITION BY grp ORDER BY cf DESC, term) <= {spec.max_features}),
    ww AS (SELECT record_id, grp, term, ({tf}) * idf AS w FROM gr JOIN vo USING (grp, term)),
    tfidf AS (SELECT record_id, grp, term, w / sqrt(sum(w * w) OVER (PARTITION BY grp, record_id)) AS weight FROM ww)"""


@register(
    "ml_ngrams",
    f"{CLEAN}, {_grams_cte(FT.SPECS['topic_fallback'])} SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM gr GROUP BY term",
)
def ngrams(spark, sf_dir):
    return FT.term_statistics(clean_docs(spark, sf_dir, label=False), "clean_text", FT.SPECS["topic_fallback"])


def _register_tfidf(key: str, name: str) -> None:
    spec = FT.SPECS[name]
    sql = f"{CLEAN}, {_tfidf_cte(spec)} SELECT record_id, term, {Q.r6('weight')} AS weight FROM tfidf"

    @register(key, sql)
    def tfidf(spark, sf_dir):
        return FT.tfidf_long(clean_docs(spark, sf_dir, label=False), "record_id", "clean_text", spec)


_register_tfidf("ml_tfidf_train", "sentiment")
_register_tfidf("ml_tfidf_variants_baseline", "baseline")
_register_tfidf("ml_tfidf_variants_experiment", "experiment")
_register_tfidf("ml_tfidf_variants_topics", "topic_fallback")


@register(
    "ml_tfidf_variants_negatives",
    f"""{CLEAN}, negatives AS (SELECT * FROM cleaned WHERE label = 'Negativo'),
    {_tfidf_cte(FT.SPECS["negative_topics"], "negatives")} SELECT record_id, term, {Q.r6('weight')} AS weight FROM tfidf""",
)
def tfidf_negatives(spark, sf_dir):
    negatives = clean_docs(spark, sf_dir).where(F.col("label") == S.NEGATIVE)
    return FT.tfidf_long(negatives, "record_id", "clean_text", FT.SPECS["negative_topics"])


@register(
    "ml_tfidf_variants",
    f"""{CLEAN}, {_tfidf_cte(FT.SPECS["cluster_keywords"], by="region")}
    SELECT record_id, grp AS region, term, {Q.r6('weight')} AS weight FROM tfidf""",
)
def tfidf_by_group(spark, sf_dir):
    """One fit per language in a single pass."""
    docs = clean_docs(spark, sf_dir, label=False)
    return FT.tfidf_long(docs, "record_id", "clean_text", FT.SPECS["cluster_keywords"], by="region")


BRANDED = replace(FT.SPECS["topic_fallback"], brand_terms=("menton", "ntble", "thhein"))


@register(
    "ml_brand_terms",
    f"{CLEAN}, {_tfidf_cte(BRANDED)} SELECT record_id, term, {Q.r6('weight')} AS weight FROM tfidf",
)
def brand_terms(spark, sf_dir):
    """The topic terms without the caller's brand words."""
    return FT.tfidf_long(clean_docs(spark, sf_dir, label=False), "record_id", "clean_text", BRANDED)


@register(
    "ml_cluster_keywords",
    f"""{CLEAN}, filled AS (SELECT * FROM cleaned WHERE len(tok) > 0), {_tfidf_cte(FT.SPECS["cluster_keywords"], "filled", "source")},
    sc AS (SELECT grp, term, round(sum(weight) / n_docs, 9) AS score FROM tfidf JOIN nn USING (grp) GROUP BY grp, term, n_docs)
    SELECT grp AS source, term, row_number() OVER (PARTITION BY grp ORDER BY score DESC, term) AS rank, {Q.r6("score")} AS score
    FROM sc QUALIFY rank <= 5""",
)
def cluster_keywords(spark, sf_dir):
    return FT.cluster_keywords(clean_docs(spark, sf_dir, label=False), "source", "clean_text")


# ---- weights, folds, samples ---------------------------------------------------------------

LABELS_ONLY = f"WITH {Q.docs()}, l AS (SELECT record_id, label FROM docs WHERE label IS NOT NULL)"
_RANK = "row_number() OVER (PARTITION BY label ORDER BY md5(record_id || '42'), record_id)"


def labels_only(spark, sf_dir):
    return docs_view(spark, sf_dir).select("record_id", "label")


@register(
    "ml_class_weights",
    f"""{LABELS_ONLY}, c AS (SELECT label, count(*) AS n FROM l GROUP BY label)
    SELECT label, n, {Q.r6("sum(n) OVER () / (count(*) OVER () * n)")} AS weight FROM c""",
)
def class_weights(spark, sf_dir):
    return sampling.class_weights(labels_only(spark, sf_dir))


@register(
    "ml_label_index",
    f"{LABELS_ONLY} SELECT record_id, CASE label WHEN 'Negativo' THEN 0 WHEN 'Neutro' THEN 1 ELSE 2 END AS idx, label AS back FROM l",
)
def label_index(spark, sf_dir):
    rows = labels_only(spark, sf_dir).where(F.col("label").isNotNull())
    indexed = rows.select("record_id", scalars.label_index(F.col("label")).alias("idx"))
    return indexed.withColumn("back", scalars.index_label(F.col("idx")))


@register(
    "ml_stratified_kfold",
    f"""{LABELS_ONLY}, k AS (SELECT greatest(2, least(5, min(n))) AS k FROM (SELECT count(*) AS n FROM l GROUP BY label))
    SELECT record_id, label, ({_RANK} - 1) % (SELECT k FROM k) AS fold FROM l""",
)
def stratified_kfold(spark, sf_dir):
    return sampling.stratified_kfold(labels_only(spark, sf_dir))


@register(
    "ml_stratified_split",
    f"""{LABELS_ONLY}, r AS (SELECT *, {_RANK} / CAST(count(*) OVER (PARTITION BY label) AS DOUBLE) AS x FROM l)
    SELECT record_id, label, CASE WHEN x <= CAST(0.7 AS DOUBLE) THEN 'train' WHEN x <= CAST(0.85 AS DOUBLE) THEN 'valid' ELSE 'test' END AS part FROM r""",
)
def stratified_split(spark, sf_dir):
    return sampling.stratified_split(labels_only(spark, sf_dir), sampling.THREE_WAY)


@register(
    "ml_stratified_split_two_way",
    f"""{LABELS_ONLY}, r AS (SELECT *, {_RANK} / CAST(count(*) OVER (PARTITION BY label) AS DOUBLE) AS x FROM l)
    SELECT record_id, label, CASE WHEN x <= CAST(0.8 AS DOUBLE) THEN 'train' ELSE 'test' END AS part FROM r""",
)
def stratified_split_two_way(spark, sf_dir):
    return sampling.stratified_split(labels_only(spark, sf_dir), {"train": 0.8, "test": 0.2})


@register(
    "ml_proportional_sample",
    f"""WITH {Q.reviews()}, l AS (SELECT record_id, predicted_label AS label FROM reviews WHERE predicted_label IS NOT NULL),
    r AS (SELECT *, {_RANK} AS rk, count(*) OVER (PARTITION BY label) AS n_c, count(*) OVER () AS n FROM l)
    SELECT record_id, label FROM r WHERE rk <= least(n_c, greatest(1, CAST(round_even(5000.0 * n_c / n, 0) AS BIGINT)))""",
)
def proportional_sample(spark, sf_dir):
    rows = reviews_view(spark, sf_dir).select("record_id", F.col("predicted_label").alias("label"))
    return sampling.proportional_sample(rows, 5000)


# ---- metrics -------------------------------------------------------------------------------

SCORED = f"""WITH {Q.reviews(region=True)}, scored AS (SELECT *, {", ".join(
    f"CASE WHEN predicted_label = '{label}' THEN confidence WHEN predicted_label IS NOT NULL THEN (1 - confidence) / 2 END AS score_{short}"
    for label, short in M.SHORT.items())} FROM reviews), ok AS (SELECT * FROM scored WHERE label IS NOT NULL)"""


@register(
    "ml_confusion_matrix",
    f"""{SCORED} SELECT label, {", ".join(f"count(*) FILTER (predicted_label = '{label}') AS as_{short}" for label, short in M.SHORT.items())}
    FROM ok WHERE predicted_label IS NOT NULL GROUP BY label""",
)
def confusion_matrix(spark, sf_dir):
    return M.confusion_matrix(reviews_view(spark, sf_dir))


def _report_sql(label: str) -> str:
    tp = f"count(*) FILTER (label = '{label}' AND predicted_label = '{label}')"
    sup, pre = f"count(*) FILTER (label = '{label}')", f"count(*) FILTER (predicted_label = '{label}')"
    return f"""SELECT '{label}' AS class, {Q.r6(Q.ratio(tp, pre))} AS precision, {Q.r6(Q.ratio(tp, sup))} AS recall,
      {Q.r6(Q.ratio(f"2 * {tp}", f"({sup} + {pre})"))} AS f1, {sup} AS support FROM ok WHERE predicted_label IS NOT NULL"""


@register("ml_class_report", f"{SCORED} " + " UNION ALL ".join(_report_sql(label) for label in S.LABELS))
def class_report(spark, sf_dir):
    return M.class_report(reviews_view(spark, sf_dir))


def _metric_sql(by: str, rows: str) -> str:
    cells = []
    for label, short in M.SHORT.items():
        cells += [
            f"count(*) FILTER (label = '{label}' AND predicted_label = '{label}') AS tp_{short}",
            f"count(*) FILTER (label = '{label}') AS s_{short}",
            f"count(*) FILTER (predicted_label = '{label}') AS p_{short}",
        ]
    shorts = list(M.SHORT.values())
    present = " + ".join(f"(s_{x} + p_{x} > 0)::INT" for x in shorts)
    macro = lambda num, den: Q.r6(
        "(" + " + ".join(Q.ratio(num.format(x), den.format(x)) for x in shorts) + f") / ({present})"
    )
    return f"""cm AS (SELECT {by} AS model, count(*) AS n_rows, {", ".join(cells)} FROM {rows}
        WHERE predicted_label IS NOT NULL GROUP BY 1),
      mr AS (SELECT model, n_rows, {Q.r6("(" + " + ".join(f"tp_{x}" for x in shorts) + ") / n_rows")} AS accuracy,
        {macro("tp_{0}", "p_{0}")} AS precision_macro, {macro("tp_{0}", "s_{0}")} AS recall_macro,
        {macro("2 * tp_{0}", "(s_{0} + p_{0})")} AS f1_macro,
        {", ".join(f"{Q.r6(Q.ratio(f'2 * tp_{x}', f'(s_{x} + p_{x})'))} AS f1_{x}" for x in shorts)} FROM cm)"""


@register("ml_metric_row", f"{SCORED}, {_metric_sql('region', 'ok')} SELECT * FROM mr")
def metric_row(spark, sf_dir):
    return M.metric_rows(scored_reviews(spark, sf_dir).withColumnRenamed("region", "model"))


def _auc_sql(by: str = "region") -> str:
    parts = " UNION ALL ".join(
        f"SELECT {by} AS model, '{label}' AS class, score_{short} AS s, label = '{label}' AS hit FROM ok"
        for label, short in M.SHORT.items()
    )
    return f"""lg AS ({parts}), ct AS (SELECT model, class, s, count(*) FILTER (hit) AS pos, count(*) FILTER (NOT hit) AS neg
        FROM lg WHERE s IS NOT NULL GROUP BY ALL),
      cu AS (SELECT *, sum(neg) OVER (PARTITION BY model, class ORDER BY s) - neg AS below FROM ct),
      au AS (SELECT model, class, CAST(sum(pos * (2 * below + neg)) AS DOUBLE) / nullif(2.0 * CAST(sum(pos) AS DOUBLE) * CAST(sum(neg) AS DOUBLE), 0) AS auc,
        sum(pos) AS support FROM cu GROUP BY ALL),
      ov AS (SELECT model, CASE WHEN count(auc) = 3 THEN avg(auc) END AS roc_auc_macro,
        CASE WHEN count(auc) = 3 THEN CAST(sum(auc * support) AS DOUBLE) / CAST(sum(support) AS DOUBLE) END AS roc_auc_weighted FROM au GROUP BY model)"""


@register(
    "ml_roc_auc_ovr",
    f"""{SCORED}, {_auc_sql()} SELECT model AS region, {Q.r6("roc_auc_macro")} AS roc_auc_macro,
    {Q.r6("roc_auc_weighted")} AS roc_auc_weighted FROM ov""",
)
def roc_auc_ovr(spark, sf_dir):
    return M.roc_auc_ovr(scored_reviews(spark, sf_dir), by=["region"])


@register(
    "ml_roc_auc_by_class",
    f"{SCORED}, {_auc_sql(chr(39) + 'all' + chr(39))} SELECT class, {Q.r6('auc')} AS auc, CAST(support AS BIGINT) AS support FROM au",
)
def roc_auc_by_class(spark, sf_dir):
    return M.roc_auc_by_class(scored_reviews(spark, sf_dir))


@register(
    "ml_roc_curve",
    f"""{SCORED}, {_auc_sql(chr(39) + 'all' + chr(39))} SELECT class, {Q.r6("s")} AS threshold,
    {Q.r6("sum(neg) OVER w / sum(neg) OVER (PARTITION BY class)")} AS fpr,
    {Q.r6("sum(pos) OVER w / sum(pos) OVER (PARTITION BY class)")} AS tpr
    FROM ct WINDOW w AS (PARTITION BY class ORDER BY s DESC)""",
)
def roc_curve(spark, sf_dir):
    return M.roc_curve(scored_reviews(spark, sf_dir))


@register("ml_choose_primary", f"WITH {METRICS} SELECT model FROM metric_rows ORDER BY {RANK_ORDER} LIMIT 1")
def choose_primary(spark, sf_dir):
    return M.choose_primary(metric_table(spark, sf_dir)).select("model")


MERGED = f"""WITH {METRICS}, mg AS (SELECT *, row_number() OVER (
    ORDER BY CASE WHEN provenance = 'benchmark' THEN 0 ELSE 1 END DESC, {RANK_ORDER}) = 1 AS is_primary FROM metric_rows)"""


@register("ml_merge_summaries", f"{MERGED} SELECT model, provenance, is_primary FROM mg")
def merge_summaries(spark, sf_dir):
    rows = metric_table(spark, sf_dir)
    neural = F.coalesce(F.col("provenance"), F.lit("")) == "bert_runtime"
    merged = M.merge_summaries(rows.where(~neural), rows.where(neural))
    return merged.select("model", "provenance", "is_primary")


@register("flt_primary_rows", f"{MERGED} SELECT model FROM mg WHERE is_primary")
def primary_rows(spark, sf_dir):
    return P.primary_rows(M.merge_summaries(metric_table(spark, sf_dir))).select("model")


@register("flt_benchmark_rows", f"WITH {METRICS} SELECT model FROM metric_rows WHERE provenance = 'benchmark'")
def benchmark_rows(spark, sf_dir):
    return P.benchmark_rows(metric_table(spark, sf_dir)).select("model")


@register(
    "ml_summary_row",
    f"""WITH {METRICS}, x AS (SELECT *, concat_ws(', ', 'precision_macro', CASE WHEN recall_macro IS NULL THEN 'recall_macro' END,
        CASE WHEN roc_auc_macro IS NULL THEN 'roc_auc_macro' END, 'roc_auc_weighted', 'f1_neg',
        CASE WHEN f1_neu IS NULL THEN 'f1_neu' END, 'f1_pos') AS missing FROM metric_rows)
    SELECT model, {Q.r6("accuracy")} AS accuracy, {Q.r6("f1_neu")} AS f1_neu, FALSE AS is_primary, 'classic_runtime' AS provenance,
      CASE WHEN model = 'm00001' THEN 'Selected by stratified cross-validation.' ELSE 'Competing baseline under the same validation.' END
      || ' Missing metrics: ' || missing || '.' AS insight_summary FROM x""",
)
def summary_row(spark, sf_dir):
    rows = M.summary_rows(metric_table(spark, sf_dir), "m00001", "classic_runtime")
    return rows.select("model", "accuracy", "f1_neu", "is_primary", "provenance", "insight_summary")


@register(
    "snk_prepare_gold_metrics",
    f"""WITH {METRICS} SELECT model, CASE WHEN provenance LIKE 'bert%' OR provenance = 'benchmark' THEN 'bertimbau' ELSE 'tfidf' END AS vectorizer,
    {Q.r6("accuracy")} AS accuracy, trim('from ' || model || ' ' || coalesce(provenance, '')) AS observations FROM metric_rows""",
)
def prepare_gold_metrics(spark, sf_dir):
    rows = metric_table(spark, sf_dir).withColumn("insight_summary", F.concat(F.lit(" from "), "model"))
    return P.prepare_gold_metrics(rows).select("model", "vectorizer", "accuracy", "observations")


@register(
    "ml_benchmark_gate",
    f"""WITH s AS (SELECT l_partkey AS set_id, l_suppkey, avg(l_discount) AS accuracy FROM lineitem GROUP BY ALL),
      g AS (SELECT set_id, accuracy FROM s WHERE l_suppkey = 1 AND set_id = (SELECT max(set_id) FROM s))
    SELECT 'm1' AS model, count(set_id) = 1 AS available, CASE WHEN count(set_id) = 0 THEN 'no row for m1' END AS reason,
      (SELECT max(set_id) FROM s) AS set_id, {Q.r6("max(accuracy)")} AS accuracy FROM g""",
)
def benchmark_gate(spark, sf_dir):
    rows = read_table(spark, sf_dir, "lineitem").groupBy(
        F.col("l_partkey").alias("set_id"), F.col("l_suppkey").alias("_s")
    ).agg(F.avg("l_discount").alias("accuracy")).select(
        "set_id",
        F.concat(F.lit("m"), F.col("_s").cast("string")).alias("model"),
        "accuracy",
        F.col("accuracy").alias("f1_macro"),
        F.col("accuracy").alias("roc_auc_macro"),
    )
    return M.benchmark_gate(rows, "m1").select("model", "available", "reason", "set_id", "accuracy")


# ---- classifiers (results checked by invariants, not by SQL) -------------------------------


@register("ml_cross_val_predict")
def cross_val_predict(spark, sf_dir):
    rows = P.labeled_rows(clean_docs(spark, sf_dir))
    return models.cross_val_predict(rows)


def _fitted(spark, sf_dir, name: str):
    """One candidate fitted on the labelled documents, scoring all of them."""
    docs = clean_docs(spark, sf_dir)
    train = models.build_training_set(P.labeled_rows(docs))
    scored = models.fit_candidate(name, train).score(docs.select("record_id", "label", "clean_text"))
    return scored.drop("clean_text")


@register("ml_logreg")
def logreg(spark, sf_dir):
    return _fitted(spark, sf_dir, "LogisticRegression")


@register("ml_linear_svc")
def linear_svc(spark, sf_dir):
    return _fitted(spark, sf_dir, "LinearSVC")


def _bayes_sql() -> str:
    """Multinomial naive Bayes in closed form: smoothed sums of the weights by class, scores of all documents."""
    spec = FT.SPECS["sentiment"]
    score = lambda short: Q.r6(f"max(p) FILTER (short = '{short}')")
    return f"""{CLEAN}, lab AS (SELECT * FROM cleaned WHERE label IN ({", ".join(f"'{x}'" for x in S.LABELS)})),
    {_tfidf_cte(spec, "lab")},
    ag AS (SELECT record_id, unnest(list_concat(tok, list_transform(list_zip(tok[:-2], tok[2:]), lambda p: p[1] || ' ' || p[2]))) AS term FROM cleaned),
    aw AS (SELECT record_id, term, (1 + ln(count(*))) * any_value(idf) AS w FROM ag JOIN vo USING (term) GROUP BY ALL),
    an AS (SELECT record_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY record_id)) AS x FROM aw),
    cls AS (SELECT label AS c, count(*) AS n FROM lab GROUP BY 1),
    sums AS (SELECT label AS c, term, sum(weight) AS s FROM tfidf JOIN lab USING (record_id) GROUP BY ALL),
    th AS (SELECT cls.c, vo.term, ln(coalesce(s, 0) + 0.35) - ln(sum(coalesce(s, 0) + 0.35) OVER (PARTITION BY cls.c)) AS lp
      FROM cls CROSS JOIN vo LEFT JOIN sums ON sums.c = cls.c AND sums.term = vo.term),
    mg AS (SELECT record_id, c, sum(x * lp) AS m FROM an JOIN th USING (term) GROUP BY ALL),
    raw AS (SELECT d.record_id, cls.c, ln(cls.n / (SELECT count(*) FROM lab)) + coalesce(m, 0) AS z
      FROM cleaned d CROSS JOIN cls LEFT JOIN mg ON mg.record_id = d.record_id AND mg.c = cls.c),
    ex AS (SELECT *, exp(z - max(z) OVER (PARTITION BY record_id)) AS e FROM raw),
    pr AS (SELECT *, e / sum(e) OVER (PARTITION BY record_id) AS p,
      CASE c {" ".join(f"WHEN '{label}' THEN '{short}'" for label, short in M.SHORT.items())} END AS short FROM ex),
    rk AS (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY p DESC, short) AS r FROM pr)
    SELECT record_id, any_value(d.label) AS label, max(c) FILTER (r = 1) AS predicted_label, {Q.r6("max(p)")} AS confidence,
      max(p) < 0.55 OR max(p) - max(p) FILTER (r = 2) < 0.15 AS is_uncertain,
      {", ".join(f"{score(short)} AS score_{short}" for short in M.SHORT.values())}
    FROM rk JOIN cleaned d USING (record_id) GROUP BY record_id"""


@register("ml_multinomial_nb", _bayes_sql())
def multinomial_nb(spark, sf_dir):
    scored = _fitted(spark, sf_dir, "MultinomialNB")
    return scored.withColumns({c: F.round(c, 6) for c in ("confidence", *M.SCORES.values())})


@register("ml_train_select_refit")
def train_select_refit(spark, sf_dir):
    trained = models.train_select_refit(clean_docs(spark, sf_dir))
    return trained.metrics.withColumn("winner", F.col("model") == trained.winner)


@register("ml_small_data_fallback")
def small_data_fallback(spark, sf_dir):
    trained = models.train_select_refit(clean_docs(spark, sf_dir), evaluation="split")
    return trained.metrics.withColumn("winner", F.col("model") == trained.winner)


@register("ml_score_table")
def score_table(spark, sf_dir):
    docs = clean_docs(spark, sf_dir)
    train = models.build_training_set(P.labeled_rows(docs))
    return models.score_table(docs, models.fit_candidate("MultinomialNB", train))


# ---- topics --------------------------------------------------------------------------------


@register(
    "ml_cluster_shares",
    f"""WITH {Q.reviews()} SELECT cluster_id, count(*) AS n, {", ".join(
        Q.r6(f"avg(CASE WHEN predicted_label = '{label}' THEN 1 ELSE 0 END)") + f" AS {name}"
        for label, name in (("Positivo", "share_pos"), ("Negativo", "share_neg"), ("Neutro", "share_neu")))} FROM reviews GROUP BY 1""",
)
def cluster_shares(spark, sf_dir):
    return topics.cluster_shares(reviews_view(spark, sf_dir))


@register(
    "ml_cluster_dominant_source",
    f"WITH {Q.reviews()} SELECT cluster_id, mode(source ORDER BY source) AS dominant_source FROM reviews GROUP BY 1",
)
def cluster_dominant_source(spark, sf_dir):
    return topics.dominant_source(reviews_view(spark, sf_dir))


@register(
    "ml_representative_example",
    """WITH e AS (SELECT vec_id, vec_id % 5 AS c, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
      m AS (SELECT c, i, avg(CAST(x AS DOUBLE)) AS mx FROM e GROUP BY ALL),
      s AS (SELECT e.c, vec_id, round(sum(CAST(x AS DOUBLE) * mx), 9) AS sim FROM e JOIN m ON m.c = e.c AND m.i = e.i GROUP BY ALL)
    SELECT c AS cluster_id, 'v' || vec_id AS record_id, 'text ' || vec_id AS clean_text FROM s
    QUALIFY row_number() OVER (PARTITION BY c ORDER BY sim DESC, 'v' || vec_id) = 1""",
)
def representative_example(spark, sf_dir):
    number = F.substring("record_id", 2, 20)
    rows = vec_view(spark, sf_dir).select(
        "record_id",
        "embedding",
        (number.cast("long") % 5).alias("cluster_id"),
        F.concat(F.lit("text "), number).alias("clean_text"),
    )
    return topics.representative_example(rows, vector="embedding").select("cluster_id", "record_id", "clean_text")


def _vectors(spark, sf_dir):
    return vec_view(spark, sf_dir).select(
        "record_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("features")
    )


@register(
    "ml_pca_normalize",
    """SELECT 'v' || vec_id AS record_id, least(24, len(embedding), (SELECT count(*) FROM embeddings) - 1)::INTEGER AS n_components,
    CAST(1 AS DOUBLE) AS squared_length FROM embeddings""",
)
def pca_normalize(spark, sf_dir):
    rows = topics.pca_normalize(_vectors(spark, sf_dir))
    return rows.select(
        "record_id",
        F.size("features").alias("n_components"),
        F.round(topics.dot(F.col("features"), F.col("features")), 6).alias("squared_length"),
    )


@register("ml_semantic_clusters")
def semantic_clusters(spark, sf_dir):
    reduced = topics.pca_normalize(_vectors(spark, sf_dir))
    return topics.semantic_clusters(reduced).select("record_id", "cluster_id")


@register("ml_negative_topics")
def negative_topics(spark, sf_dir):
    docs = clean_docs(spark, sf_dir).withColumnRenamed("label", "predicted_label")
    return topics.negative_topics(docs)[1].drop("processed_at")


@register("ml_topic_pipeline")
def topic_pipeline(spark, sf_dir):
    docs = clean_docs(spark, sf_dir).withColumnRenamed("label", "predicted_label")
    return topics.topic_pipeline(docs)[1].drop("processed_at")
