"""Driver tables as feedback records.

``reviews_view`` reads every order as one record, ``docs_view`` every document, ``vec_view``
every embedding. The mapping is a plain projection (plus dimension joins), so a report on a
view is a report on the whole table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedback_engine import schemas as S
from feedback_engine.functions import rules
from feedback_engine.functions.wordlists import UNCERTAIN_CONFIDENCE

# The review texts, picked by o_orderkey % 12 (the last two are blank and null).
PHRASES = (
    "Não consigo fazer login, acesso bloqueado!",
    "Aumentaram o limite do crédito, ótimo",
    "Fatura do cartão veio errada",
    "O pix caiu na hora, muito bom",
    "Cobrança de juros e taxa duplicada",
    "Atendimento demorado no chat www.exemplo.com/a",
    "Tentaram golpe com meus dados http://x.y/z",
    "Quero abrir conta nova",
    "O app trava e dá erro 24h por dia",
    "Tudo normal por aqui 12345",
    "   ",
    None,
)
STATUS = {"F": "Finalizada", "O": "Aberta"}
LOW_PRICE, HIGH_PRICE = 170_000.0, 335_000.0
CLUSTER_LABELS = (
    "Pix / transferências",
    "Cartão / fatura",
    "Conta bloqueada / acesso",
    "Empréstimo / crédito",
    "Outros temas",
    "Atendimento / suporte",
    "App / estabilidade",
    None,
)
CLUSTER_SIGNALS = (S.NEGATIVE, S.POSITIVE, S.MIXED, S.NEGATIVE, S.NEGATIVE, None, S.NEGATIVE, S.POSITIVE)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values: tuple, index: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), index.cast("int"))


def reviews_view(spark: SparkSession, sf_dir: str, region: bool = False) -> DataFrame:
    """Orders as gold sentiment records; ``region`` joins the customer's nation."""
    key = F.col("o_orderkey")
    source = (
        F.when(key % 10 < 6, S.REVIEW_SOURCE)
        .when(key % 10 < 8, S.VIDEO_SOURCE)
        .otherwise(S.COMPLAINT_SOURCE)
    )
    rating = F.when(~(key % 10).isin(6, 7), F.substring("o_orderpriority", 1, 1).cast("double"))
    price = F.col("o_totalprice")
    label = (
        F.when(key % 17 == 0, None)
        .when(price < LOW_PRICE, S.NEGATIVE)
        .when(price < HIGH_PRICE, S.NEUTRAL)
        .otherwise(S.POSITIVE)
    )
    confidence = F.when(key % 17 != 0, F.lit(0.4) + (key % 60) / F.lit(100.0))
    orders = read_table(spark, sf_dir, "orders")
    if region:
        customers = read_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
        nations = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
        orders = orders.join(customers, F.col("o_custkey") == F.col("c_custkey"), "left").join(
            nations, F.col("c_nationkey") == F.col("n_nationkey"), "left"
        )
    status = F.create_map(*[F.lit(x) for kv in STATUS.items() for x in kv])[F.col("o_orderstatus")]
    columns = {
        "record_id": F.concat(F.lit("o"), key.cast("string")),
        "source": source,
        "published_at": F.when(key % 29 != 0, F.col("o_orderdate").cast("timestamp")),
        "raw_text": _pick(PHRASES, key % 12),
        "rating": rating,
        "complaint_status": status,
        "problem_category": F.col("o_orderpriority"),
        "app_version": F.when(key % 10 < 6, F.concat(F.lit("7."), (key % 5).cast("string"))),
        "label": F.when(key % 10 < 6, rules.rating_to_label(rating)),
        "predicted_label": label,
        "confidence": confidence,
        "is_uncertain": confidence < UNCERTAIN_CONFIDENCE,
        "topic": F.when(F.col("o_custkey") % 8 != 7, F.concat(F.lit("Topico "), (F.col("o_custkey") % 8 + 1).cast("string"))),
        "cluster_id": (F.col("o_custkey") % 8).cast("int"),
    }
    if region:
        columns["region"] = F.col("n_name")
    return orders.select(*[value.alias(name) for name, value in columns.items()])


def themed_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = reviews_view(spark, sf_dir)
    return df.withColumn("theme", rules.classify_theme(F.coalesce("raw_text", F.lit(""))))


def clustered_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews with the attributes of their cluster."""
    c = F.col("cluster_id")
    return reviews_view(spark, sf_dir).withColumns(
        {
            "cluster_label": _pick(CLUSTER_LABELS, c),
            "cluster_signal": _pick(CLUSTER_SIGNALS, c),
            "cluster_example": F.when(c % 3 != 0, F.coalesce("raw_text", F.lit(""))),
            "cluster_action": rules.cluster_action(_pick(CLUSTER_LABELS, c), _pick(CLUSTER_SIGNALS, c)),
            "cluster_keywords": F.concat(F.lit("k"), c.cast("string")),
        }
    )


def scored_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews with one score per class, from the confidence of the predicted class."""
    df = reviews_view(spark, sf_dir, region=True)
    rest = (1 - F.col("confidence")) / 2
    return df.withColumns(
        {
            f"score_{short}": F.when(F.col("predicted_label") == label, F.col("confidence")).when(
                F.col("predicted_label").isNotNull(), rest
            )
            for label, short in zip(S.LABELS, ("neg", "neu", "pos"))
        }
    )


def docs_view(
    spark: SparkSession, sf_dir: str, label: bool = True, dates: bool = False, partitions: int | None = None
) -> DataFrame:
    """Documents as records; ``label`` joins the quality marks, ``dates`` the event times.

    ``partitions``: into so many tasks the documents are dealt. Work on text wants it where the table is one file of one row
    group, which Spark cannot split; tables of many files do without that shuffle.
    """
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    if partitions is not None:
        docs = docs.repartition(partitions, "doc_id")
    columns = {
        "record_id": F.concat(F.lit("d"), F.col("doc_id").cast("string")),
        "source": F.col("source"),
        "raw_text": F.col("text"),
        "region": F.col("lang"),
    }
    if label:
        marks = read_table(spark, sf_dir, "labels")
        docs = docs.join(marks, "doc_id", "left")
        columns["label"] = (
            F.when(F.col("toxic") == 1, S.NEGATIVE)
            .when(F.col("quality") == 1, S.POSITIVE)
            .when(F.col("quality").isNotNull(), S.NEUTRAL)
        )
    if dates:
        events = read_table(spark, sf_dir, "events").select(F.col("event_id").alias("doc_id"), "ts")
        docs = docs.join(events, "doc_id", "left")
        columns["published_at"] = F.col("ts").cast("timestamp")
    return docs.select(*[value.alias(name) for name, value in columns.items()])


def text_docs(spark: SparkSession, sf_dir: str, label: bool = True) -> DataFrame:
    """Documents for work on their text: the driver's table is one row group, so it is dealt over the cores."""
    return docs_view(spark, sf_dir, label, partitions=spark.sparkContext.defaultParallelism)


def vec_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "embeddings").select(
        F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("record_id"), "embedding", "label"
    )
