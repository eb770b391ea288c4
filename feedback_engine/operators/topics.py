"""Topic discovery: vectors, PCA, k-means, keywords, labels, signal, action, summary."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import replace

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedback_engine import schemas as S
from feedback_engine.functions import rules
from feedback_engine.functions.scalars import scaled_to_one
from feedback_engine.operators.decomposition import principal_directions, projected, projected_rows, sparse_parts
from feedback_engine.operators.features import (
    SPECS,
    TfidfSpec,
    cluster_keywords,
    fit_vocabulary,
    joined_tokens,
    stored_grams,
    weigh_tokens,
    write_vectors,
)
from feedback_engine.operators.prepare import conform
from feedback_engine.operators.ranking import keep_first, most_frequent, whole
from feedback_engine.session import discard, materialize, release

SEED = 42
FEW_CLUSTERS = 1_000  # means of at most 4,096 numbers each: 32 MB


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def pca_fit(rows: DataFrame, size: int, components: int = 24) -> tuple[np.ndarray, np.ndarray] | None:
    """(mean, directions) of stored ``rows`` (indices, values); none of two dimensions or two rows, which are too few.

    ``rows`` is read several times, once for each pass of the range finder.
    """
    n = rows.count()
    k = min(components, size, n - 1)
    return None if n <= 2 or size <= 2 or k < 2 else principal_directions(rows, size, n, k)[:2]


def pca_normalize(df: DataFrame, vector: str = "features", components: int = 24) -> DataFrame:
    """Replace the vector by an array column: centred PCA scores scaled to length one.

    ``df`` is read several times, once for each pass of the range finder; hand over a stored table.
    Two dimensions or two rows are too few: only the scaling is done.
    """
    size = df.select(F.unwrap_udt(vector).alias("u")).select(F.coalesce("u.size", F.size("u.values"))).first()[0]
    indices, entries = sparse_parts(vector)
    found = pca_fit(df.select(indices.alias("indices"), entries.alias("values")), size, components)
    values = projected(df, vector, *found) if found else vector_to_array(vector)
    return df.withColumn("_x", values).withColumn(vector, scaled_to_one(F.col("_x"))).drop("_x")


def cluster_fit(df: DataFrame, vector: str = "features", k: int = 8, seed: int = SEED) -> Callable[[DataFrame], DataFrame]:
    """k-means on an array column: function that adds ``cluster_id`` to rows. k never exceeds the rows of ``df``."""
    as_vector = array_to_vector(F.col(vector).cast("array<double>")).alias("_v")
    model = KMeans(k=min(max(1, k), df.count()), seed=seed, featuresCol="_v", predictionCol="cluster_id")
    if model.getK() == 1:  # MLlib wants two clusters
        return lambda rows: rows.withColumn("cluster_id", F.lit(0))
    fitted = model.fit(df.select(as_vector))
    return lambda rows: fitted.transform(rows.withColumn("_v", as_vector)).drop("_v")


def semantic_clusters(
    df: DataFrame, vector: str = "features", k: int = 8, seed: int = SEED
) -> DataFrame:
    """k-means on an array column; adds ``cluster_id``. k never exceeds the rows."""
    return cluster_fit(df, vector, k, seed)(df)


def cluster_shares(
    df: DataFrame, cluster: str = "cluster_id", sentiment: str = "predicted_label"
) -> DataFrame:
    """Rows and class shares per cluster; a missing class counts in the denominator."""
    return (
        df.where(F.col(cluster).isNotNull())
        .groupBy(cluster)
        .agg(
            F.count(F.lit(1)).alias("n"),
            *[
                F.avg(F.coalesce((F.col(sentiment) == label).cast("double"), F.lit(0.0))).alias(name)
                for label, name in (
                    (S.POSITIVE, "share_pos"),
                    (S.NEGATIVE, "share_neg"),
                    (S.NEUTRAL, "share_neu"),
                )
            ],
        )
    )


def dominant_source(df: DataFrame, cluster: str = "cluster_id") -> DataFrame:
    rows = df.where(F.col(cluster).isNotNull())
    source = F.coalesce("source", F.lit(S.UNKNOWN_SOURCE))
    return most_frequent(rows, [cluster], source, "dominant_source")


def representative_example(
    df: DataFrame,
    cluster: str = "cluster_id",
    vector: str = "features",
    key: str = "record_id",
    text: str = "clean_text",
) -> DataFrame:
    """Row with the highest dot product with its cluster's mean vector, ties by key.

    The means come from one aggregate (a vector per cluster). Up to ``FEW_CLUSTERS`` of them are
    broadcast, so that no cluster gathers in one task; more of them are joined by key.
    """
    rows = df.where(F.col(cluster).isNotNull()).select(
        cluster, key, text, F.col(vector).cast("array<double>").alias("_x")
    )
    means = materialize(
        rows.groupBy(cluster).agg(vector_to_array(Summarizer.mean(array_to_vector("_x"))).alias("_m")),
        "cluster-means",
    )
    few = means.count() <= FEW_CLUSTERS
    scored = rows.join(F.broadcast(means) if few else means, cluster).select(
        cluster, key, text, F.round(dot(F.col("_x"), F.col("_m")), 9).alias("similarity")
    )
    return keep_first(scored, [cluster], [F.desc("similarity"), F.col(key)])


def keyword_lists(
    df: DataFrame, cluster: str, text: str, top_n: int = 5, brand_terms: Sequence[str] = ()
) -> DataFrame:
    spec = replace(SPECS["cluster_keywords"], brand_terms=tuple(brand_terms))
    ranked = cluster_keywords(df, cluster, text, top_n, spec)
    ordered = F.sort_array(F.collect_list(F.struct("rank", "term")))  # top_n entries
    return ranked.groupBy(cluster).agg(F.transform(ordered, lambda x: x["term"]).alias("_keywords"))


def describe_clusters(
    df: DataFrame,
    cluster: str = "cluster_id",
    sentiment: str = "predicted_label",
    vector: str = "features",
    text: str = "clean_text",
    key: str = "record_id",
    brand_terms: Sequence[str] = (),
) -> DataFrame:
    """One row per cluster: size, shares, signal, keywords, label, action, source, example."""
    parts = cluster_shares(df, cluster, sentiment)
    for part in (
        keyword_lists(df, cluster, text, brand_terms=brand_terms),
        dominant_source(df, cluster),
        representative_example(df, cluster, vector, key, text),
    ):
        parts = parts.join(part, cluster, "left")
    keywords = F.coalesce("_keywords", F.array().cast("array<string>"))
    signal = rules.cluster_signal(F.col("share_pos"), F.col("share_neg"))
    named = parts.withColumn("_keywords", keywords).withColumn("cluster_signal", signal)
    name = rules.refine_topic_label(
        rules.topic_label(F.col("_keywords")), F.col("cluster_signal"), F.col("_keywords")
    )
    return named.withColumn("topic_name", name).select(
        cluster,
        "topic_name",
        F.array_join("_keywords", ", ").alias("keywords"),
        F.col("n").alias("n_records"),
        rules.predominant_label(
            F.col("share_pos"), F.col("share_neg"), F.col("share_neu")
        ).alias("predominant_label"),
        "dominant_source",
        "cluster_signal",
        "share_pos",
        "share_neg",
        "share_neu",
        rules.cluster_action(F.col("topic_name"), F.col("cluster_signal")).alias("suggested_action"),
        F.trim(F.col(text)).alias("representative_example"),
    )


def topic_summary(clusters: DataFrame, method: str) -> DataFrame:
    """Cluster rows sorted by size, signal, name and numbered from 1 (a row per cluster)."""
    order = [F.desc("n_records"), F.col("cluster_signal"), F.col("topic_name"), F.col("cluster_id")]
    numbered = clusters.withColumns(
        {
            "topic_id": F.row_number().over(whole().orderBy(*order)),
            "method": F.lit(method),
            "processed_at": F.current_timestamp(),
        }
    )
    return conform(numbered, S.TOPIC_SUMMARY)


SCATTERED = {
    "topic": "topic_name",
    "cluster_label": "topic_name",
    "cluster_keywords": "keywords",
    "cluster_signal": "cluster_signal",
    "cluster_action": "suggested_action",
    "cluster_example": "representative_example",
    "cluster_share_pos": "share_pos",
    "cluster_share_neg": "share_neg",
    "cluster_share_neu": "share_neu",
}


def scatter_clusters(df: DataFrame, clusters: DataFrame) -> DataFrame:
    """Write cluster attributes back to member rows; rows without a cluster get nulls."""
    dim = clusters.select("cluster_id", *[F.col(v).alias(k) for k, v in SCATTERED.items()])
    kept = [c for c in df.columns if c not in SCATTERED]
    return df.select(*kept).join(dim, "cluster_id", "left")


def topic_pipeline(
    df: DataFrame,
    k: int = 8,
    text: str = "clean_text",
    embedding: str | None = None,
    spec: TfidfSpec = SPECS["topic_fallback"],
    sentiment: str = "predicted_label",
    key: str = "record_id",
) -> tuple[DataFrame, DataFrame]:
    """Rows with cluster columns and the topic summary.

    Vectors come from an ``embedding`` column, else from TF-IDF. ``df`` is read once for the summary and again for the rows, whose
    clusters follow from their text alone; what was stored goes as soon as nothing reads it. The spec's brand terms are no keywords
    either. Rows without text stay unclustered; without any text the summary is empty.
    """
    keep = [c for c in df.columns if c not in (*SCATTERED, "cluster_id")]
    rows = df.select(*keep)
    blank = F.trim(F.coalesce(text, F.lit(""))) == ""
    filled, empty = rows.where(~blank), rows.where(blank)
    wanted = dict.fromkeys([key, "source", sentiment, text, *([embedding] if embedding else [])])
    stored = materialize(filled.select(*wanted), "topic-rows")
    release(df.sparkSession)
    if stored.isEmpty():
        nothing = filled.sparkSession.createDataFrame([], S.TOPIC_SUMMARY)
        columns = {k: F.lit(None).cast("double" if "share" in k else "string") for k in SCATTERED}
        return rows.withColumns({"cluster_id": F.lit(None).cast("int"), **columns}), nothing
    if embedding is None:
        tokens = stored_grams(stored, [], text, spec, "topic-tokens")
        vocabulary = fit_vocabulary(tokens, spec)
        indices, values, size, method = F.col("_idx"), F.col("_w"), len(vocabulary.terms), "tfidf_fallback"

        def vectorised(some: DataFrame) -> DataFrame:
            return weigh_tokens(joined_tokens(some, text, spec), vocabulary)

        vectors = materialize(weigh_tokens(tokens, vocabulary), "topic-vectors")
        discard(tokens)
    else:
        values, size, method = F.col(embedding).cast("array<double>"), stored.select(F.size(embedding)).first()[0], "embeddings"
        indices = F.when(F.size(values) > 0, F.sequence(F.lit(0), F.size(values) - 1)).otherwise(F.array().cast("array<int>"))

        def vectorised(some: DataFrame) -> DataFrame:
            return some

        vectors = stored.select(embedding)
    found = pca_fit(vectors.select(indices.alias("indices"), values.alias("values")), size)

    def reduced(some: DataFrame) -> DataFrame:
        if found:
            scored = projected_rows(some, indices, values, *found)
        else:
            places = F.sequence(F.lit(0), F.lit(size - 1)) if size else F.array().cast("array<int>")
            scored = some.withColumn(
                "_x", F.transform(places, lambda i: F.coalesce(F.get(values, F.array_position(indices, i).cast("int") - 1), F.lit(0.0)))
            )
        return scored.withColumn("features", scaled_to_one(F.col("_x"))).drop("_x", "_idx", "_w")

    seen = materialize(reduced(vectors).select("features"), "topic-reduced")
    if embedding is None:
        discard(vectors)
    clustered = cluster_fit(seen, k=k)
    assigned = materialize(clustered(reduced(vectorised(stored))), "topic-assigned")
    discard(stored, seen)
    clusters = materialize(
        describe_clusters(
            assigned, sentiment=sentiment, text=text, key=key, brand_terms=spec.brand_terms
        ),
        "topic-clusters",
    )
    members = clustered(reduced(vectorised(filled))).select(*keep, "cluster_id").unionByName(empty, allowMissingColumns=True)
    return scatter_clusters(members, clusters), topic_summary(clusters, method)


def scatter_topic(df: DataFrame, assigned: DataFrame, key: str = "record_id") -> DataFrame:
    """All rows with ``topic``, the name of their cluster; rows outside ``assigned`` (key, cluster_id) have none."""
    named = assigned.select(key, F.format_string("Topico %d", F.col("cluster_id") + 1).alias("topic"))
    return df.drop("topic").join(named, key, "left")


def short_summary(summary: DataFrame) -> DataFrame:
    return summary.select(*S.TOPIC_SUMMARY_SHORT)


def negative_topics(
    df: DataFrame,
    k: int = 6,
    text: str = "clean_text",
    sentiment: str = "predicted_label",
    key: str = "record_id",
    top_n: int = 8,
    spec: TfidfSpec = SPECS["negative_topics"],
    seed: int = SEED,
) -> tuple[DataFrame, DataFrame]:
    """k-means over the negative rows only; topics named by number.

    Returns all rows with ``topic`` and the short summary. The keywords are the terms with the
    largest weight in a cluster centre (k small arrays).
    """
    spark = df.sparkSession
    negative = df.where(F.col(sentiment) == S.NEGATIVE).select(key, "source", text)
    short = [f for f in S.TOPIC_SUMMARY if f.name in S.TOPIC_SUMMARY_SHORT]
    empty = spark.createDataFrame([], S.TOPIC_SUMMARY).select(*S.TOPIC_SUMMARY_SHORT)
    n = negative.count()
    if n == 0:
        return df.withColumn("topic", F.lit(None).cast("string")), empty
    vectors, vocabulary = write_vectors(negative, text, spec, "negative-vectors")
    clusters = min(k, n)
    if clusters == 1:
        centres = [vectors.select(Summarizer.mean(F.col("features")).alias("m")).first()["m"].toArray()]
        assigned = vectors.withColumn("cluster_id", F.lit(0))
    else:
        model = KMeans(k=clusters, seed=seed, featuresCol="features", predictionCol="cluster_id").fit(vectors)
        centres, assigned = model.clusterCenters(), model.transform(vectors)
    terms = vocabulary.terms
    keywords = [
        (i, ", ".join(t for _, t in sorted((-w, t) for w, t in zip(centre, terms))[:top_n]))
        for i, centre in enumerate(centres)
    ]
    words = spark.createDataFrame(keywords, "cluster_id int, keywords string")
    assigned = materialize(assigned.select(key, "source", "cluster_id"), "negative-assigned")
    sizes = assigned.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n_records"))
    summary = (
        sizes.join(words, "cluster_id")
        .join(most_frequent(assigned, ["cluster_id"], F.col("source"), "dominant_source"), "cluster_id", "left")
        .withColumns(
            {
                "topic_id": F.col("cluster_id") + 1,
                "topic_name": F.format_string("Topico %d", F.col("cluster_id") + 1),
                "predominant_label": F.lit(S.NEGATIVE),
                "processed_at": F.current_timestamp(),
            }
        )
    )
    return scatter_topic(df, assigned, key), summary.select(*[F.col(f.name).cast(f.dataType) for f in short]).select(*S.TOPIC_SUMMARY_SHORT)
