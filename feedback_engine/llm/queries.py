"""The dealt operators over the given tables, and the pipeline: query name -> function, and SQL twins."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from feedback_engine.llm import (
    alignment,
    ann,
    collocations,
    exact_dedup,
    jaccard_join,
    language_id,
    licenses,
    main_text,
    mixing,
    near_dedup,
    oracles,
    packing,
    pii,
    token_counts,
)
from feedback_engine.llm.common import semi_by_id, ship_code
from feedback_engine.plans.adapters import read_table
from feedback_engine.session import materialize, scratch_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(key: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(query: Query) -> Query:
        @wraps(query)
        def shipped(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_code(spark)
            return query(spark, sf_dir)

        QUERIES[key] = shipped
        if sql is not None:
            ORACLES[key] = sql
        return shipped

    return add


@register("op1_permutation_index")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(read_table(spark, sf_dir, "embeddings"))


@register("op2_minhash_near_dedup")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(read_table(spark, sf_dir, "documents"))


@register("op3_license_scan")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read_table(spark, sf_dir, "documents"))


@register(
    "op4_exact_dedup",
    r"""
    WITH normalised AS (
        SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
        FROM documents
    ), grouped AS (
        SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM normalised GROUP BY text_sha256
    )
    SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256
    FROM normalised JOIN grouped USING (text_sha256)
    """,
)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(read_table(spark, sf_dir, "documents"))


@register("op5_html_main_text")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.extract(read_table(spark, sf_dir, "pages"))


@register("op6_personal_data")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(read_table(spark, sf_dir, "documents"))


@register("op7_best_fit_packing")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"), packing.public_vocabulary())


@register("op8_token_counts")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents are inserted, their exact copies deleted; the second batch is committed twice and counts once."""
    docs = read_table(spark, sf_dir, "documents")
    vocabularies = {"byte_bpe_50k": packing.public_vocabulary()}
    rollup = token_counts.Rollup(spark, scratch_path(spark, "token-rollup"))
    rollup.commit("load", token_counts.delta(token_counts.counted(docs, vocabularies), 1))
    copies = materialize(exact_dedup.exact_duplicates(docs).where("not kept").select("doc_id"), "copies")
    gone = semi_by_id(docs, copies, "doc_id", copies.count())
    removed = materialize(token_counts.delta(token_counts.counted(gone, vocabularies), -1), "removed")
    for _ in range(2):
        rollup.commit("exact-copies", removed)
    return rollup.totals()


@register("op9_source_mixing")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed_counts(read_table(spark, sf_dir, "documents"))


@register("op10_language_id")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return language_id.identify(docs, language_id.train(docs), declared=F.col("lang"), host=F.col("source"))


@register("pages_language_id")
def op10_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = language_id.train(read_table(spark, sf_dir, "documents"))
    bare = F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", " ")
    pages = read_table(spark, sf_dir, "pages").withColumn("text", bare)
    declared = F.regexp_extract("html", r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]+)", 1)
    host = language_id.host_of(F.col("url"))
    return language_id.identify(pages, model, "page_id", declared=declared, host=host, suffix=language_id.suffix_of(host))


@register("op11_phrase_collocations", oracles.COLLOCATIONS)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(read_table(spark, sf_dir, "documents"))


@register("op12_tokenizer_alignment")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.aligned(read_table(spark, sf_dir, "documents"), alignment.public_tokenizers())


@register("op13_ngram_jaccard_join")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similar_documents(read_table(spark, sf_dir, "documents"))


@register("license_base", oracles.LICENSE_BASE)
def license_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op3 finds without the method's own labels; -1 where there is no place."""
    places = {c: F.coalesce(c, F.lit(-1)) for c in ("first_word", "last_word")}
    return op3(spark, sf_dir).drop("labels", "score").withColumns(places)


@register("personal_data_counts", oracles.PERSONAL_DATA_COUNTS)
def personal_data_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6's counts of plain identifiers."""
    return op6(spark, sf_dir).select("doc_id", "n_email", "n_ip", "n_card", "n_phone")


@register("mixing_targets", oracles.MIXING_TARGETS)
def mixing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9's sizes and targets, without the words drawn."""
    return op9(spark, sf_dir).select("doc_id", "size", "source_size", F.round("target", 6).alias("target"))


QUERIES["pipeline"] = corpus_pipeline.run
