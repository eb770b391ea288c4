"""Registered queries over the driver tables, and the pipeline against its parts."""

from __future__ import annotations

import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from public_tokenizers import path
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from feedback_engine.llm import mixing, packing
from feedback_engine.llm import queries as Q
from tests.conftest import TABLES
from tests.llm.test_jaccard_join import brute_force


@pytest.mark.parametrize("key", sorted(Q.ORACLES))
def test_matches_sql(spark, sf_dir, key):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    ours, theirs = Q.QUERIES[key](spark, sf_dir).toPandas(), con.execute(Q.ORACLES[key]).df()
    columns = sorted(theirs.columns)
    assert sorted(ours.columns) == columns
    assert sorted(map(str, ours[columns].values.tolist())) == sorted(map(str, theirs[columns].values.tolist()))


def test_one_query_for_each_operator():
    names = [n for n in __spark_entry__.queries() if n.startswith("op") and n[2].isdigit()]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert "pipeline" in __spark_entry__.queries()


def test_token_counts_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").toPandas().sort_values("doc_id")
    docs["norm"] = docs.text.str.replace(r"[\x20\x09-\x0D]+", " ", regex=True)
    once = docs.drop_duplicates("norm")
    expected = Counter()
    for r in once.itertuples():
        expected[(r.source, r.lang)] += len(r.text.split())
    got = {(r.source, r.lang): r.tokens for r in Q.QUERIES["op8_token_counts"](spark, sf_dir).where("version = 'words'").collect()}
    assert got == dict(expected)


def test_pipeline_keeps_what_its_stages_keep(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, sizes = docs.columns, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = Q.materialize(stage(spark, docs, sf_dir), name)
        assert docs.columns == columns
        sizes.append(docs.count())
    assert sizes[0] == 200 and sizes[0] >= sizes[1] >= sizes[2]
    taken = Counter(r.doc_id for r in docs.select("doc_id").collect())
    assert max(taken.values()) <= 2
    packed = corpus_pipeline.packed(spark, docs, sf_dir).collect()
    assert Counter(r.doc_id for r in packed if r.piece == 0) == taken


def test_pipeline_stages_against_brute_force(spark, sf_dir):
    """Each stage on what its predecessor kept, recomputed by plain Python."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    known = Q.materialize(stages["language"](spark, documents, sf_dir), "known")
    rows = {r.doc_id: r for r in known.collect()}
    assert set(rows) <= {r.doc_id for r in documents.select("doc_id").collect()}

    once = Q.materialize(stages["exact_dedup"](spark, known, sf_dir), "once")
    first = {}
    for doc_id in sorted(rows):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", rows[doc_id].text or ""), doc_id)
    assert sorted(r.doc_id for r in once.collect()) == sorted(first.values())

    apart = Q.materialize(stages["near_dedup"](spark, once, sf_dir), "apart")
    kept = [i for i, _, component in brute_force([(i, rows[i].text) for i in first.values()], 5, 75) if i == component]
    assert sorted(r.doc_id for r in apart.collect()) == sorted(kept)

    mixed = Q.materialize(stages["mixture"](spark, apart, sf_dir), "mixed")
    taken = Counter(r.doc_id for r in mixed.collect())
    sizes = {i: len(re.findall(r"[^\x20\x09-\x0D]+", rows[i].text or "")) for i in kept}
    wanted = {r.doc_id: r for r in mixing.mixed_counts(apart).collect()}
    assert all(taken[i] * sizes[i] == wanted[i].taken for i in kept if sizes[i])
    for source in {rows[i].source for i in kept}:
        own = [i for i in kept if rows[i].source == source]
        assert abs(sum(taken[i] * sizes[i] for i in own) - wanted[own[0]].target) <= max(sizes[i] for i in own) / 2 + 1e-6

    coding = Tokenizer.from_file(path("byte_bpe_50k.json"))
    packed = stages["packing"](spark, mixed, sf_dir).collect()
    expected = Counter()
    for i, times in taken.items():
        ids = np.array([*coding.encode(rows[i].text or "", add_special_tokens=False).ids, 2], "<u4")
        for piece, (start, n) in enumerate(packing.cut(len(ids), 1024)):
            expected[(i, piece, start, n, zlib.crc32(ids[start : start + n].tobytes()))] += times
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed) == expected


def test_pipeline_stages_on_odd_tables(spark, sf_dir):
    """No rows at all; null ids, texts and sources; a row that repeats whole."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = documents.first().text
    odd = spark.createDataFrame(
        [(None, text, "en", None, 1), (1, None, None, "a", None), (2, "", "en", "a", 0), (3, text + " end", "en", None, 1), (3, text + " end", "en", None, 1)],
        documents.schema,
    )
    for table in (documents.where("false"), odd):
        docs = table
        for name, stage in corpus_pipeline.STAGES:
            docs = Q.materialize(stage(spark, docs, sf_dir), name)
            if name != "packing":
                assert docs.columns == documents.columns
        assert docs.count() == 0 or table is odd
