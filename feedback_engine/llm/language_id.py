"""Language identification by Bayesian evidence fusion.

Four kinds of evidence meet in one posterior: the text's likelihood under a naive Bayes model of byte trigrams, the
language that markup or metadata declares, the address suffix, and the host. The model is trained on a bounded sample
of labelled rows. Everything else is counted over all rows by grouped aggregation: how often a language is declared
as another, and the languages of hosts. A host's prior leans on its suffix's, that on all rows', the more the fewer
rows it has; a row's own text does not count for its own prior. ``und`` is one more class, with the same likelihood for every
trigram: text in no known language ends there and is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedback_engine.llm.common import join_counted, names
from feedback_engine.session import materialize

UNKNOWN = "und"
BUCKETS = 1 << 15
PER_LANGUAGE = 1_000  # labelled rows that train a language, at most
MOST_LANGUAGES = 64
CHUNK = 500_000  # bytes of one text scored at a time


def _trigrams(raw: bytes) -> np.ndarray:
    """Bucket of each trigram of lower-cased bytes, with a space at both ends; digits count as one sign."""
    data = np.frombuffer(b" " + raw.lower() + b" ", np.uint8).astype(np.uint32)
    data = np.where((data >= 48) & (data <= 57), 48, data).astype(np.uint32)
    if len(data) < 3:
        return np.zeros(0, np.uint32)
    mixed = (data[:-2] * np.uint32(65_599) + data[1:-1]) * np.uint32(65_599) + data[2:]
    mixed ^= mixed >> np.uint32(15)
    return (mixed * np.uint32(0x9E3779B1)) >> np.uint32(17)


@dataclass(frozen=True)
class TextModel:
    """languages, then ``und``; weights[bucket, class]: log-probability of a trigram."""

    languages: tuple[str, ...]
    weights: np.ndarray

    @property
    def classes(self) -> tuple[str, ...]:
        return (*self.languages, UNKNOWN)


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> TextModel:
    """Naive Bayes from at most ``per_language`` whole texts of each of the MOST_LANGUAGES most frequent labels.

    Rows are chosen by a hash of all columns, so any partitioning gives the same model; rows that repeat whole count once.
    Null labels and texts take no part. No labelled row at all gives a model that knows no language and rejects everything.
    """
    rows = labelled.select(
        F.lower(F.col(f"`{lang_col}`")).alias("lang"), F.col(f"`{text_col}`").alias("text"),
        F.xxhash64(*[F.col(f"`{c}`") for c in labelled.columns]).alias("h"),
    ).where("lang is not null and text is not null")
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MOST_LANGUAGES).collect()
    if not sizes:
        return TextModel((), np.full((BUCKETS, 1), -np.log(BUCKETS), np.float32))
    # by its hash a row falls into a share of the range that holds nine tenths of the rows wanted, so few are ranked at all
    share = F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], min(1.0, 0.9 * per_language / r["n"]) if r["n"] > per_language else 1.0)])
    place = F.shiftrightunsigned("h", 11)
    thinned = rows.withColumn("place", place).where(F.col("place") / float(1 << 53) < share[F.col("lang")])
    ranks = Window.partitionBy("lang").orderBy("place", "h")
    last = thinned.select("lang", "place", "h").distinct().withColumn("at", F.row_number().over(ranks)).where(F.col("at") <= per_language)
    cuts = last.groupBy("lang").agg(F.max(F.struct("place", "h")).alias("cut"))  # at most MOST_LANGUAGES rows
    sample = thinned.join(F.broadcast(cuts), "lang").where(F.struct("place", "h") <= F.col("cut"))
    sample = sample.dropDuplicates(["lang", "h"]).select("lang", "text")  # rows repeated whole train once

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = counts.setdefault(lang, np.zeros(BUCKETS, np.int64))
                own += np.bincount(_trigrams(text.encode()), minlength=BUCKETS)
        for lang, own in counts.items():
            used = np.flatnonzero(own)
            yield pa.record_batch(
                [pa.array([lang] * len(used), pa.string()), pa.array(used.astype(np.int32)), pa.array(own[used])], ["lang", "bucket", "n"]
            )

    summed = sample.mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    table = summed.toArrow()  # at most MOST_LANGUAGES x BUCKETS rows
    totals = {r["lang"]: np.zeros(BUCKETS) for r in sizes}
    found, buckets, counts = np.array(table["lang"].to_pylist(), object), table["bucket"].to_numpy(), table["n"].to_numpy()
    for lang, own in totals.items():
        own[buckets[found == lang]] = counts[found == lang]
    known = sorted(sorted(totals, key=lambda x: -totals[x].sum())[:MOST_LANGUAGES])
    columns = [np.log((totals[x] + 0.5) / (totals[x].sum() + 0.5 * BUCKETS)) for x in known]
    columns.append(np.full(BUCKETS, -np.log(BUCKETS)))
    return TextModel(tuple(known), np.stack(columns, axis=1).astype(np.float32))


def text_scores(docs: DataFrame, model: TextModel, text_col: str, keep: dict[str, Column], temper: float) -> DataFrame:
    """``keep`` columns, n (trigrams) and score: tempered log-likelihood of the text for each class.

    Neighbouring trigrams say much the same, so their sum is tempered. A text without a letter scores for ``und``.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model.weights)  # BUCKETS x (MOST_LANGUAGES + 1) at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = shared.value
        for batch in batches:
            scores, sizes = [], []
            for text in batch.column(batch.num_columns - 1):
                raw = (text.as_py() or "").encode()
                total = np.zeros(weights.shape[1])
                n = 0
                for at in range(0, len(raw), CHUNK):
                    grams = _trigrams(raw[at : at + CHUNK])
                    n += len(grams)
                    total += weights.take(grams, axis=0).sum(axis=0, dtype=np.float64)
                if not any(c > 127 or chr(c).isalpha() for c in set(raw)):
                    total[:] = -np.inf
                    total[-1] = 0.0
                scores.append(np.maximum(total * temper, -1e9).tolist())
                sizes.append(n)
            yield pa.record_batch(
                [*batch.columns[:-1], pa.array(sizes, pa.int64()), pa.array(scores, pa.list_(pa.float64()))],
                [*batch.schema.names[:-1], "n", "score"],
            )

    narrow = docs.select(*[c.alias(name) for name, c in keep.items()], F.col(f"`{text_col}`").alias("text"))
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in narrow.schema.fields[:-1])
    return narrow.mapInArrow(run, f"{fields}, n long, score array<double>")


def _softmax(scores: Column) -> Column:
    raised = F.transform(scores, lambda s: F.exp(s - F.array_max(scores)))
    return F.transform(raised, lambda r: r / F.aggregate(raised, F.lit(0.0), lambda a, b: a + b))


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def suffix_of(host: Column) -> Column:
    return F.regexp_extract(host, r"\.([a-z0-9-]+)$", 1)


def identify(
    docs: DataFrame,
    model: TextModel,
    id_col: str = "doc_id",
    text_col: str = "text",
    declared: Column | None = None,
    host: Column | None = None,
    suffix: Column | None = None,
    accept: tuple[str, ...] | None = None,
    lean: float = 20.0,
    temper: float = 0.25,
) -> DataFrame:
    """One row per input row: id, text_lang, lang, probability, kept.

    ``text_lang`` goes by the text alone, ``lang`` by all evidence. Null evidence says nothing: a null host leans on
    the suffix, a null suffix on all rows, a null declaration leaves the rest. Null, empty and letter-less texts are
    ``und``. ``kept``: the language is known and, if ``accept`` is given, among those. Ties go to the first class by
    name, ``und`` last. Rows that repeat an id are judged one by one. An empty table gives an empty table.
    """
    classes = model.classes
    none = F.lit(None).cast("string")
    said = F.lower(F.regexp_extract(declared, r"^\s*([A-Za-z]+)", 1)) if declared is not None else none
    known = F.when(said.isin(*classes), said).when(said.isNull() | (said == ""), none).otherwise("other")
    keep = {
        "id": F.col(f"`{id_col}`").cast("long"),
        "declared": known,
        "host": F.coalesce(host if host is not None else none, F.lit("")),
        "suffix": F.coalesce(suffix if suffix is not None else none, F.lit("")),
    }
    scored = text_scores(docs, model, text_col, keep, temper).withColumn("p", _softmax(F.col("score")))
    table = materialize(scored, "language-scores")
    sums = [F.sum(F.col("p")[i]).alias(f"s{i}") for i in range(len(classes))]
    packed = F.array(*[F.col(f"s{i}") for i in range(len(classes))])

    hosts = materialize(
        table.groupBy("host", "suffix").agg(*sums, F.count("*").alias("n_host")).select("host", "suffix", "n_host", packed.alias("by_host")),
        "host-languages",
    )
    explodes = [F.sum(F.col("by_host")[i]).alias(f"s{i}") for i in range(len(classes))]
    suffixes = hosts.groupBy("suffix").agg(*explodes, F.sum("n_host").alias("n_suffix")).select("suffix", "n_suffix", packed.alias("by_suffix"))
    everything = hosts.agg(*explodes, F.sum("n_host")).first()
    n_all = everything[-1] or 0
    overall = [((everything[i] or 0.0) + 1.0) / (n_all + len(classes)) for i in range(len(classes))]

    # what is declared for texts of each language: a table of at most (MOST_LANGUAGES + 2) ** 2 numbers
    sayings = [*classes, "other"]
    seen = {r["declared"]: r for r in table.where("declared is not null").groupBy("declared").agg(*sums).collect()}
    said_for = {d: [(seen[d][f"s{i}"] if d in seen else 0.0) for i in range(len(classes))] for d in sayings}
    per_class = [sum(said_for[d][i] for d in sayings) for i in range(len(classes))]
    log_said = {
        d: [float(np.log((said_for[d][i] + (1.0 if d == c else 0.05)) / (per_class[i] + 1.0 + 0.05 * len(sayings)))) for i, c in enumerate(classes)]
        for d in sayings
    }
    literal = {d: F.array(*[F.lit(x) for x in log_said[d]]) for d in seen}
    declared_score = F.array(*[F.lit(0.0)] * len(classes))
    for d, column in literal.items():
        declared_score = F.when(F.col("declared") == d, column).otherwise(declared_score)

    base = F.array(*[F.lit(x) for x in overall])
    by_suffix = hosts.join(suffixes, "suffix").withColumn(
        "lean_on",
        F.zip_with(base, F.zip_with("by_suffix", "by_host", lambda s, h: s - h), lambda b, s: (F.greatest(s, F.lit(0.0)) + lean * b) / (F.col("n_suffix") - F.col("n_host") + lean)),
    ).select("host", "suffix", "n_host", "by_host", "lean_on")
    joined = join_counted(table, materialize(by_suffix, "host-priors"), ["host", "suffix"], "n_host", n_all, F.col("id"))
    others = F.zip_with("by_host", "p", lambda h, p: F.greatest(h - p, F.lit(0.0)))
    prior = F.when(F.col("host") == "", F.col("lean_on")).otherwise(
        F.zip_with(others, "lean_on", lambda o, q: (o + lean * q) / (F.col("n_host") - 1 + lean))
    )
    total = F.zip_with(F.zip_with("score", prior, lambda s, q: s + F.log(q)), declared_score, lambda a, b: a + b)
    fused = joined.withColumn("posterior", _softmax(total))
    label = lambda scores: F.element_at(
        F.array(*map(F.lit, classes)), F.array_position(scores, F.array_max(scores)).cast("int")
    )
    lang = label(F.col("posterior"))
    accepted = lang != UNKNOWN if accept is None else lang.isin(*accept)
    return fused.select(
        F.col("id").alias(id_col), label(F.col("score")).alias("text_lang"), lang.alias("lang"),
        F.array_max("posterior").alias("probability"), accepted.alias("kept"),
    )


def keep_known(docs: DataFrame, model: TextModel, id_col: str = "doc_id", text_col: str = "text", **evidence) -> DataFrame:
    """``docs`` without the rows whose language is not known (or not accepted). Rows with a null id stay."""
    found = identify(docs, model, id_col, text_col, **evidence)
    gone_id = names(docs, "gone")["gone"]
    gone = materialize(found.where("not kept").select(F.col(id_col).alias(gone_id)).distinct(), "rejected")
    return docs.join(gone, F.col(f"`{id_col}`").cast("long") == F.col(gone_id), "left_anti")
