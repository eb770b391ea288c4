"""N-grams and TF-IDF.

Text is split into terms once and stored. A vocabulary has at most ``max_features`` terms, so it is small by definition; a
first count of the words and of hashed bigrams says which bigrams can be among them, and only these are counted by name.
Weighing then happens inside each row, no (document, term) row is shuffled. Vectors for training come from MLlib's count vectoriser, rows of terms from Arrow batches. Vocabularies of many
groups, too large to broadcast, are a table that the stored terms join.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedback_engine.functions.scalars import scaled_to_one
from feedback_engine.functions.text import drop_stopwords, stopword_set, tokenize
from feedback_engine.operators.linear import row_cutter, row_weigher
from feedback_engine.operators.ranking import explode_terms, head_per_group, head_per_group_large
from feedback_engine.session import discard, materialize, scratch_path

GRAMS = 1 << 20  # grams a task counts at a time
FEW_TERMS = 1 << 20  # terms of all groups' vocabularies that a task may hold
BUCKETS = 1 << 20  # counters that hashed bigrams fall into, in each of two ways; a power of two
MOST_COUNTED = (1 << 31) - 1  # counters of grouped bigrams stop here on their way to the tasks
SKETCH_PARTS = 64  # pieces in which a task hands on its counters


@dataclass(frozen=True)
class TfidfSpec:
    """Parameters of a TF-IDF fit. ``stopwords`` names a profile, removed before bigrams with ``brand_terms``."""

    max_features: int
    min_df: int = 1
    max_df: float = 1.0
    sublinear: bool = False
    min_chars: int = 1
    stopwords: str | None = None
    brand_terms: tuple[str, ...] = ()


# The six parameter sets in use.
SPECS = {
    "sentiment": TfidfSpec(25_000, min_df=2, max_df=0.95, sublinear=True),
    "baseline": TfidfSpec(5_000, min_chars=2),
    "negative_topics": TfidfSpec(3_000, min_chars=2),
    "experiment": TfidfSpec(20_000, min_df=2, min_chars=2),
    "topic_fallback": TfidfSpec(4_096, sublinear=True, stopwords="topic_cluster"),
    "cluster_keywords": TfidfSpec(3_000, sublinear=True, stopwords="topic_cluster"),
}


def ngrams(tokens: Column) -> Column:
    """Unigrams followed by bigrams."""
    pairs = F.transform(tokens, lambda t, i: F.concat(t, F.lit(" "), F.get(tokens, i + 1)))
    return F.concat(tokens, F.filter(pairs, lambda p: p.isNotNull()))


def spec_tokens(text: Column, spec: TfidfSpec) -> Column:
    tokens = tokenize(F.coalesce(text, F.lit("")))
    if spec.min_chars > 1:
        tokens = F.filter(tokens, lambda t: F.length(t) >= spec.min_chars)
    if spec.stopwords:
        tokens = drop_stopwords(tokens, stopword_set(spec.stopwords, spec.brand_terms))
    elif spec.brand_terms:
        tokens = drop_stopwords(tokens, spec.brand_terms)
    return tokens


def with_tokens(df: DataFrame, text: str, spec: TfidfSpec) -> DataFrame:
    """Add ``_tokens``: the words of the text, of which Arrow batches make the bigrams where they count them."""
    return df.withColumn("_tokens", spec_tokens(F.col(text), spec))


def joined_tokens(df: DataFrame, text: str, spec: TfidfSpec) -> DataFrame:
    """Add ``_tokens`` as one string, the words joined by blanks: tables and Arrow batches pass it on faster than a list of strings."""
    return df.withColumn("_tokens", F.array_join(spec_tokens(F.col(text), spec), " "))


def with_grams(df: DataFrame, text: str, spec: TfidfSpec) -> DataFrame:
    """Add ``_grams``: unigrams and bigrams of the text."""
    tokens = with_tokens(df, text, spec)
    return tokens.withColumn("_grams", ngrams(F.col("_tokens"))).drop("_tokens")


def term_counts(df: DataFrame, grams: str = "_grams") -> DataFrame:
    """Add ``_terms``: array of (term, tf) per row, from run lengths of the sorted grams."""
    ordered = df.withColumn("_s", F.sort_array(grams))
    starts = F.filter(
        F.transform("_s", lambda t, i: F.when((i == 0) | (t != F.get("_s", i - 1)), i)),
        lambda i: i.isNotNull(),
    )
    cut = ordered.withColumn("_b", starts)
    runs = F.transform(
        "_b",
        lambda s, k: F.struct(
            F.get("_s", s).alias("term"),
            (F.coalesce(F.get("_b", k + 1), F.size("_s")) - s).alias("tf"),
        ),
    )
    return cut.withColumn("_terms", runs).drop("_s", "_b")


def gram_column(stored: DataFrame) -> str:
    return "_tokens" if "_tokens" in stored.columns else "_grams"


def gram_table(terms: Sequence[str]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Words of the terms, the terms' codes by ``row_terms`` in ascending order, and the place of each in ``terms``."""
    parts = [t.split(" ") for t in terms]
    words = {w: i for i, w in enumerate(dict.fromkeys(w for p in parts for w in p))}
    n = len(words)
    codes = np.array([words[p[0]] if len(p) == 1 else n + words[p[0]] * n + words[p[1]] for p in parts], np.int64)
    order = np.argsort(codes, kind="stable")
    return pa.array(words, pa.string()), codes[order], order


def coded_words(entries: int) -> Callable:
    """Function of (Arrow batch whose last column holds the rows' words, as lists or joined, the only words wanted or None) -> pieces of
    whole rows: (the piece, row and code of each word, words by code). Unwanted words have code -1."""
    slices = row_cutter(entries)

    def pieces(batch, only):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        last = batch.columns[-1]
        joined = not pa.types.is_list(last.type)
        lengths = pc.add(pc.count_substring(last, " "), 1).to_numpy() if joined else np.diff(last.offsets.to_numpy())
        for own in slices(lengths):
            piece = batch.slice(own.start, own.stop - own.start)
            lists = piece.columns[-1]
            if joined:
                lists = pc.split_pattern(lists, " ")
            found = lists.flatten().cast(pa.string())
            of = np.repeat(np.arange(piece.num_rows), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
            if joined and pc.any(pc.equal(piece.columns[-1], "")).as_py():  # rows without words
                there = pc.not_equal(found, "")
                found, of = found.filter(there), of[there.to_numpy(zero_copy_only=False)]
            if only is None:
                coded = found.dictionary_encode()
                code, words = coded.indices.to_numpy(), coded.dictionary
            else:
                code, words = pc.fill_null(pc.index_in(found, value_set=only), -1).to_numpy(zero_copy_only=False), only
            yield piece, of, code.astype(np.int64), words

    return pieces


def counters_for(n_rows: int) -> int:
    return min(BUCKETS, max(1 << 12, 1 << (16 * n_rows).bit_length()))


def pair_buckets(size: int) -> Callable:
    """Function of (words, codes of the first and of the second words of pairs) -> two counters below ``size`` for each pair, the same
    in every task."""

    def buckets(words, first, second):
        import zlib

        import numpy as np
        import pyarrow as pa

        hashes = np.fromiter(map(zlib.crc32, words.cast(pa.binary()).to_pylist()), np.uint64, len(words))
        mixed = ((hashes << np.uint64(32))[first] | hashes[second]) * np.uint64(0x9E3779B97F4A7C15)
        mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return [((mixed >> np.uint64(shift)) & np.uint64(size - 1)).astype(np.int64) for shift in (40, 16)]

    return buckets


def row_terms(pairs: bool, size: int = BUCKETS) -> Callable:
    """Function of (Arrow batch whose last column holds the rows' words, ``gram_table`` of the only terms wanted or None, or else ``frequent``:
    the only words whose pairs are wanted or None for all, and marks of their pairs' ``size`` counters; or what these hold, and groups, the batch's first
    column, with the least that counts in each) -> pieces of whole rows: (the piece, row, code and count of each of its
    distinct terms, words by code).

    Terms are words and, with ``pairs``, two words that stand side by side: the n words have codes 0 to n - 1, words a and b
    n + a n + b. With a table, codes are the places of its terms. Terms are compared as codes, never as strings.
    """
    split, buckets = coded_words(GRAMS // 2 if pairs else GRAMS), pair_buckets(size)

    def pieces(batch, only, frequent=None):
        import numpy as np
        import pyarrow.compute as pc

        wanted, marks, *bounds = frequent or (only[0] if only else None, None)
        bounds = bounds[0] if bounds else None
        for piece, of, code, words in split(batch, wanted):
            n, known = len(words), code >= 0
            if pairs:
                both = (of[1:] == of[:-1]) & known[1:] & known[:-1]
                first, second, where = code[:-1][both], code[1:][both], of[1:][both]
                if marks is None:
                    of, code = np.concatenate([of[known], where]), np.concatenate([code[known], n + first * n + second])
                else:
                    one, two = buckets(words, first, second)
                    if bounds:
                        at = pc.index_in(piece.column(0), value_set=pc.cast(bounds[0], piece.column(0).type))
                        least = np.append(bounds[1], np.iinfo(np.int64).max)[pc.fill_null(at, -1).to_numpy(zero_copy_only=False)]
                        kept = (marks[0][one] >= least[where]) & (marks[1][two] >= least[where])
                    else:
                        kept = marks[0][one] & marks[1][two]
                    of, code = where[kept], n + first[kept] * n + second[kept]
            else:
                of, code = of[known], code[known]
            width = max(1, n + n * n if pairs else n)
            if only is not None:
                _, codes, places = only
                at = np.minimum(np.searchsorted(codes, code), max(0, len(codes) - 1))
                kept = codes[at] == code if len(codes) else np.zeros(len(code), bool)
                of, code, width = of[kept], at[kept], max(1, len(codes))
            distinct, counts = np.unique(of * width + code, return_counts=True)
            row, code = np.divmod(distinct, width)
            yield piece, row, code if only is None else places[code], counts, words

    return pieces


def gram_statistics(stored: DataFrame, by: str | None = None, frequent: tuple[pa.Array | None, np.ndarray] | None = None) -> DataFrame:
    """(by, term, df, cf) of stored ``_tokens`` or ``_grams``: a task counts some thousand rows' terms, a shuffle adds them up.

    ``frequent``: only bigrams of these words (None: of all) both of whose counters are marked (``frequent_buckets``), or hold as
    many (``bucket_counts``) as the bigram's group asks for.
    """
    column = gram_column(stored)
    rows = stored.select(*([by] if by else []), column)
    pieces = row_terms(column == "_tokens", frequent[1].shape[1] if frequent else BUCKETS)
    shared = stored.sparkSession.sparkContext.broadcast(frequent) if frequent else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            for piece, row, code, counts, words in pieces(batch, None, shared and shared.value):
                n, groups = len(words), None
                width = n + n * n
                if by:
                    coded = piece.column(0).dictionary_encode(null_encoding="encode")
                    groups = coded.dictionary
                    code = coded.indices.to_numpy()[row].astype(np.int64) * width + code
                found, at = np.unique(code, return_inverse=True)
                df, cf = np.bincount(at, minlength=len(found)).astype(np.int64), np.bincount(at, counts, len(found)).astype(np.int64)
                term = found % max(1, width)
                for own in (term < n, term >= n):
                    if not own.any():
                        continue
                    first, second = term[own], None
                    if first[0] >= n:
                        first, second = np.divmod(first - n, n)
                    spelled = words.take(pa.array(first))
                    if second is not None:
                        spelled = pc.binary_join_element_wise(spelled, words.take(pa.array(second)), " ")
                    yield pa.record_batch(
                        [*([groups.take(pa.array(found[own] // width))] if by else []), spelled, pa.array(df[own]), pa.array(cf[own])],
                        [*([by] if by else []), "term", "df", "cf"],
                    )

    group = f"`{by}` {stored.schema[by].dataType.simpleString()}, " if by else ""
    counted = rows.mapInArrow(run, f"{group}term string, df bigint, cf bigint")
    return counted.groupBy(*([by] if by else []), "term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))


def words_and_buckets(stored: DataFrame, by: str | None, size: int) -> tuple[DataFrame, DataFrame]:
    """(by, term, df, cf) of the words of stored ``_tokens``, and (part, sums): how many bigrams fall into each of ``size`` counters,
    in two ways, as pieces of 64-bit numbers. One pass; a task adds up its words and counters before it hands them on."""
    rows = stored.select(*([by] if by else []), "_tokens")
    pieces, buckets, names = coded_words(GRAMS // 2), pair_buckets(size), [*([by] if by else []), "term", "df", "cf", "part", "sums"]
    group = f"`{by}` {stored.schema[by].dataType.simpleString()}, " if by else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import pyarrow as pa

        def merged(held):
            added = pa.Table.from_batches(held).group_by(names[:-4], use_threads=False).aggregate([("df", "sum"), ("cf", "sum")])
            return added.rename_columns(names[:-2]).combine_chunks().to_batches()[0]

        def without_buckets(found):
            return pa.record_batch([*found.columns, pa.nulls(len(found), pa.int32()), pa.nulls(len(found), pa.binary())], names)

        sums, held = np.zeros((2, size), np.int64), []
        for batch in batches:
            for piece, of, code, words in pieces(batch, None):
                both = of[1:] == of[:-1]
                for own, at in zip(sums, buckets(words, code[:-1][both], code[1:][both])):
                    own += np.bincount(at, minlength=size)
                n, groups = max(1, len(words)), None
                distinct, counts = np.unique(of * n + code, return_counts=True)
                row, term = np.divmod(distinct, n)
                if by:
                    coded = piece.column(0).dictionary_encode(null_encoding="encode")
                    groups = coded.dictionary
                    term = coded.indices.to_numpy()[row].astype(np.int64) * n + term
                df, cf = np.bincount(term), np.bincount(term, counts)
                found = np.flatnonzero(df)
                if len(found):
                    held.append(pa.record_batch(
                        [*([groups.take(pa.array(found // n))] if by else []), words.take(pa.array(found % n)),
                         pa.array(df[found].astype(np.int64)), pa.array(cf[found].astype(np.int64))], names[:-2],
                    ))
                if sum(map(len, held)) > GRAMS:
                    held = [merged(held)]
                    if len(held[0]) > GRAMS // 2:
                        yield without_buckets(held.pop())
        if held:
            last = merged(held)
            yield without_buckets(last)
            cuts = [x.tobytes() for x in np.array_split(sums.ravel(), SKETCH_PARTS)]
            nothing = [pa.nulls(len(cuts), kind) for kind in last.schema.types]
            yield pa.record_batch([*nothing, pa.array(range(len(cuts)), pa.int32()), pa.array(cuts, pa.binary())], names)

    counted = materialize(rows.mapInArrow(run, f"{group}term string, df bigint, cf bigint, part int, sums binary"), "words-and-buckets")
    words = counted.where(F.col("term").isNotNull()).groupBy(*([by] if by else []), "term")
    return words.agg(F.sum("df").alias("df"), F.sum("cf").alias("cf")), counted.where(F.col("part").isNotNull()).select("part", "sums")


def bucket_counts(buckets: DataFrame, size: int) -> np.ndarray:
    """What the counters hold, up to the largest 32-bit number, one row of ``size`` for each way of counting."""
    most = MOST_COUNTED
    counts = _added_buckets(buckets, lambda x: np.minimum(x, most).astype(np.int32).tobytes())
    return np.concatenate([np.frombuffer(x, np.int32) for x in counts]).reshape(2, size) if counts else np.zeros((2, size), np.int32)


def frequent_buckets(buckets: DataFrame, size: int, least: int) -> np.ndarray:
    """Marks of the counters that hold ``least`` bigrams or more, one row of ``size`` for each way of counting. One bit each reaches the driver."""
    marks = _added_buckets(buckets, lambda x: np.packbits(x >= least).tobytes())
    marks = [np.unpackbits(np.frombuffer(x, np.uint8)).astype(bool) for x in marks]
    return np.concatenate(marks).reshape(2, size) if marks else np.zeros((2, size), bool)


def _added_buckets(buckets: DataFrame, told: Callable[[np.ndarray], bytes]) -> list[bytes]:
    """The tasks' counters added up, and what is ``told`` of each part, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import pyarrow as pa

        found: dict = {}
        for batch in batches:
            for part, sums in zip(batch.column(0).to_pylist(), batch.column(1)):
                found[part] = found.get(part, 0) + np.frombuffer(sums.as_buffer(), np.int64)
        yield pa.record_batch([pa.array(list(found), pa.int32()), pa.array([told(x) for x in found.values()], pa.binary())], ["part", "told"])

    dealt = buckets.repartition(min(SKETCH_PARTS, buckets.sparkSession.sparkContext.defaultParallelism), "part")
    return [r["told"] for r in sorted(dealt.mapInArrow(run, "part int, told binary").collect())]


def term_statistics(df: DataFrame, text: str, spec: TfidfSpec) -> DataFrame:
    """Document frequency and corpus frequency per term."""
    return gram_statistics(joined_tokens(df.select(text), text, spec).select("_tokens"))


def weighed_terms(stored: DataFrame, keys: Sequence[str], by: str | None, found: pa.Table, sublinear: bool) -> DataFrame:
    """(keys, by, term, weight) of stored ``_tokens`` by the vocabularies ``found`` (by, term, _idf), which every task holds."""
    names = [*keys, *([by] if by else [])]
    terms = pc.unique(found["term"]).cast(pa.string())
    groups = pc.unique(found[by]) if by else None
    place = pc.index_in(found["term"], value_set=terms).to_numpy()
    if by:
        place = pc.index_in(found[by], value_set=groups).to_numpy().astype(np.int64) * max(1, len(terms)) + place
    order = np.argsort(place)
    table = gram_table(terms.to_pylist())
    shared = stored.sparkSession.sparkContext.broadcast((terms, table, groups, place[order].astype(np.int64), found["_idf"].to_numpy()[order]))
    pieces = row_terms(True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        only, wanted, known, places, idf = shared.value
        for batch in batches:
            for piece, row, code, counts, _ in pieces(batch, wanted):
                key = code
                if by:
                    group = pc.fill_null(pc.index_in(piece.column(len(names) - 1), value_set=known), -1).to_numpy(zero_copy_only=False)
                    key = group[row].astype(np.int64) * max(1, len(only)) + code
                at = np.minimum(np.searchsorted(places, key), max(0, len(places) - 1))
                kept = places[at] == key if len(places) else np.zeros(len(key), bool)
                row, code, at, counts = row[kept], code[kept], at[kept], counts[kept]
                w = (1 + np.log(counts) if sublinear else counts) * idf[at]
                length = np.sqrt(np.bincount(row, w * w, piece.num_rows))
                rows = pa.array(row)
                yield pa.record_batch(
                    [*[piece.column(i).take(rows) for i in range(len(names))], only.take(pa.array(code)), pa.array(w / length[row], pa.float64())],
                    [*names, "term", "weight"],
                )

    kept = "".join(f"`{c}` {stored.schema[c].dataType.simpleString()}, " for c in names)
    return stored.select(*names, "_tokens").mapInArrow(run, f"{kept}term string, weight double")


@dataclass(frozen=True)
class Vocabulary:
    """Fitted terms and their inverse document frequencies, in index order."""

    spec: TfidfSpec
    terms: tuple[str, ...]
    idf: tuple[float, ...]
    _cache: dict = field(default_factory=dict, compare=False, repr=False)

    def counter(self) -> CountVectorizerModel:
        """The JVM lookup, built once per vocabulary."""
        if "counter" not in self._cache:
            self._cache["counter"] = CountVectorizerModel.from_vocabulary(
                list(self.terms), inputCol="_grams", outputCol="_tf"
            )
        return self._cache["counter"]


def literal_array(values: Sequence, element: str) -> Column:
    """A long constant array as one folded literal instead of one expression per element."""
    return F.from_json(F.lit(json.dumps(list(values))), f"array<{element}>")


def fit_vocabulary(stored: DataFrame, spec: TfidfSpec) -> Vocabulary:
    """Terms of stored rows with min_df <= df <= max_df·N, the most frequent first, ties by term."""
    return left_out_vocabularies(stored, spec, None, [None], {0: stored.count()})[0]


def weigh_tokens(rows: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """Replace joined ``_tokens`` by ``_idx`` and ``_w``, as ``weigh_grams`` does with spelled grams."""
    keep = [c for c in rows.columns if c != "_tokens"]
    shared = rows.sparkSession.sparkContext.broadcast((gram_table(vocabulary.terms), np.array(vocabulary.idf)))
    pieces, weigh = row_terms(True), row_weigher(vocabulary.spec.sublinear)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import pyarrow as pa

        table, idf = shared.value
        for batch in batches:
            for piece, row, place, counts, _ in pieces(batch, table):
                order = np.lexsort((place, row))
                of, at, x = weigh(row[order], piece.num_rows, place[order], counts[order], np.arange(len(idf)), idf)
                edges = pa.array(np.append(0, np.cumsum(np.bincount(of, minlength=piece.num_rows))).astype(np.int32))
                lists = [pa.ListArray.from_arrays(edges, pa.array(values)) for values in (at.astype(np.int32), x)]
                yield pa.record_batch([*piece.columns[:-1], *lists], [*keep, "_idx", "_w"])

    found = [T.StructField("_idx", T.ArrayType(T.IntegerType())), T.StructField("_w", T.ArrayType(T.DoubleType()))]
    schema = T.StructType([*(rows.schema[c] for c in keep), *found])
    return rows.select(*keep, "_tokens").mapInArrow(run, schema)


def weigh_grams(rows: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """Replace ``_grams`` by ``_idx`` and ``_w``: indices and L2-normalised TF-IDF weights of the row's terms."""
    spec = vocabulary.spec
    if not vocabulary.terms:
        empty = F.array().cast
        return rows.withColumns({"_idx": empty("array<int>"), "_w": empty("array<double>")}).drop("_grams")
    counter = vocabulary.counter()
    idf = literal_array(vocabulary.idf, "double")
    counted = counter.transform(rows).withColumn("_u", F.unwrap_udt("_tf"))

    def weight(tf: Column, index: Column) -> Column:
        damped = 1 + F.log(tf) if spec.sublinear else tf
        return damped * F.get(idf, index)

    raw = counted.select(
        *[c for c in rows.columns if c != "_grams"],
        F.col("_u.indices").alias("_idx"),
        F.zip_with("_u.values", "_u.indices", weight).alias("_raw"),
    )
    return raw.withColumn("_w", scaled_to_one(F.col("_raw"))).drop("_raw")


def group_weights(
    df: DataFrame, keys: Sequence[str], text: str, spec: TfidfSpec, by: str
) -> tuple[DataFrame, DataFrame]:
    """(keys, by, term, weight), each group fitted on its own, and the groups' sizes (by, _n).

    The text is split once and stored. Vocabularies of up to ``FEW_TERMS`` terms in all go to every task, so that no row is
    shuffled; larger ones stay a table that the terms join on (group, term), where the only window covers the terms of one
    row. Rows without a group have no terms.

    As in ``left_out_vocabularies``, only bigrams are counted by name whose counters reach the last of ``max_features`` usable words
    of their group; all of them in a group of fewer usable words.
    """
    split = joined_tokens(df.select(*keys, by, text), text, spec)
    stored = materialize(split.select(*keys, by, "_tokens", F.monotonically_increasing_id().alias("_row")), "grams")
    sizes = stored.groupBy(by).agg(F.count(F.lit(1)).alias("_n"))
    order = [("cf", True), ("term", False)]

    def usable(statistics: DataFrame) -> DataFrame:
        return statistics.join(sizes, by).where((F.col("df") >= spec.min_df) & (F.col("df") <= spec.max_df * F.col("_n")))

    size = counters_for(stored.count())
    words, buckets = words_and_buckets(stored, by, size)
    words = materialize(usable(words), "group-words")
    first = head_per_group_large(words, [by], order, spec.max_features).groupBy(by)
    first = materialize(first.agg(F.count(F.lit(1)).alias("_words"), F.min("cf").alias("_last")), "group-bounds")
    bounds = sizes.where(F.col(by).isNotNull()).join(first, by, "left").select(
        by, F.when(F.col("_words") == spec.max_features, F.col("_last")).otherwise(0).alias("_least")
    )
    bounds = bounds.limit(FEW_TERMS + 1).toArrow()  # a number a group
    if len(bounds) <= FEW_TERMS:
        pairs = gram_statistics(stored, by, (None, bucket_counts(buckets, size), (bounds[by], np.minimum(bounds["_least"].to_numpy(), MOST_COUNTED))))
        statistics = words.unionByName(usable(pairs))
    else:
        statistics = usable(gram_statistics(stored, by))
    best = head_per_group_large(statistics, [by], order, spec.max_features)
    idf = F.log((1 + F.col("_n")) / (1 + F.col("df"))) + 1
    best = materialize(best.select(by, "term", idf.alias("_idf")), "group-vocabularies")
    discard(words, buckets, first)
    if best.count() <= FEW_TERMS:
        return weighed_terms(stored, keys, by, best.toArrow(), spec.sublinear), sizes
    grams = stored.withColumn("_grams", ngrams(tokenize(F.col("_tokens"))))
    rows = explode_terms(term_counts(grams), [*keys, by, "_row"], "_terms", ["term", "tf"])
    damped = 1 + F.log("tf") if spec.sublinear else F.col("tf")
    raw = rows.join(best, [by, "term"]).withColumn("_w", damped * F.col("_idf"))
    length = F.sqrt(F.sum(F.col("_w") * F.col("_w")).over(Window.partitionBy("_row")))
    return raw.select(*keys, by, "term", (F.col("_w") / length).alias("weight")), sizes


def tfidf_long(
    df: DataFrame, key: str, text: str, spec: TfidfSpec, by: str | None = None
) -> DataFrame:
    """(key, term, weight) rows; with ``by`` the fit is per group."""
    if by is not None:
        return group_weights(df, [key], text, spec, by)[0]
    stored = stored_grams(df, [key], text, spec, "tokens")
    vocabulary = fit_vocabulary(stored, spec)
    found = pa.table({"term": pa.array(vocabulary.terms, pa.string()), "_idf": pa.array(vocabulary.idf, pa.float64())})
    return weighed_terms(stored, [key], None, found, spec.sublinear)


def stored_grams(df: DataFrame, keep: Sequence[str], text: str, spec: TfidfSpec, name: str) -> DataFrame:
    """``keep`` and ``_tokens``, of which all counts make their grams, written once: the only place where a training set's text is split."""
    return materialize(joined_tokens(df.select(*keep, text), text, spec).select(*keep, "_tokens"), name)


def left_out_vocabularies(
    stored: DataFrame, spec: TfidfSpec, fold: str | None, left_out: Sequence[int | None], sizes: dict[int, int]
) -> list[Vocabulary]:
    """A vocabulary for each fold left out (None: no fold), from one count of the terms.

    Document and corpus frequencies of all rows and of each fold are aggregated together; a fold's vocabulary
    follows from the difference. ``sizes``: rows of each fold.

    Words are counted first, bigrams by hashed counters, which never hold less than one of their bigrams occurs. A bigram rarer than
    the last of ``max_features`` usable words is in no vocabulary, so only bigrams whose words and counters reach that are counted by
    name. With fewer usable words all bigrams are.
    """
    folds = [f for f in left_out if f is not None]
    by = fold if folds else None

    def summed(rows: DataFrame) -> DataFrame:
        parts = [F.sum("df").alias("df"), F.sum("cf").alias("cf")]
        for f in folds:
            parts += [F.sum(F.when(F.col(fold) == f, F.col(c)).otherwise(0)).alias(f"{c}_{f}") for c in ("df", "cf")]
        every = rows.groupBy("term").agg(*parts) if folds else rows
        return every.where(F.col("df") >= max(1, spec.min_df))  # of fewer rows in no fold

    def best(stats: DataFrame, f: int | None) -> tuple[int, list]:
        """Rows without fold ``f``, and the most frequent usable terms there."""
        n = sum(sizes.values()) - (0 if f is None else sizes.get(f, 0))
        df, cf = (F.col(c) if f is None else F.col(c) - F.col(f"{c}_{f}") for c in ("df", "cf"))
        usable = stats.select("term", df.alias("df"), cf.alias("cf")).where(
            (F.col("df") >= max(1, spec.min_df)) & (F.col("df") <= spec.max_df * n)
        )
        return n, usable.orderBy(F.desc("cf"), "term").limit(spec.max_features).collect()  # at most max_features rows

    if gram_column(stored) == "_tokens":
        size = counters_for(sum(sizes.values()))
        words, buckets = words_and_buckets(stored, by, size)
        words = materialize(summed(words), "word-statistics")
        first = [best(words, f)[1] for f in left_out]
        least = min((rows[-1]["cf"] if rows and len(rows) == spec.max_features else 0 for rows in first), default=0)
        if least > 1:
            often = words.where(F.col("cf") >= least).select("term")
            often = pc.cast(pc.unique(often.toArrow()["term"]), pa.string()) if often.count() <= FEW_TERMS else None
            pairs = gram_statistics(stored, by, (often, frequent_buckets(buckets, size, least)))
            stats = materialize(words.unionByName(summed(pairs)), "term-statistics")
        else:
            stats = materialize(summed(gram_statistics(stored, by)), "term-statistics")
    else:
        stats = materialize(summed(gram_statistics(stored, by)), "term-statistics")
    out = []
    for f in left_out:
        n, rows = best(stats, f)
        picked = sorted((r["term"], math.log((1 + n) / (1 + r["df"])) + 1) for r in rows)
        out.append(Vocabulary(spec, tuple(t for t, _ in picked), tuple(w for _, w in picked)))
    return out


def count_vectors(stored: DataFrame, terms: Sequence[str], name: str) -> DataFrame:
    """Replaces ``_tokens`` by ``terms`` and ``counts``: places in the sorted ``terms`` and how often; written once.

    Rows are dealt evenly over the session's cores, as tens of passes will read them.
    """
    stored = stored.repartition(stored.sparkSession.sparkContext.defaultParallelism)
    keep = [c for c in stored.columns if c != "_tokens"]
    if not terms:
        nothing = {"terms": F.array().cast("array<int>"), "counts": F.array().cast("array<double>")}
        return materialize(stored.select(*keep).withColumns(nothing), name)
    shared = stored.sparkSession.sparkContext.broadcast(gram_table(terms))
    pieces = row_terms(True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for piece, row, place, counts, _ in pieces(batch, shared.value):
                order = np.lexsort((place, row))
                edges = pa.array(np.append(0, np.cumsum(np.bincount(row, minlength=piece.num_rows))).astype(np.int32))
                lists = [pa.array(place[order].astype(np.int32)), pa.array(counts[order].astype(float))]
                yield pa.record_batch(
                    [*piece.columns[:-1], *[pa.ListArray.from_arrays(edges, values) for values in lists]], [*keep, "terms", "counts"]
                )

    kept = "".join(f"`{c}` {stored.schema[c].dataType.simpleString()}, " for c in keep)
    return materialize(stored.select(*keep, "_tokens").mapInArrow(run, f"{kept}terms array<int>, counts array<double>"), name)


def write_vectors(df: DataFrame, text: str, spec: TfidfSpec, name: str) -> tuple[DataFrame, Vocabulary]:
    """Rows plus a sparse ``features`` vector, written once to the shared folder, and the vocabulary fitted on them.

    Iterative training reads the stored vectors again and again, so they must not be
    recomputed; Parquet also lets later steps read only the columns they need.
    """
    stored = materialize(with_grams(df, text, spec).select(*df.columns, "_grams"), f"{name}-grams")
    vocabulary = fit_vocabulary(stored, spec)
    vector = F.struct(
        F.lit(0).cast("byte").alias("type"),
        F.lit(len(vocabulary.terms)).alias("size"),
        F.col("_idx").alias("indices"),
        F.col("_w").alias("values"),
    )
    path = scratch_path(df.sparkSession, name)
    weigh_grams(stored, vocabulary).select(*df.columns, vector.alias("features")).write.mode("overwrite").parquet(path)
    schema = T.StructType([*df.schema.fields, T.StructField("features", VectorUDT())])
    return df.sparkSession.read.schema(schema).parquet(path), vocabulary


def cluster_keywords(
    df: DataFrame,
    cluster: str,
    text: str,
    top_n: int = 5,
    spec: TfidfSpec = SPECS["cluster_keywords"],
) -> DataFrame:
    """Top terms per cluster by mean TF-IDF weight, fitted per cluster in one pass.

    (cluster, rank, term, score); the mean divides by all non-blank rows of the cluster. A
    cluster whose rows hold stopwords only has no keywords.
    """
    rows = df.where((F.trim(text) != "") & F.col(cluster).isNotNull()).select(cluster, text)
    weights, sizes = group_weights(rows, [], text, spec, cluster)
    sums = weights.groupBy(cluster, "term").agg(F.sum("weight").alias("_sum"))
    scored = sums.join(sizes, cluster).select(
        cluster,
        "term",
        # Rounded for the ranking: sums of doubles depend on the order of addition.
        F.round(F.col("_sum") / F.col("_n"), 9).alias("score"),
    )
    order = [F.desc("score"), F.col("term")]
    ranked = head_per_group(scored.where(F.col("score") > 0), [cluster], order, top_n)
    rank = F.row_number().over(Window.partitionBy(cluster).orderBy(*order))
    return ranked.select(cluster, rank.alias("rank"), "term", "score")
