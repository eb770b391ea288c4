"""Exact dedup: two-pass Bloom filtering, so that only possibly repeated rows shuffle.

Pass one deals a 64-bit hash of every normalised text to a word of a blocked Bloom filter and to four bits
in that word. Counts of equal (word, bits) pairs, combined before the shuffle, show which pairs came more than
once; these alone are set in the filter. Pass two tests each row: rows that miss the filter have no equal
and pass straight through, the others meet by SHA-256. The filter has about eight bits for each row and is
broadcast; it ends at ``most_words`` 64-bit words. Past that it fills up, more rows than needed shuffle, and
the result stays exact.

Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedback_engine.llm.common import join_counted, names
from feedback_engine.session import materialize

BITS = 4
MOST_WORDS = 1 << 21


def normalised(text: Column) -> Column:
    """Runs of white space become one space; null is empty. A lone space is left alone, which is the same."""
    return F.regexp_replace(
        F.coalesce(text, F.lit("")), r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+", " "
    )


def text_hash(text: Column) -> Column:
    return F.unhex(F.sha2(normalised(text), 256))


def _cell(sha: Column, words: int) -> tuple[Column, Column]:
    """Word of the filter and the bits to set in it."""
    hashed = F.xxhash64(sha)
    mask = F.lit(0).cast("long")
    for i in range(BITS):
        bit = F.shiftrightunsigned(hashed, 6 * i).bitwiseAND(F.lit(63)).cast("int")
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), bit))
    return F.pmod(F.shiftrightunsigned(hashed, 6 * BITS), F.lit(words)), mask


def repeated_filter(hashes: DataFrame, sha: str, words: int) -> DataFrame:
    """Words of the Bloom filter of repeated hashes: (word, bits), at most ``words`` rows."""
    word, mask = _cell(F.col(sha), words)
    return (
        hashes.select(word.alias("word"), mask.alias("mask"))
        .groupBy("word", "mask")
        .count()
        .where("count > 1")
        .groupBy("word")
        .agg(F.bit_or("mask").alias("bits"))
    )


def filter_words(n_rows: int, most_words: int = MOST_WORDS) -> int:
    words = 1 << 10
    while words < most_words and words * 8 < n_rows:
        words *= 2
    return words


def maybe_repeated(df: DataFrame, sha: str, bloom: DataFrame, words: int, flag: str) -> DataFrame:
    """Adds the filter's answer: false means that no other row has this hash."""
    n = names(df, "word", "bits")
    word, mask = _cell(F.col(sha), words)
    known = F.broadcast(bloom.select(F.col("word").alias(n["word"]), F.col("bits").alias(n["bits"])))
    hit = F.coalesce(F.col(n["bits"]).bitwiseAND(mask) == mask, F.lit(False))
    return (
        df.withColumn(n["word"], word).join(known, n["word"], "left").withColumn(flag, hit)
        .drop(n["word"], n["bits"])
    )


def exact_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_words: int = MOST_WORDS
) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    The row with the smallest id stays, null ids come last. Null text counts as empty, empty texts are equal to
    each other. Rows that repeat id and text share one verdict. An empty table gives an empty table. Other
    columns of ``docs`` are not read.
    """
    hashes = materialize(
        docs.select(F.col(f"`{id_col}`").alias("id"), text_hash(F.col(f"`{text_col}`")).alias("sha")),
        "text-hashes",
    )
    n_rows = hashes.count()
    words = filter_words(n_rows, most_words)
    bloom = repeated_filter(hashes, "sha", words)
    tested = materialize(maybe_repeated(hashes, "sha", bloom, words, "again"), "tested-hashes")
    groups = materialize(
        tested.where("again").groupBy("sha").agg(F.min("id").alias("keep_id"), F.count("*").alias("group_size")),
        "text-groups",
    )
    shuffled = join_counted(tested.where("again"), groups, ["sha"], "group_size", n_rows, F.col("id"))
    single = tested.where("not again").withColumns({"keep_id": F.col("id"), "group_size": F.lit(1).cast("long")})
    columns = [
        F.col("id").alias(id_col),
        "keep_id",
        "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    ]
    return single.select(*columns).unionByName(shuffled.select(*columns))


def drop_exact_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_words: int = MOST_WORDS
) -> DataFrame:
    """``docs`` with one row of each group of equal texts; rows that miss the filter keep their place.

    Of rows that repeat id and text, one stays.
    """
    n = names(docs, "sha", "again", "keep", "size", "id")
    columns = [f"`{c}`" for c in docs.columns]
    marked = docs.withColumn(n["sha"], text_hash(F.col(f"`{text_col}`")))
    hashes = materialize(
        marked.select(F.col(f"`{id_col}`").alias("id"), F.col(n["sha"]).alias("sha")), "text-hashes"
    )
    n_rows = hashes.count()
    words = filter_words(n_rows, most_words)
    bloom = materialize(repeated_filter(hashes, "sha", words), "bloom")
    tested = maybe_repeated(marked, n["sha"], bloom, words, n["again"])
    groups = materialize(
        maybe_repeated(hashes, "sha", bloom, words, "again").where("again")
        .groupBy("sha").agg(F.min("id").alias("keep"), F.count("*").alias("size")),
        "text-groups",
    ).select(F.col("sha").alias(n["sha"]), F.col("keep").alias(n["keep"]), F.col("size").alias(n["size"]))
    stay = join_counted(tested.where(n["again"]), groups, [n["sha"]], n["size"], n_rows, F.col(f"`{id_col}`")).where(
        F.col(f"`{id_col}`").eqNullSafe(F.col(n["keep"]))
    )
    once = stay.dropDuplicates([n["sha"]])
    return tested.where(~F.col(n["again"])).select(*columns).unionByName(once.select(*columns))
