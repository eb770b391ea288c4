"""Best-fit packing by minimum bin slack.

Documents become token ids where they lie; what is packed is a histogram of piece lengths with at most
``size`` entries, so planning on the driver is bounded whatever the corpus. For each bin, a bitset subset-sum
over the lengths still there finds the fullest combination that contains the longest length left; the combination
is taken as often as its lengths last. Pieces then find their place by rank: their number among the pieces of
equal length, counted over buckets so that a length with most pieces (full ones) is never in one task.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedback_engine.llm.bpe import load
from feedback_engine.session import materialize

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
ROWS_PER_BUCKET = 2_000
MOST_BUCKETS = 1 << 16


@dataclass(frozen=True)
class Vocabulary:
    """Where tasks read the vocabulary; the id that ends a document; added tokens, which are whole wherever they stand."""

    ranks_path: str
    pattern: str
    end_id: int = 2
    added: tuple[tuple[str, int], ...] = ()


def public_vocabulary(end_id: int = 2) -> Vocabulary:
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        added = tuple((t["content"], t["id"]) for t in json.load(file)["added_tokens"])
    return Vocabulary(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, end_id, added)


def cut(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: whole unless longer than ``size``; the first may be shorter."""
    if n <= size:
        return [(0, n)]
    first = n % size or size
    return [(0, first)] + [(start, size) for start in range(first, n, size)]


def pieces(
    docs: DataFrame, vocabulary: Vocabulary, size: int = 1024, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per piece of each document. Null text is empty; each document ends with the end id."""
    schema = pa.schema(
        [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
         ("ids_crc32", pa.int64())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, end = load(vocabulary.ranks_path, vocabulary.pattern), vocabulary.end_id.to_bytes(4, "little")
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = bpe.ids_with_added(text.as_py() or "", vocabulary.added) + end
                rows += [
                    (doc_id, i, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]))
                    for i, (start, length) in enumerate(cut(len(ids) // 4, size))
                ]
            columns = zip(*rows, strict=True) if rows else [()] * 5
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema)

    narrow = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text")
    )
    return narrow.mapInArrow(run, PIECES)


def fullest(longest: int, counts: dict[int, int], size: int) -> dict[int, int]:
    """The fullest combination with ``longest``: length -> times. Of equally full ones, the longest lengths first.

    ``reach[i]`` is a bitset of the sums that the first i lengths give with what is left of them.
    """
    room, lengths = size - longest, []
    full, reach = (1 << (room + 1)) - 1, [1]
    for length in sorted(counts, reverse=True):
        times = min(counts[length] - (length == longest), room // length)
        if times <= 0:
            continue
        sums, step = reach[-1], length
        while times > 0:  # times = 1 + 2 + 4 + ... + rest
            part = min(times, max(1, step // length))
            sums |= (sums << (part * length)) & full
            times -= part
            step *= 2
        lengths.append(length)
        reach.append(sums)
        if sums >> room & 1:
            break
    best, out = reach[-1].bit_length() - 1, {longest: 1}
    for i in range(len(lengths), 0, -1):
        while not reach[i - 1] >> best & 1:
            out[lengths[i - 1]] = out.get(lengths[i - 1], 0) + 1
            best -= lengths[i - 1]
    return out


def plan_bins(histogram: dict[int, int], size: int) -> list[tuple[dict[int, int], int]]:
    """(combination, bins filled with it), at most one entry for each length that runs out."""
    counts, plan = {length: n for length, n in histogram.items() if n > 0}, []
    while counts:
        chosen = fullest(max(counts), counts, size)
        bins = min(counts[length] // times for length, times in chosen.items())
        plan.append((chosen, bins))
        for length, times in chosen.items():
            counts[length] -= times * bins
            if not counts[length]:
                del counts[length]
    return plan


def _runs(plan: Sequence[tuple[dict[int, int], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, rank after the last, first bin, times in a bin, offset): where ranks go."""
    taken: dict[int, int] = {}
    out, first_bin = [], 0
    for chosen, bins in plan:
        offset = 0
        for length, times in sorted(chosen.items(), reverse=True):
            start = taken.get(length, 0)
            taken[length] = start + times * bins
            out.append((length, start, taken[length], first_bin, times, offset))
            offset += times * length
        first_bin += bins
    return out


def ranked(table: DataFrame, n_rows: int) -> DataFrame:
    """Adds ``rank``: the number of a piece among those of equal length, from 0."""
    buckets = min(MOST_BUCKETS, max(1, -(-n_rows // ROWS_PER_BUCKET)))
    dealt = table.withColumn(
        "bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)).cast("int")
    )
    sizes = dealt.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    within = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    return (
        dealt.withColumn("at", F.row_number().over(within) - 1)
        .join(offsets, ["length", "bucket"])
        .withColumn("rank", F.col("before") + F.col("at"))
        .drop("bucket", "before", "at")
    )


def pack(
    docs: DataFrame, vocabulary: Vocabulary, size: int = 1024, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Pieces with their sequence and their place in it; each sequence is gapless from 0 and within ``size``.

    Null and empty texts give one piece that holds the end id. Rows that repeat an id are packed as documents
    of their own. An empty table gives an empty table. Other columns of ``docs`` are not read.
    """
    spark = docs.sparkSession
    table = materialize(pieces(docs, vocabulary, size, id_col, text_col), "pieces")
    histogram = {row.length: row["count"] for row in table.groupBy("length").count().collect()}  # <= size rows
    schema = T.StructType(
        [T.StructField(c, T.LongType()) for c in ("length", "low", "high", "first_bin", "times", "place")]
    )
    runs = spark.createDataFrame(_runs(plan_bins(histogram, size)), schema)
    step = F.col("rank") - F.col("low")
    return (
        ranked(table, sum(histogram.values()))
        .join(F.broadcast(runs), "length")
        .where((F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
        .select(
            F.col("doc_id").alias(id_col),
            "piece",
            "start",
            "length",
            "ids_crc32",
            (F.col("first_bin") + F.floor(step / F.col("times"))).cast("long").alias("sequence_id"),
            (F.col("place") + F.pmod(step, F.col("times")) * F.col("length")).cast("long").alias("offset"),
        )
    )
