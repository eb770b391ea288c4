"""CSV with quoted line breaks, read in splits.

A file is read as lines, split by split. Whether a line begins inside quotes follows from the number of quotes before it:
their parity in each split is summed up in one pass, the parities of the splits before a split give its start, and a task
then joins the lines of its splits to records. A record over the edge of a split is joined from its parts, at most two a
split. Quotes follow RFC 4180: they stand around a cell, and doubled inside one.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedback_engine.session import materialize

RECORD, HEADER, BEGIN, MIDDLE, END, HEADER_BEGIN = range(6)
OPTIONS = {"quote": '"', "escape": '"', "mode": "PERMISSIVE"}


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, value): lines in the order of their split; a line break within quotes ends a line as well."""
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")


def _open_splits(lines: DataFrame) -> dict[tuple[str, int], bool]:
    """Splits that begin inside quotes: one flag a split, so 100 TB in splits of 128 MB are 800,000."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    parity = lines.groupBy("file", "block").agg((F.sum(quotes) % 2).alias("odd"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    states = parity.select("file", "block", (F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2 == 1).alias("inside"))
    return {(r["file"], r["block"]): True for r in states.where("inside").collect()}


def _parts(lines: DataFrame) -> DataFrame:
    """(file, block, kind, text): records within a split, headers, and parts of records over an edge."""
    shared = lines.sparkSession.sparkContext.broadcast(_open_splits(lines))
    record, header, begin, middle, end, header_begin = RECORD, HEADER, BEGIN, MIDDLE, END, HEADER_BEGIN

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa

        inside_at = shared.value
        split, inside, first, held = None, False, False, []
        out: list[tuple] = []

        def close(last: bool) -> None:
            """The lines held are a record, or the part of one that this split has."""
            nonlocal first, held
            if not held:
                return
            text, held = "\n".join(held), []
            if from_before:
                kind = middle if last and inside else end
            else:
                kind = begin if last and inside else record
            if kind in (record, begin) and first and split[1] == 0:
                kind, text = (header if kind == record else header_begin), text.removeprefix("\ufeff")
            first = False
            out.append((*split, kind, text))

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            columns = zip(*rows, strict=True) if rows else [()] * 4
            types = (pa.string(), pa.int64(), pa.int32(), pa.string())
            return pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["file", "block", "kind", "text"])

        from_before = False
        for batch in batches:
            files, blocks, values = (c.to_pylist() for c in batch.columns)
            for file, block, value in zip(files, blocks, values, strict=True):
                if split != (file, block):
                    close(True)
                    split = (file, block)
                    inside = from_before = split in inside_at
                    first = not inside
                elif not inside:
                    close(False)
                    from_before = False
                held.append(value)
                if value.count('"') % 2:
                    inside = not inside
            yield batch_of(out)
            out = []
        close(True)
        yield batch_of(out)

    return lines.mapInArrow(run, "file string, block long, kind int, text string")


def _joined(parts: DataFrame) -> DataFrame:
    """(file, text, header): records over an edge from their parts, in the order of their splits."""
    edges = parts.where(F.col("kind") >= BEGIN)
    starts = F.col("kind").isin(BEGIN, HEADER_BEGIN)
    by_file = Window.partitionBy("file").orderBy("block", starts)  # at most two parts a split
    numbered = edges.withColumn("nr", F.sum(starts.cast("long")).over(by_file))
    texts = F.transform(F.array_sort(F.collect_list(F.struct("block", "text"))), lambda p: p["text"])
    return numbered.groupBy("file", "nr").agg(
        F.array_join(texts, "\n").alias("text"), (F.max("kind") == HEADER_BEGIN).alias("header")
    ).drop("nr")


def _names(spark: SparkSession, line: str, sep: str) -> list[str]:
    """Column names of a header: empty ones by their place, repeated ones with it."""
    cells = spark.read.csv(spark.sparkContext.parallelize([line], 1), sep=sep, quote='"', escape='"').first()
    lowered = [(c or "").lower() for c in cells]
    return [
        f"_c{i}" if not cell else f"{cell}{i}" if lowered.count(cell.lower()) > 1 else cell for i, cell in enumerate(cells)
    ]


def read_csv_records(
    spark: SparkSession, path: str, sep: str = ",", schema: T.StructType | None = None, file_column: str | None = None
) -> DataFrame:
    """Rows of all files of ``path``, as the multi-line CSV reader gives them, in as many tasks as there are splits.

    The first record of each file is its header. Without a schema the columns are strings named by the header of the first
    file. Blank records are skipped, an empty cell is null; a short row gets nulls. Line ends are ``\\n`` or
    ``\\r\\n``. ``file_column`` adds the name of the file. Without any header there are no rows.
    """
    parts = materialize(_parts(_lines(spark, path)), "csv-parts")
    whole = parts.where(F.col("kind").isin(RECORD, HEADER)).select("file", "text", (F.col("kind") == HEADER).alias("header"))
    records = whole.union(_joined(parts).select("file", "text", "header")).withColumn("text", F.regexp_replace("text", r"\r\z", ""))
    if schema is None:
        first = records.where("header").orderBy("file").select("text").first()
        if first is None:
            return spark.createDataFrame([], T.StructType([T.StructField(file_column, T.StringType())] if file_column else []))
        schema = T.StructType([T.StructField(name, T.StringType()) for name in _names(spark, first["text"], sep)])
    records = records.where("not header").where(F.trim("text") != "")
    ddl = ", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(schema))
    parsed = records.select("file", F.from_csv("text", ddl, {"sep": sep, **OPTIONS}).alias("r"))
    out = [F.col(f"r.c{i}").alias(f.name) for i, f in enumerate(schema)]
    if file_column is not None:
        out.append(F.element_at(F.split("file", "/"), -1).alias(file_column))
    return parsed.select(*out)
