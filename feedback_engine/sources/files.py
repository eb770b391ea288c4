"""File and table sources and sinks."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from pathlib import PurePosixPath

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedback_engine import schemas as S
from feedback_engine.sources.csv_records import read_csv_records
from feedback_engine.sources.manifest import ManifestTable

FORMATS = {".csv": "csv", ".parquet": "parquet", ".json": "json"}
_MISSING = {"PATH_NOT_FOUND", "TABLE_OR_VIEW_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"}


def format_of(path: str) -> str:
    suffix = PurePosixPath(path).suffix.lower()
    if suffix not in FORMATS:
        raise ValueError(f"unsupported file format: {suffix}")
    return FORMATS[suffix]


def read_by_suffix(
    spark: SparkSession, path: str, schema: T.StructType | None = None, multiline: bool = True
) -> DataFrame:
    """csv (header), parquet or json by extension. Pass a schema to skip inference.

    An empty CSV cell reads as null. CSV cells may hold quoted line breaks, and large files are still read in splits
    (``csv_records``); ``multiline=False`` saves that a pass where no cell has one.
    """
    kind = format_of(path)
    reader = spark.read if schema is None else spark.read.schema(schema)
    if kind == "csv":
        if multiline:
            return read_csv_records(spark, path, schema=schema)
        # Escapes follow RFC 4180.
        return reader.csv(path, header=True, quote='"', escape='"')
    if kind == "json":
        return reader.json(path)
    return reader.parquet(path)


def write_by_suffix(df: DataFrame, path: str) -> None:
    kind = format_of(path)
    writer = df.write.mode("overwrite")
    if kind == "csv":
        keep = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
        writer.csv(path, header=True, quote='"', escape='"', escapeQuotes=True, **keep)
    elif kind == "json":
        writer.option("ignoreNullFields", "false").json(path)
    else:
        writer.parquet(path)


def read_complaint_csv(
    spark: SparkSession, pattern: str, own_output: str = "complaints_processed.csv",
    schema: T.StructType | None = None, multiline: bool = True,
) -> DataFrame:
    """All ``;`` separated files of a folder with their file name, but not our own output.

    Complaint texts hold quoted line breaks; ``multiline=False`` is for files that have none.
    """
    if multiline:
        raw = read_csv_records(spark, pattern, ";", schema, "source_file")
    else:
        reader = spark.read if schema is None else spark.read.schema(schema)
        raw = reader.csv(pattern, header=True, sep=";", quote='"', escape='"')
        raw = raw.withColumn("source_file", F.col("_metadata.file_name"))
    return raw.where(F.col("source_file") != own_output)


def is_missing(error: AnalysisException) -> bool:
    return (error.getCondition() or "").split(".")[0] in _MISSING


def first_available(sources: Sequence[Callable[[], DataFrame]]) -> DataFrame:
    """First source that exists and has a row; only "not there" counts as absent."""
    for source in sources:
        try:
            df = source()
            if not df.isEmpty():
                return df
        except AnalysisException as error:
            if not is_missing(error):
                raise
    raise FileNotFoundError("no source has data")


def optional_dataset(load: Callable[[], DataFrame], spark: SparkSession, schema: T.StructType) -> DataFrame:
    """A missing optional dataset is an empty table of the declared schema."""
    try:
        return load()
    except AnalysisException as error:
        if not is_missing(error):
            raise
        return spark.createDataFrame([], schema)


def table_where(spark: SparkSession, table: str, where: Column | None = None) -> DataFrame:
    """Read a table; the predicate is a Column, so that it is pushed down and never raw SQL."""
    df = spark.table(table)
    return df if where is None else df.where(where)


def full_refresh(df: DataFrame, path: str, partition_by: Sequence[str] = (), batch: str | None = None) -> None:
    """One atomic replace: a second run leaves one copy, a failed one the old table. Read it with ``committed``."""
    ManifestTable(df.sparkSession, path).replace(df, batch, partition_by)


def committed(spark: SparkSession, path: str) -> DataFrame:
    """A table as its last commit left it."""
    return ManifestTable(spark, path).read()


def jdbc_refresh(df: DataFrame, url: str, table: str, properties: Mapping[str, str]) -> None:
    """Replace the rows of a database table and keep its definition."""
    df.write.mode("overwrite").option("truncate", "true").jdbc(url, table, properties=dict(properties))


def append_or_replace(df: DataFrame, path: str, if_exists: str = "append", batch: str | None = None) -> None:
    """Append, replace, or fail where the table exists. A ``batch`` that is in the table already changes nothing."""
    table = ManifestTable(df.sparkSession, path)
    if if_exists not in ("append", "replace", "fail"):
        raise ValueError(f"unknown mode: {if_exists}")
    if if_exists == "fail" and table.exists():
        raise FileExistsError(path)
    if if_exists == "replace":
        table.replace(df, batch)
    else:
        table.append(df, batch)


class NamedQueries:
    """Views by name plus free SQL over them."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark

    def register(self, views: Mapping[str, DataFrame]) -> None:
        for name, df in views.items():
            df.createOrReplaceTempView(name)

    def named(self, name: str) -> DataFrame:
        return self.spark.table(name)

    def run(self, query: str) -> DataFrame:
        return self.spark.sql(query)


def report_bundle(
    silver: DataFrame, gold: DataFrame, model_summary: DataFrame
) -> dict[str, DataFrame]:
    """The report's datasets; per-source filters are pushed to the scans."""
    return {
        "unified": silver,
        "video_sentiment": gold.where(F.col("source") == S.VIDEO_SOURCE),
        "complaints": silver.where(F.col("source") == S.COMPLAINT_SOURCE),
        "model_summary": model_summary,
    }
