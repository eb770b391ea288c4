"""Keys seen so far, for batches that arrive one after the other.

The index is a table bucketed by the hash of the key, so that the join of a batch with it shuffles the batch alone: the stored
side is read bucket by bucket where it lies, however large it has grown. It is never broadcast.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedback_engine.operators.ranking import keep_first
from feedback_engine.session import materialize


@dataclass(frozen=True)
class KeyIndex:
    """Stored keys under ``path``: hash, key columns, and the batch that brought them."""

    spark: SparkSession
    path: str
    keys: tuple[T.StructField, ...]
    buckets: int = 64

    @property
    def table(self) -> str:
        """Name of the table in this session; another session registers the same files again."""
        return f"key_index_{hashlib.md5(self.path.encode()).hexdigest()}"

    def _register(self) -> None:
        columns = ", ".join(["h bigint", *[f"k{i} {f.dataType.simpleString()}" for i, f in enumerate(self.keys)], "batch string"])
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.table} ({columns}) USING parquet "
            f"CLUSTERED BY (h) SORTED BY (h) INTO {self.buckets} BUCKETS LOCATION '{self.path}'"
        )

    def _hash(self, prefix: str = "") -> Column:
        return F.xxhash64(*[F.col(f"`{prefix}{f.name}`").cast(f.dataType) for f in self.keys])

    def read(self) -> DataFrame:
        self._register()
        return self.spark.table(self.table)

    def unseen(self, rows: DataFrame, batch: str) -> DataFrame:
        """Rows whose key no other batch has brought; null keys are equal to each other."""
        stored = self.read().where(F.col("batch") != batch).hint("merge").alias("s")
        new = rows.withColumn("_h", self._hash()).alias("b")
        # an equality of the keys would become a join key as well, which the buckets are not laid out for
        own = F.struct(*[F.col(f"b.`{f.name}`").cast(f.dataType).alias(f"k{i}") for i, f in enumerate(self.keys)])
        seen = F.struct(*[F.col(f"s.k{i}").alias(f"k{i}") for i in range(len(self.keys))])
        same = (F.col("b._h") == F.col("s.h")) & (own >= seen) & (own <= seen)
        return new.join(stored, same, "left_anti").drop("_h")

    def add(self, rows: DataFrame, batch: str) -> None:
        """Enter the keys of rows. Entering a batch again repeats keys, which changes no answer."""
        self._register()
        keys = rows.select(self._hash().alias("h"), *[F.col(f"`{f.name}`").cast(f.dataType).alias(f"k{i}") for i, f in enumerate(self.keys)])
        spread = keys.withColumn("batch", F.lit(batch)).repartition(self.buckets, "h")
        writer = spread.write.format("parquet").mode("append").option("path", self.path)
        writer.bucketBy(self.buckets, "h").sortBy("h").saveAsTable(self.table)


def key_index(spark: SparkSession, path: str, df: DataFrame, keys: Sequence[str], buckets: int = 64) -> KeyIndex:
    """The index of ``keys``, with their types in ``df``."""
    return KeyIndex(spark, path.rstrip("/"), tuple(df.schema[k] for k in keys), buckets)


def dedupe_batch(index: KeyIndex, df: DataFrame, order: Sequence[Column], batch: str) -> DataFrame:
    """Rows of a batch whose key is new, the first of each by ``order``; their keys are entered in the index.

    Batches in turn give what one run over all of them gives, if earlier batches come first in its order. A batch that is
    run again after a failure, or after it was done, gives the same rows.
    """
    firsts = keep_first(df, [f.name for f in index.keys], order)
    fresh = materialize(index.unseen(firsts, batch), "new-keys")
    index.add(fresh, batch)
    return fresh
