"""Delta-maintained token counts.

Totals by source, language and tokenizer version are never recounted. A batch of changes (inserts, deletes, revised texts) becomes
signed deltas, which are summed by group and appended to a table that commits by manifest: the batch is there whole or not at
all, and a batch that is there already is not added again, so a retried or repeated batch counts once. Totals are the sum over
the batches; ``compact`` adds them up.

Deltas are combined before the shuffle, so a source with a third of all rows sends one row per task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedback_engine.llm.bpe import load
from feedback_engine.llm.mixing import n_words
from feedback_engine.llm.packing import Vocabulary
from feedback_engine.sources.manifest import ManifestTable

GROUP = ("source", "lang", "version")
SCHEMA = "source string, lang string, version string, documents long, tokens long"


def counted(docs: DataFrame, vocabularies: dict[str, Vocabulary], text_col: str = "text") -> DataFrame:
    """``docs`` columns source and lang with version and tokens: a row per document and tokenizer version.

    The version ``words`` counts white-space words; each vocabulary counts its ids. Null text has no tokens.
    """
    names = list(vocabularies)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coders = [load(v.ranks_path, v.pattern) for v in vocabularies.values()]
        for batch in batches:
            counts = [[len(c.ids(t.as_py() or "")) // 4 for c in coders] for t in batch.column(3)]
            yield pa.record_batch(
                [*batch.columns[:3], pa.array(counts, pa.list_(pa.int64()))], ["source", "lang", "n", "counts"]
            )

    narrow = docs.select(
        F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"),
        n_words(F.col(f"`{text_col}`")).alias("n"), F.col(f"`{text_col}`").alias("text"),
    )
    rows = narrow.mapInArrow(run, "source string, lang string, n long, counts array<long>")
    versions = F.array(F.struct(F.lit("words").alias("version"), F.col("n").alias("tokens")), *[
        F.struct(F.lit(name).alias("version"), F.col("counts")[i].alias("tokens")) for i, name in enumerate(names)
    ])
    return rows.select("source", "lang", F.inline(versions))


def delta(counts: DataFrame, sign: int) -> DataFrame:
    """Signed totals by group: inserts with +1, deletes with -1."""
    return counts.groupBy(*GROUP).agg(
        (F.count("*") * sign).cast("long").alias("documents"), (F.coalesce(F.sum("tokens"), F.lit(0)) * sign).cast("long").alias("tokens")
    )


@dataclass(frozen=True)
class Rollup:
    """Totals kept under ``path``, a folder that all executors share.

    Batch ids are any strings. Rows that repeat within a batch count as often as they stand. An empty batch is committed and
    changes nothing; without any batch there are no totals.
    """

    spark: SparkSession
    path: str

    @property
    def table(self) -> ManifestTable:
        return ManifestTable(self.spark, self.path)

    def commit(self, batch: str, *deltas: DataFrame) -> None:
        """Add a batch's summed deltas; a batch that was committed before changes nothing."""
        both = reduce(DataFrame.unionByName, deltas)
        self.table.append(both.groupBy(*GROUP).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens")), batch)

    def revise(self, batch: str, old: DataFrame, new: DataFrame) -> None:
        """Counts of revised documents: what they were goes, what they are comes."""
        self.commit(batch, delta(old, -1), delta(new, 1))

    def compact(self) -> None:
        """Replace all batches by their sums; they stay known as committed."""
        self.table.rewrite(self._sums())

    def _sums(self) -> DataFrame:
        rows = self.table.read() if self.table.exists() else self.spark.createDataFrame([], SCHEMA)
        return rows.groupBy(*GROUP).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))

    def totals(self) -> DataFrame:
        """Groups that still have documents. A null source or language is a group of its own."""
        return self._sums().where("documents <> 0 or tokens <> 0")
