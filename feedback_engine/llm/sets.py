"""Tables of hashed shingle sets, and exact comparison of whole sets."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedback_engine.llm.common import semi_by_id
from feedback_engine.llm.shingles import sets_of
from feedback_engine.llm.words import slices


def set_rows(docs: DataFrame, words: int, first: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """(id, n, fp, fp2, vals) of (id, text): size, two fingerprints and values of each set, in the order of their hash.

    ``first`` says how many values a set of each size keeps; all by default. Texts are taken in slices of some MB.
    """
    schema = pa.schema(
        [("id", pa.int64()), ("n", pa.int64()), ("fp", pa.int64()), ("fp2", pa.int64()), ("vals", pa.list_(pa.int64()))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                sets = sets_of(part.column(1), words)
                n = np.array([len(s) for s in sets], np.int64)
                kept = n if first is None else np.minimum(n, first(n))
                offsets = np.zeros(len(n) + 1, np.int32)
                np.cumsum(kept, out=offsets[1:])
                flat = np.concatenate([np.zeros(0, np.uint64), *[s[:p] for s, p in zip(sets, kept, strict=True)]])
                mixed = [s ^ (s >> np.uint64(29)) for s in sets]
                yield pa.record_batch(
                    [
                        part.column(0).cast(pa.int64()), pa.array(n),
                        pa.array(np.array([s.sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)),
                        pa.array(np.array([(m * (m | np.uint64(1))).sum(dtype=np.uint64) for m in mixed], np.uint64).view(np.int64)),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.view(np.int64))),
                    ],
                    schema,
                )

    return docs.mapInArrow(run, "id long, n long, fp long, fp2 long, vals array<long>")


def linked(pairs: DataFrame, sets: DataFrame, share: int) -> DataFrame:
    """The pairs whose whole sets have 100 * intersection >= share * union."""
    both = pairs.join(sets.selectExpr("node a", "n na", "vals va"), "a").join(sets.selectExpr("node b", "n nb", "vals vb"), "b")
    inter = F.size(F.array_intersect("va", "vb"))
    return both.where(inter * 100 >= (F.col("na") + F.col("nb") - inter) * share).select("a", "b")


def whole_sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(node, n, vals) of the wanted (node, id, n, fp, fp2): their documents are read again.

    The wanted ids only spare other texts the work, so a few too many do no harm (null counts as -1). Up to the ids that
    ``semi_by_id`` broadcasts, no text is shuffled; of equal sets a task hands on one.
    """
    key, same = F.coalesce("id", F.lit(-1)).alias("wanted_id"), ["n", "fp", "fp2"]
    ids = wanted.select(key).distinct()
    texts = semi_by_id(docs.select("*", key), ids, "wanted_id", ids.count()).select(*docs.columns)
    found = set_rows(texts, words).groupBy(*same).agg(F.first("vals").alias("vals"))
    return found.join(wanted.drop("id"), same).select("node", "n", "vals")
