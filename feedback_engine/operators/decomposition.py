"""Principal components of sparse rows by a randomised range finder.

A thin random matrix W (dimensions x some more than k columns) is multiplied with the covariance a few times. Each
multiplication is one pass: a task forms A W for its rows and adds A^T (A W) up, a shuffle sums the tasks' rows. Centring is
a correction of rank one, so sparse rows stay sparse. Between passes the thin matrix is orthonormalised on the driver; it
is the largest thing there. No dimensions x dimensions array exists anywhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PASSES = 6
EXTRA = 12  # columns beyond the wanted components
ENTRIES = 1 << 16  # entries of sparse rows that a task multiplies at a time


def sparse_parts(vector: str) -> tuple[Column, Column]:
    """Indices and values of a vector column, dense or sparse."""
    whole = F.unwrap_udt(vector)
    values = whole.getField("values")
    every = F.when(F.size(values) > 0, F.sequence(F.lit(0), F.size(values) - 1)).otherwise(F.array().cast("array<int>"))
    return F.coalesce(whole.getField("indices"), every), values


def covariance_products(rows: DataFrame, thin: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(covariance times ``thin`` times rows, column means) of stored ``rows`` (indices, values), in one pass."""
    size, width = thin.shape
    shared = rows.sparkSession.sparkContext.broadcast(thin)
    entries = ENTRIES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        w, total = shared.value, np.zeros((size, width + 1))
        for batch in batches:
            lengths = np.diff(batch.column(0).offsets.to_numpy())
            index, value = batch.column(0).flatten().to_numpy(), batch.column(1).flatten().to_numpy()
            ends = np.cumsum(lengths)
            row = 0
            while row < len(lengths):  # whole rows of some thousand entries
                first = ends[row] - lengths[row]
                stop = max(row + 1, int(np.searchsorted(ends, first + entries, "right")))
                i, x = index[first : ends[stop - 1]], value[first : ends[stop - 1]]
                of = np.repeat(np.arange(stop - row), lengths[row:stop])
                product, own = np.zeros((stop - row, width)), np.flatnonzero(np.diff(of, prepend=-1))
                if len(own):
                    product[of[own]] = np.add.reduceat(w[i] * x[:, None], own, axis=0)
                added = np.concatenate([product[of] * x[:, None], x[:, None]], axis=1)
                order = np.argsort(i, kind="stable")
                starts = np.flatnonzero(np.diff(i[order], prepend=-1))
                if len(starts):
                    total[i[order][starts]] += np.add.reduceat(added[order], starts, axis=0)
                row = stop
        touched = np.flatnonzero(total.any(axis=1))
        columns = [pa.array(touched.astype(np.int32)), *[pa.array(total[touched, j]) for j in range(width + 1)]]
        yield pa.record_batch(columns, ["i", *[f"c{j}" for j in range(width + 1)]])

    schema = "i int, " + ", ".join(f"c{j} double" for j in range(width + 1))
    summed = rows.mapInArrow(run, schema).groupBy("i").agg(*[F.sum(f"c{j}").alias(f"c{j}") for j in range(width + 1)])
    table, out = summed.toArrow(), np.zeros((size, width + 1))  # a row per dimension at most
    out[table["i"].to_numpy()] = np.stack([table[f"c{j}"].to_numpy() for j in range(width + 1)], axis=1)
    shared.unpersist()
    mean = out[:, width] / n_rows
    return out[:, :width] - n_rows * np.outer(mean, mean @ thin), mean


def principal_directions(
    rows: DataFrame, size: int, n_rows: int, k: int, passes: int = PASSES, extra: int = EXTRA, seed: int = 42
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, directions as columns, variances) of the ``k`` leading components of stored rows (indices, values).

    The largest entry of a direction is positive. With as many columns as dimensions the first pass is exact.
    """
    width = min(k + extra, size)
    thin = np.linalg.qr(np.random.default_rng(seed).standard_normal((size, width)))[0]
    for turn in range(passes):
        grown, mean = covariance_products(rows, thin, n_rows)
        if turn < passes - 1 and width < size:
            thin = np.linalg.qr(grown)[0]
            continue
        values, turned = np.linalg.eigh((thin.T @ grown + grown.T @ thin) / 2)  # width x width
        best = np.argsort(-values)[:k]
        directions = thin @ turned[:, best]
        break
    signs = np.sign(directions[np.abs(directions).argmax(axis=0), np.arange(directions.shape[1])])
    return mean, directions * np.where(signs == 0, 1, signs), np.maximum(values[best], 0) / max(1, n_rows - 1)


def projected(df: DataFrame, vector: str, mean: np.ndarray, directions: np.ndarray) -> Column:
    """Scores of the centred vector, an array column."""
    shared = df.sparkSession.sparkContext.broadcast((directions, mean @ directions))

    @F.pandas_udf("array<double>")
    def scores(indices: pd.Series, values: pd.Series) -> pd.Series:
        w, middle = shared.value
        return pd.Series([x @ w[i] - middle for i, x in zip(indices, values)])

    return scores(*sparse_parts(vector))


def projected_rows(df: DataFrame, indices: Column, values: Column, mean: np.ndarray, directions: np.ndarray) -> DataFrame:
    """Add ``_x``, the scores of the centred vector (indices, values), which Arrow batches work out: nothing they read is worked out twice."""
    shared, names = df.sparkSession.sparkContext.broadcast((directions, mean @ directions)), [*df.columns, "_x"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import pyarrow as pa

        w, middle = shared.value
        for batch in batches:
            *kept, own, weights = batch.columns
            edges, at = own.offsets.to_numpy() - own.offsets[0].as_py(), own.flatten().to_numpy()
            x = weights.flatten().to_numpy()
            scores = [x[a:b] @ w[at[a:b]] - middle for a, b in zip(edges, edges[1:])]
            yield pa.record_batch([*kept, pa.array(scores, pa.list_(pa.float64()))], names)

    schema = T.StructType([*df.schema.fields, T.StructField("_x", T.ArrayType(T.DoubleType()))])
    return df.select("*", indices.alias("_i"), values.alias("_v")).mapInArrow(run, schema)
