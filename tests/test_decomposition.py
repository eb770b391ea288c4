from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors

from feedback_engine.operators import decomposition as D
from feedback_engine.operators import topics


def exact(matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    centred = matrix - matrix.mean(axis=0)
    _, s, vt = np.linalg.svd(centred, full_matrices=False)
    return vt[:k].T, s[:k] ** 2 / (len(matrix) - 1)


@pytest.fixture(scope="module")
def matrix():
    """300 x 120, three quarters zero, spectrum that falls off after six directions."""
    rng = np.random.default_rng(1)
    out = rng.standard_normal((300, 120)) * 0.05
    for j in range(6):
        out += np.outer(rng.standard_normal(300), rng.standard_normal(120)) * (7 - j) / 7
    return out * (rng.random(out.shape) < 0.25)


def frame(spark, matrix, sparse: bool):
    rows = [
        (i, Vectors.sparse(len(r), [(int(j), float(r[j])) for j in np.flatnonzero(r)]) if sparse else Vectors.dense(r))
        for i, r in enumerate(matrix)
    ]
    return spark.createDataFrame(rows, ["id", "features"]).repartition(3)


@pytest.mark.parametrize("sparse", [True, False])
def test_leading_components_equal_exact_ones(spark, matrix, sparse):
    df = frame(spark, matrix, sparse)
    indices, values = D.sparse_parts("features")
    rows = df.select(indices.alias("indices"), values.alias("values"))
    mean, directions, variances = D.principal_directions(rows, 120, 300, 4, passes=12)
    true, spread = exact(matrix, 4)
    assert np.allclose(mean, matrix.mean(axis=0))
    assert np.allclose(np.abs((directions * true).sum(axis=0)), 1, atol=1e-4)
    assert np.allclose(variances, spread, rtol=1e-4)
    assert (directions[np.abs(directions).argmax(axis=0), range(4)] > 0).all()


def test_as_many_columns_as_dimensions_is_exact_in_one_pass(spark, matrix):
    small = matrix[:, :10]
    df = frame(spark, small, True)
    indices, values = D.sparse_parts("features")
    _, directions, variances = D.principal_directions(
        df.select(indices.alias("indices"), values.alias("values")), 10, 300, 5, passes=1
    )
    true, spread = exact(small, 5)
    assert np.allclose(np.abs((directions * true).sum(axis=0)), 1) and np.allclose(variances, spread)


def test_scores_are_centred_and_of_length_one(spark, matrix):
    df = frame(spark, matrix, True)
    found = topics.pca_normalize(df, components=5).toPandas().sort_values("id")
    scores = np.stack(found.features)
    assert scores.shape == (300, 5) and np.allclose((scores**2).sum(axis=1), 1)
    true, _ = exact(matrix, 5)
    want = (matrix - matrix.mean(axis=0)) @ true
    want /= np.linalg.norm(want, axis=1, keepdims=True)
    signs = np.sign((scores * want).sum(axis=0))
    assert np.allclose(scores * signs, want, atol=0.05)


def test_no_square_array(monkeypatch, spark, matrix):
    """The largest array of the driver has dimensions x columns entries."""
    seen = []
    real = np.linalg.qr
    monkeypatch.setattr(np.linalg, "qr", lambda a, *r: seen.append(a.shape) or real(a, *r))
    df = frame(spark, matrix, True)
    indices, values = D.sparse_parts("features")
    D.principal_directions(df.select(indices.alias("indices"), values.alias("values")), 120, 300, 4)
    assert set(seen) == {(120, 4 + D.EXTRA)}


def test_empty_rows_and_few_rows(spark):
    rows = [(i, Vectors.sparse(5, [(0, 1.0), (1, float(i))] if i else [])) for i in range(5)]
    df = spark.createDataFrame(rows, ["id", "features"])
    assert topics.pca_normalize(df, components=24).select("features").first()[0] is not None
    two = topics.pca_normalize(df.where("id < 2")).toPandas()
    assert len(two) == 2 and len(two.features[0]) == 5
