"""Whitening against numpy's eigenvectors and whole numbers."""

import numpy as np
import pytest

from recordwarden.llm import whitening

from .helpers import embeddings

COLUMNS = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def checked(rows, found, components=8):
    """`found` against covariance and eigenvectors of the given (vec_id, vector) rows."""
    x = np.floor(1024 * np.array([v for _, v in rows], dtype=np.float64)) + 100_000
    n, centred = len(x), x - x.mean(0)
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    kept = min(components, int((values > 1e-9 * values[0]).sum()))
    assert len(found) == n * kept and set(found.component) == set(range(1, kept + 1))
    assert (found.n == n).all() and found.identity_error.nunique() == 1 and found.identity_error.iloc[0] < 1e-9
    whole = [[int(e) for e in row] for row in x]
    sums = [sum(column) for column in zip(*whole)]
    want = sorted((i, sum((n * e - s) ** 2 for e, s in zip(row, sums))) for (i, _), row in zip(rows, whole))
    assert sorted(found[found.component == 1][["vec_id", "deviation"]].itertuples(index=False, name=None)) == want
    explained = found.groupby("component").explained.first().to_numpy()
    assert np.allclose(explained, values[:kept] / values.sum(), rtol=1e-9)
    for component in range(1, kept + 1):
        own = centred @ vectors[:, component - 1] / np.sqrt(values[component - 1])
        got = found[found.component == component].set_index("vec_id").whitened
        want = dict(zip((i for i, _ in rows), own))
        sign = np.sign(got.iloc[0] * want[got.index[0]]) or 1
        assert max(abs(sign * g - want[i]) for i, g in got.items()) < 1e-6


def test_random_vectors(spark):
    rng = np.random.default_rng(0)
    x = (rng.normal(size=(700, 20)) @ np.diag(np.linspace(0.02, 1, 20)) @ rng.normal(size=(20, 20))).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    table = embeddings(spark, [(i, v, 0, "x", 1) for i, v in rows]).repartition(5)
    found = whitening.whiten(table)
    assert found.columns == COLUMNS
    checked(rows, found.toPandas())


def test_odd_vectors(spark):
    """Null, empty, non-finite, too large and shorter vectors go; zero and repeated ones stay."""
    rng = np.random.default_rng(1)
    good = [(i, rng.normal(size=3).astype(np.float32).tolist()) for i in range(30)] + [(30, [0.0] * 3), (31, [0.5, -0.25, 3.0])]
    odd = [(40, None), (41, []), (42, [1.0, None, 2.0]), (43, [1.0, float("nan"), 2.0]), (44, [float("inf"), 0.0, 0.0]),
           (45, [3e38, 0.0, 0.0]), (46, [1.0, 2.0])]
    table = embeddings(spark, [(i, v, 0, "x", 1) for i, v in good + odd])
    checked(good, whitening.whiten(table).toPandas())
    again = table.where("vec_id = 31").unionByName(table).unionByName(embeddings(spark, [(None, [1.0, 1.0, 2.0], 0, "x", 1)]))
    found = whitening.whiten(again).toPandas()
    assert len(found) == 34 * 3 and found.vec_id.isna().sum() == 3 and (found.n == 34).all()


def test_fewer_components_than_dimensions(spark):
    """A covariance of rank 2 has two components."""
    rng = np.random.default_rng(2)
    x = rng.integers(-4, 5, size=(60, 2)) @ np.array([[1, 0, 1, 2], [0, 1, -1, 1]])
    rows = [(i, [float(e) for e in v]) for i, v in enumerate(x)]
    checked(rows, whitening.whiten(embeddings(spark, [(i, v, 0, "x", 1) for i, v in rows])).toPandas())


@pytest.mark.parametrize("rows", [[], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, None)]])
def test_no_variance(spark, rows):
    found = whitening.whiten(embeddings(spark, [(i, v, 0, "x", 1) for i, v in rows]))
    assert found.isEmpty() and found.columns == COLUMNS


@pytest.mark.parametrize("d", [1, 2, 7, 24])
def test_cholesky_and_jacobi(d):
    rng = np.random.default_rng(d)
    graded = rng.normal(size=(d, 3 * d)) * np.logspace(0, -6, d)[:, None]
    a = graded @ graded.T
    factor = whitening.pivoted_cholesky(a)
    assert np.allclose(factor @ factor.T, a, rtol=0, atol=1e-12 * np.abs(a).max())
    rotated = whitening.one_sided_jacobi(factor)
    gram = rotated.T @ rotated
    norms = np.sqrt(np.diag(gram))
    assert np.abs(gram / np.outer(norms, norms) - np.eye(len(norms))).max() < 1e-13
    assert np.allclose(norms**2, np.linalg.eigvalsh(a)[::-1][:len(norms)], rtol=1e-6, atol=1e-15 * norms[0] ** 2)


def test_large_numbers_stay_exact():
    x = np.array([[2**50, -(2**49)], [-(2**50), 2**48], [3, 5]], dtype=np.int64)
    assert whitening._column_sums(x).tolist() == [3, -(2**49) + 2**48 + 5]
    deviations = whitening._deviations(x, 10**6, (3, 7))
    assert [[int(e) for e in row] for row in deviations] == [[10**6 * int(e) - s for e, s in zip(row, (3, 7))] for row in x]
    assert whitening._squared_length(deviations) == [None, None, sum((10**6 * e - s) ** 2 for e, s in zip((3, 5), (3, 7)))]
