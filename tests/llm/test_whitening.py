import numpy as np
import pytest

from tessel.llm import whitening
from tessel.llm.shared import table

ODD = "vec_id long, embedding array<float>, component string, n string, whitened string"


def plain(x, most=16):
    """n, deviations, whitened rows and shares of the variance by numpy's own eigenvectors."""
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(0)
    values, vectors = np.linalg.eigh(np.cov((fit - sums / n).T, bias=True))
    values, vectors = values[::-1], vectors[:, ::-1]
    white = (x - sums / n) @ vectors[:, :most] / np.sqrt(values[:most])
    return n, ((n * x - sums) ** 2).sum(1), white, values[:most] / values.sum()


def test_query_against_numpy(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").toPandas()
    x = np.floor(64 * np.stack(rows.embedding).astype(float)).astype(np.int64) + 1_000_000
    n, deviation, white, share = plain(x)
    got = whitening.op11_whitening(spark, sf_dir).toPandas().sort_values(["vec_id", "component"])
    order = np.argsort(rows.vec_id.to_numpy(), kind="stable")
    assert len(got) == len(rows) * 16 and set(got.n) == {n} and got.identity_error.max() < 1e-9
    assert (got.deviation.to_numpy().reshape(-1, 16) == deviation[order][:, None]).all()
    np.testing.assert_allclose(np.abs(got.whitened.to_numpy().reshape(-1, 16)), np.abs(white[order]), atol=1e-8)
    np.testing.assert_allclose(got.explained.to_numpy().reshape(-1, 16)[0], share, rtol=1e-12)


def test_gram_is_exact_for_any_size():
    for most in (50, 1 << 21, 1 << 30, (1 << 62) + 12345):
        y = np.random.default_rng(most).integers(-most, most, (300, 3))
        want = y.astype(object).T @ y.astype(object)
        assert (whitening.gram(y) == want).all()


def test_polynomial_against_known_roots(spark):
    assert whitening.characteristic(spark, [[2, 0, 0], [0, 3, 0], [0, 0, 7]]) == [-42, 41, -12, 1]
    big = [[10**30, 5, 0], [5, 10**30, 0], [0, 0, 4]]
    square = 10**60 - 25
    assert whitening.characteristic(spark, big) == [-4 * square, square + 8 * 10**30, -(2 * 10**30 + 4), 1]


def test_roots_with_multiplicity():
    p = whitening.RealRooted([0, 0, 2 * 2 * 2, -12, 6, -1][::1], 64)  # -x^2 (x - 2)^3
    assert p.above(0) == 3 and p.largest(16, 100 << 64) == [(2 << 64, 3)]
    near = whitening.RealRooted([6, -5, 1], 8)
    assert near.largest(16, 100 << 8) == [(3 << 8, 1), (2 << 8, 1)]
    assert near.largest(1, 100 << 8) == [(3 << 8, 1)]


def test_close_roots_get_their_own_vectors():
    # Eigenvalues differ by 2 in 10 ** 30: doubles can't tell them apart.
    vectors = [whitening.null_space([[10**30, 1], [1, 10**30]], (10**30 + sign) << 40, 40, 1)[0] for sign in (1, -1)]
    np.testing.assert_allclose(np.abs(vectors), np.sqrt(0.5))
    assert vectors[0][0] * vectors[0][1] > 0 > vectors[1][0] * vectors[1][1]
    double = np.array(whitening.null_space([[5, 0, 0], [0, 5, 0], [0, 0, 1]], 5 << 40, 40, 2))
    np.testing.assert_allclose(double @ double.T, np.eye(2), atol=1e-15)
    assert np.abs(double[:, 2]).max() < 1e-15


def test_odd_rows(spark):
    rng = np.random.default_rng(3)
    plane = [[float(a), float(b), float(a + b)] for a, b in rng.integers(-9, 9, (40, 2))]  # rank 2
    rows = [(i, v, "own", "own", "own") for i, v in enumerate(plane)]
    rows += [(0, plane[0], None, None, None), (None, plane[1], None, None, None)]  # repeated and null ids take part
    rows += [(90, None, None, None, None), (91, [], None, None, None), (92, [1.0, None, 2.0], None, None, None), (93, [1.0, float("nan"), 2.0], None, None, None), (94, [float("inf"), 0.0, 0.0], None, None, None), (95, [1.0, 2.0], None, None, None)]
    out = whitening.whiten(spark.createDataFrame(rows, ODD), "vec_id", "embedding").toPandas()
    assert len(out) == 42 * 2 and set(out.component) == {1, 2} and out.identity_error.max() < 1e-9
    assert out.n.unique().tolist() == [len({tuple(v) for v in plane})] and out.vec_id.isna().sum() == 2
    assert abs(out.groupby("component").explained.first().sum() - 1) < 1e-12


@pytest.mark.parametrize("vectors", [[], [[1.0, 2.0]] * 3, [None]])
def test_nothing_to_whiten(spark, vectors):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>")
    out = whitening.whiten(rows, "vec_id", "embedding")
    assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"] and out.count() == 0


def test_huge_entries_have_no_deviation(spark):
    rows = spark.createDataFrame([(1, [1e17, 0.0]), (2, [-1e17, 1.0]), (3, [0.0, 2.0])], "vec_id long, embedding array<double>")
    out = whitening.whiten(rows, "vec_id", "embedding").toPandas()
    assert len(out) == 6 and out.deviation.isna().any() and out.identity_error.max() < 1e-4
