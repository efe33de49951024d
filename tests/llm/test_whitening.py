"""Whitening against a dense eigensolver, and the small solver by itself."""

import numpy as np
import pytest

from voxward.llm.bidiagonal import dqds, right_singular
from voxward.llm.whitening import WhitenParams, whiten

SCHEMA = "vec_id bigint, embedding array<float>, label int, value string, n string, part int, component string"
RNG = np.random.default_rng(4)


def table(spark, vectors, parts=4):
    rows = [(i, None if v is None else [None if x is None else float(x) for x in v], 0, "own", None, 3, "c") for i, v in vectors]
    return spark.createDataFrame(rows, SCHEMA).repartition(parts)


def check(got, vectors, components=8, rank=None):
    """``vectors`` are those that stay, by id; repeated rows are in the list twice."""
    x = np.floor(1024 * np.array([np.float32(v) for _, v in vectors], np.float64)).astype(int) + 100_000
    n, sums = len(x), x.sum(axis=0)
    centred = (n * x - sums) / n
    values, directions = np.linalg.eigh(centred.T @ centred / n)
    values, directions = values[::-1], directions[:, ::-1]
    k = min(components, len(values)) if rank is None else rank
    rows = got.toPandas()
    assert len(rows) == n * k and list(rows.columns) == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    if not k:
        return
    assert (rows["n"] == n).all() and rows["identity_error"].nunique() == 1 and rows["identity_error"][0] < 1e-9
    wide = rows.drop_duplicates(["vec_id", "component"]).pivot(index="vec_id", columns="component", values="whitened")
    exact = {i: sum(int(d) ** 2 for d in n * row - sums) for (i, _), row in zip(vectors, x, strict=True)}
    assert all(int(d) == exact[i] for i, d in zip(rows["vec_id"], rows["deviation"], strict=True))
    assert np.allclose(rows.groupby("component")["explained"].first(), values[:k] / values.sum(), rtol=1e-9)
    want = centred @ directions[:, :k] / np.sqrt(values[:k])
    mine = wide.loc[[i for i, _ in vectors]].to_numpy()
    cov = mine.T @ mine / n - np.outer(mine.mean(axis=0), mine.mean(axis=0))
    assert np.abs(cov - np.eye(k)).max() < 1e-9
    for j in range(k):
        apart = min(abs(values[j] - v) for i, v in enumerate(values) if i != j) / values[j] if len(values) > 1 else 1
        if apart > 1e-6:
            assert min(np.abs(mine[:, j] - want[:, j]).max(), np.abs(mine[:, j] + want[:, j]).max()) < 1e-6


def vectors(n, dim, first=0):
    mix = RNG.normal(size=(dim, dim))
    return [(first + i, [float(np.float32(c)) for c in v]) for i, v in enumerate(RNG.normal(size=(n, dim)) @ mix + 3)]


@pytest.mark.parametrize("n,dim,parts", [(300, 12, 4), (40, 3, 7), (5, 9, 3), (400, 64, 2)])
def test_same_as_dense(spark, n, dim, parts):
    rows = vectors(n, dim)
    got = whiten(table(spark, rows, parts), WhitenParams(block=16, factor_bytes=1))
    check(got, rows, rank=min(8, dim, n - 1))


def test_rows_that_do_not_count(spark):
    good = vectors(50, 5)
    nan, inf = float("nan"), float("inf")
    bad = [(100, None), (101, []), (102, [1, 2, None, 4, 5]), (103, [nan] * 5), (104, [1, inf, 1, 1, 1]), (105, [1.0] * 4), (106, [1e30] * 5)]
    twice = [*good, good[3], good[3]]
    check(whiten(table(spark, twice + bad)), twice)


def test_equal_and_no_vectors(spark):
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])], [(i, [0.5, 0.25]) for i in range(9)]):
        assert whiten(table(spark, rows)).count() == 0


def test_close_eigenvalues(spark):
    """Cross-polytope points: all eigenvalues are equal, so any directions will do."""
    rows = [(2 * i + s, [(1 - 2 * s) * float(j == i) for j in range(12)]) for i in range(12) for s in (0, 1)]
    check(whiten(table(spark, rows)), rows)


def test_exact_beyond_64_bits(spark):
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(RNG.normal(size=(60, 4)) * 1e8)]
    check(whiten(table(spark, rows)), rows)


@pytest.mark.parametrize("seed", range(6))
def test_singular_values(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(1, 40))
    turn, other = np.linalg.qr(rng.normal(size=(n, n)))[0], np.linalg.qr(rng.normal(size=(n, n)))[0]
    for values in (10.0 ** -rng.integers(0, 6, n), rng.integers(0, 3, n).astype(float), np.ones(n), rng.random(n)):
        matrix = turn @ np.diag(values) @ other
        got, z = right_singular(matrix, 8)
        assert np.allclose(got, np.sort(values**2)[::-1], atol=1e-13)
        assert np.abs(z @ z.T - np.eye(len(z))).max(initial=0) < 1e-11
        residual = [np.linalg.norm(matrix.T @ (matrix @ v) - g * v) for v, g in zip(z, got, strict=False)]
        assert max(residual, default=0) < 1e-10 and len(z) == min(8, int((values > 0).sum()))


def test_small_values_to_high_relative_accuracy():
    """A graded matrix: squares from 1 down to 10 to the power of -40."""
    diagonal, above = 10.0 ** -np.arange(0, 21, 2), np.full(10, 0.0)
    above[:] = diagonal[1:] * 0.5
    got = dqds(diagonal, above)
    product = np.prod(got)
    assert np.isclose(product, np.prod(diagonal**2), rtol=1e-12) and got[-1] < 1e-39
