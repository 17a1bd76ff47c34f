"""Whitening against a covariance of Python's own fractions."""

import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import whitening
from quern.session import table
from tests.conftest import DATA


def slow(rows, components=8):
    """Checks rows of the result against the vectors (vec_id, list of floats) that take part."""
    x = [[math.floor(1024 * c) + 100_000 for c in v] for _, v in rows]
    n, d = len(x), len(x[0])
    sums = [sum(r[j] for r in x) for j in range(d)]
    centred = np.array([[float(Fraction(n * r[j] - sums[j], n)) for j in range(d)] for r in x])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = min(components, int((values > values.sum() * d * 1e-13).sum()))
    whitened = centred @ vectors[:, :k] / np.sqrt(values[:k])
    return n, [sum((n * r[j] - sums[j]) ** 2 for j in range(d)) for r in x], whitened, values[:k] / values.sum()


def held(got, rows, atol=1e-6):
    n, deviation, whitened, explained = slow(rows)
    k = whitened.shape[1]
    got = got.orderBy("_place", "component").collect()
    assert len(got) == len(rows) * k and {r.n for r in got} == {n}
    w = np.array([r.whitened for r in got]).reshape(-1, k)
    assert [r.vec_id for r in got[::k]] == [i for i, _ in rows] and [r.component for r in got] == list(range(1, k + 1)) * len(rows)
    assert [r.deviation for r in got[::k]] == deviation
    sign = np.sign((w * whitened).sum(axis=0))
    assert np.allclose(w * sign, whitened, atol=atol)
    assert np.allclose([r.explained for r in got[:k]], explained, rtol=1e-9)
    error = np.abs(np.cov(w.T, bias=True).reshape(k, k) - np.eye(k)).max()
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error == pytest.approx(error, abs=1e-12) and got[0].identity_error < 1e-4


def placed(spark, rows, kind="float"):
    """The result with each row's place, by ids that are all different."""
    vectors = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").repartition(4)
    place = spark.createDataFrame([(i, k) for k, (i, _) in enumerate(rows)], "vec_id long, _place int")
    return whitening.whiten(vectors).join(place, "vec_id")


def test_supplied(spark):
    vectors = table(spark, f"{DATA}/sf0.01", "embeddings")
    rows = [(r.vec_id, r.embedding) for r in vectors.orderBy("vec_id").collect()]
    held(placed(spark, rows), rows)


@pytest.mark.parametrize("offset", [0.0, 1000.0, -2_000_000.0])
def test_far_from_zero(spark, offset):
    """Correlated vectors far from zero lose nothing; doubles of any size do."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(900, 12)) @ rng.normal(size=(12, 12)) * 0.3 + offset
    rows = [(i, v) for i, v in enumerate(x.tolist())]
    held(placed(spark, rows, "double"), rows)


def test_few_directions(spark):
    """Fewer components where vectors have fewer directions; none where all are equal or there is one."""
    rows = [(i, [float(i % 5), float(i % 3), 2.0, float(i % 5)]) for i in range(60)]
    held(placed(spark, rows), rows)
    for some in (rows[:1], [(i, [1.0, 2.0]) for i in range(9)]):
        assert whitening.whiten(spark.createDataFrame(some, "vec_id long, embedding array<float>")).count() == 0


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    good = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [3.0, -1.0]), (None, [0.0, 0.5]), (4, [0.0, 0.0])]
    bad = [(5, None), (6, []), (7, [None, 1.0]), (8, [nan, 1.0]), (9, [inf, 1.0]), (10, [1.0]), (11, [1.0, 2.0, 3.0])]
    vectors = spark.createDataFrame(good + bad, "vec_id long, embedding array<float>")
    vectors = vectors.withColumns({c: F.lit(1) for c in ("n", "vector", "component", "d", "slot")})
    got = whitening.whiten(vectors).collect()
    assert sorted(str(r.vec_id) for r in got) == sorted(str(i) for i, _ in good for _ in range(2))
    n, deviation, whitened, _ = slow(good)
    assert {r.n for r in got} == {n} and sorted(r.deviation for r in got) == sorted(deviation * 2)
    assert np.allclose(sorted(abs(r.whitened) for r in got), sorted(abs(whitened.ravel())))
    assert whitening.whiten(vectors.limit(0)).count() == 0 and whitening.whiten(vectors.filter("vec_id > 4 AND vec_id < 10")).count() == 0
    with pytest.raises(Exception, match="cannot be scaled"):
        whitening.whiten(spark.createDataFrame([(1, [3e6]), (2, [0.0])], "vec_id long, embedding array<double>")).count()


def test_residues():
    primes = whitening.primes(1 << 120)
    assert all(p < 1 << 22 and all(p % q for q in range(2, 2100)) for p in primes) and math.prod(primes) > 1 << 120 >= math.prod(primes[:-1])
    rng = np.random.default_rng(3)
    x = rng.integers(-(1 << 31), 1 << 31, (1500, 5))
    whole = whitening.remaindered({p: whitening.residue_scatter(x, p) for p in primes})
    y = np.column_stack([x, np.ones(len(x), dtype=np.int64)]).astype(object)
    assert (whole == y.T @ y).all()


def test_long_deviations():
    big = np.array([[1 << 40, -(1 << 31)], [3, 4]])
    assert whitening.deviation(big).tolist() == [(1 << 80) + (1 << 62), 25]
    assert whitening.deviation(big[1:]).tolist() == [25]
