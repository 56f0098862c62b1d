import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellweft.llm import queries, whitening

FOLDER = "/root/testdata/sf0.001"


def plain(rows):
    """(n, sums, covariance, deviation per row) by plain loops and whole numbers."""
    x = [tuple(math.floor(64 * c) + 1_000_000 for c in v) for v in rows]
    unique = sorted(set(x))
    n, size = len(unique), len(unique[0])
    sums = [sum(v[j] for v in unique) for j in range(size)]
    away = np.array([[n * v[j] - sums[j] for j in range(size)] for v in unique], float) / n
    return x, n, sums, away.T @ away / n, [sum((n * a - s) ** 2 for a, s in zip(v, sums)) for v in x]


@pytest.mark.parametrize("shape", [(40, 5), (12, 7), (300, 33)])
def test_eigen_equals_the_library(shape):
    a = np.random.default_rng(sum(shape)).normal(size=shape) * np.logspace(0, 6, shape[1])
    covariance = a.T @ a / len(a)
    values, vectors = whitening.eigen(covariance)
    wanted = np.linalg.eigvalsh(covariance)[::-1][:len(values)]
    assert np.allclose(values, wanted, rtol=1e-9, atol=1e-12 * wanted[0])
    assert np.allclose(vectors.T @ vectors, np.eye(len(values)), atol=1e-12)
    assert np.allclose(vectors * values @ vectors.T, covariance, rtol=0, atol=1e-12 * wanted[0])


def test_directions_without_variance_are_left_out():
    a = np.random.default_rng(1).integers(-9, 9, (50, 3)).astype(float)
    a = np.hstack([a, a[:, :1] + a[:, 1:2], np.zeros((50, 1))])
    a -= a.mean(axis=0)
    values, vectors = whitening.eigen(a.T @ a / 50)
    assert len(values) == 3 and vectors.shape == (5, 3)
    assert whitening.eigen(np.zeros((4, 4)))[0].size == 0


def test_query_equals_plain_code(spark):
    rows = spark.read.parquet(f"{FOLDER}/embeddings.parquet").select("vec_id", "embedding").collect()
    usable = {r[0]: r[1] for r in rows if r[1] and all(c is not None and math.isfinite(c) for c in r[1])}
    x, n, sums, covariance, deviations = plain(usable.values())
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1][:16], vectors[:, ::-1][:, :16]
    told = {(r["vec_id"], r["component"]): r for r in queries.op12_cholesky_whitening(spark, FOLDER).collect()}
    assert len(told) == 16 * len(usable)
    away = np.array(x, float) - np.array(sums) / n
    whitened = away @ vectors / np.sqrt(values)
    for c in range(16):
        got = np.array([told[v, c + 1]["whitened"] for v in usable])
        sign = np.sign(got[0] * whitened[0, c])
        assert np.allclose(got * sign, whitened[:, c], atol=1e-8)
    for v, d in zip(usable, deviations):
        r = told[v, 1]
        assert (r["n"], r["deviation"]) == (n, d) and r["identity_error"] < 1e-9
        assert abs(r["explained"] - values[0] / np.trace(covariance)) < 1e-12


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.5, 1.0]), (1, [0.5, 1.0]), (2, None), (3, [None, 1.0]), (4, [nan, 1.0]), (5, [inf, 0.0]), (6, []),
            (None, [1.0, -2.0]), (7, [3.0, 4.0]), (8, [1.0, 2.0, 3.0]), (9, [1e300, 0.0]), (10, [0.001, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"x": F.lit("a"), "n": F.lit(0)})
    got = whitening.whiten(df).collect()
    assert sorted(r["id"] or 0 for r in got) == [0, 1, 1, 7, 10]
    x, n, sums, covariance, deviations = plain([[0.5, 1.0], [1.0, -2.0], [3.0, 4.0], [0.001, 1.0]])
    assert {r["n"] for r in got} == {4}
    assert {r["id"]: r["deviation"] for r in got} == dict(zip([1, None, 7, 10], deviations))
    assert all(len(r["whitened"]) == 2 for r in got) and got[0]["identity_error"] < 1e-12
    same = whitening.whiten(df.filter("vec_id = 1")).collect()
    assert [(r["whitened"], r["deviation"], r["n"]) for r in same] == [([], 0, 1)] * 2
    assert whitening.whiten(df.limit(0)).count() == whitening.whiten(df.filter("vec_id = 2")).count() == 0


def test_deviations_beyond_a_long_are_null():
    model = whitening.Whitening(2 ** 30, (0, 0), np.empty(0), np.empty((2, 0)), 0.0, 0.0)
    assert model.deviations(np.array([[2 ** 40, 0], [1, 1]])) == [None, 2 ** 61]
