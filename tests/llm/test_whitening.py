"""Whitening against plain linear algebra over the whole list, and the refinement on clustered eigenvalues."""

import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from signalloom.llm import whitening


def rotation(n, seed):
    return np.linalg.qr(np.random.default_rng(seed).normal(size=(n, n)))[0]


@pytest.mark.parametrize(
    "values",
    [
        [5.0, 3.0, 2.0, 1.0, 0.5, 0.1],
        [4.0, 4.0, 4.0, 1.0, 1.0, 0.0],
        [1 + 1e-9, 1.0, 1 - 1e-9, 1 - 2e-9, 1e-3, 1e-6],
        [1e6, 1e6 * (1 - 1e-12), 5.0, 5.0 + 1e-7, 1e-8, 0.0],
        [7.0] * 6,
        [0.0] * 6,
    ],
)
def test_refined_vectors_have_full_precision(values):
    for seed in range(4):
        q = rotation(len(values), seed).astype(np.longdouble)
        matrix = ((q * values) @ q.T).astype(float)
        matrix = (matrix + matrix.T) / 2
        found, vectors = whitening.refined_eigen(matrix)
        size = max(values) or 1.0
        assert (np.diff(found) <= 0).all()
        assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-14
        assert np.abs(matrix @ vectors - vectors * found).max() < 2e-15 * size * len(values)
        assert np.abs(np.sort(found) - np.linalg.eigvalsh(matrix)).max() < 1e-14 * size


def test_separate_vectors_are_better_than_the_float_start():
    q = rotation(40, 9)
    values = np.linspace(1, 2, 40)
    matrix = (q * values) @ q.T
    matrix = (matrix + matrix.T) / 2
    exact, vectors = np.linalg.eigh(matrix)
    _, mine = whitening.refined_eigen(matrix)
    assert np.abs(np.abs((vectors[:, ::-1] * mine).sum(axis=0)) - 1).max() < 1e-14
    start = np.linalg.eigh(matrix.astype(np.float32))[1][:, ::-1]
    assert np.abs(matrix @ start - start * exact[::-1]).max() > 1e-8


def test_whitening_equals_plain_version(spark, monkeypatch):
    monkeypatch.setattr(whitening, "FAN", 2)
    rng = np.random.default_rng(3)
    data = (rng.normal(size=(400, 6)) * [3, 1, 1, 0.5, 0.2, 0.1]).astype(np.float32).tolist()
    data += [data[0]] * 300 + [[-0.0] * 6]
    rows = [(i if i % 50 else None, v, 1.0) for i, v in enumerate(data)]
    odd = [(1, None), (2, [1.0] * 5 + [None]), (3, [math.nan] * 6), (4, [math.inf] * 6), (5, [1.0]), (6, [])]
    df = spark.createDataFrame(rows + [(i, v, 0.0) for i, v in odd], "vec_id long, embedding array<float>, whitened double").repartition(5)
    got = whitening.whiten(df).collect()
    x = [[math.floor(256 * c) for c in v] for v in data]
    fit = [list(v) for v in {tuple(v) for v in x}]
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    centred = np.array([[float(Fraction(a) - Fraction(s, n)) for a, s in zip(v, sums)] for v in fit])
    covariance = centred.T @ centred / n
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1], vectors[:, ::-1]
    assert len(got) == 4 * len(data) and {r["n"] for r in got} == {n}
    assert max(r["identity_error"] for r in got) < 1e-9
    want = {}
    for (i, _, _), v in zip(rows, x):
        y = np.array([float(Fraction(a) - Fraction(s, n)) for a, s in zip(v, sums)])
        deviation = sum((n * a - s) ** 2 for a, s in zip(v, sums))
        for k in range(4):
            want.setdefault((i, k + 1, deviation), []).append((y @ vectors[:, k] / math.sqrt(values[k]), k))
    sign = {}
    for r in got:
        candidates = want[r["vec_id"], r["component"], r["deviation"]]
        k = r["component"] - 1
        assert r["explained"] == pytest.approx(values[k] / np.trace(covariance), rel=1e-12)
        w = candidates[0][0]
        if abs(w) > 1e-3:
            assert sign.setdefault(k, math.copysign(1, w * r["whitened"])) == math.copysign(1, w * r["whitened"])
        assert abs(abs(w) - abs(r["whitened"])) < 1e-9


def test_few_vectors_and_large_ones(spark):
    schema = "vec_id long, embedding array<double>"
    assert whitening.whiten(spark.createDataFrame([], schema)).collect() == []
    same = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], schema)
    assert whitening.whiten(same).collect() == []
    two = whitening.whiten(spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 1.0])], schema)).orderBy("vec_id").collect()
    assert [(r["component"], r["n"], r["deviation"], r["explained"]) for r in two] == [(1, 2, 2 * 256**2, 1.0)] * 2
    assert [abs(round(r["whitened"], 12)) for r in two] == [1.0, 1.0]
    large = whitening.whiten(spark.createDataFrame([(1, [1e9, 0.0]), (2, [-1e9, 0.0]), (3, [1.0, 1.0])], schema))
    assert large.filter(F.col("vec_id") == 1).first()["deviation"] is None
