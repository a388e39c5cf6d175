"""Whitening against numpy's eigenvectors and exact integers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import DATA
from tidefold.llm import queries, whitening
from tidefold.llm.whitening import Shape, directions, whitened


def padded(a):
    r = np.linalg.qr(a, mode="r")
    return np.vstack([r, np.zeros((max(0, a.shape[1] - len(r)), a.shape[1]))])


def test_values_and_directions():
    rng = np.random.default_rng(1)
    for t in range(150):
        d, n = int(rng.integers(1, 30)), int(rng.integers(1, 60))
        a = rng.normal(size=(n, d)) * 10.0 ** rng.uniform(-8, 8, d) if t % 3 == 0 else rng.normal(size=(n, d)) if t % 3 == 1 else rng.integers(0, 3, (n, d)).astype(float)
        r = padded(a)
        values, z, total = directions(r, 8)
        s = np.linalg.svd(r, compute_uv=False) ** 2
        assert np.allclose(values, s[: len(values)], rtol=1e-10, atol=1e-13 * s[0]) and total == pytest.approx(s.sum())
        assert np.abs(z.T @ z - np.eye(z.shape[1])).max() < 1e-9
        assert np.linalg.norm(r.T @ (r @ z) - z * values) < 1e-11 * s[0]
    for r in (np.eye(9), np.zeros((5, 5)), np.diag([1.0, 1, 0, 0, 2]), padded(np.ones((6, 6))), 3 * np.eye(2)):
        values, z, _ = directions(r, 8)
        assert np.allclose(values, np.linalg.svd(r, compute_uv=False)[:8] ** 2) and np.allclose(z.T @ z, np.eye(z.shape[1]))


def test_small_values_are_accurate_relative_to_themselves():
    """Of a graded bidiagonal matrix, where eigenvalues of the product would be lost in rounding."""
    a, b = 10.0 ** -np.arange(0, 60, 6.0), 0.5 * 10.0 ** -np.arange(0, 54, 6.0)
    got = np.sqrt(whitening.dqds(a, b))
    assert got[0] == pytest.approx(np.linalg.norm([1, 0.5]), rel=1e-6) and np.prod(got / a) == pytest.approx(1.0, rel=1e-12)  # the product of all values is that of the diagonal


def expected(rows, k=8):
    x = np.floor(1024 * np.array(rows, float)).astype(np.int64) + 100_000
    n, s = len(x), x.sum(0)
    c = x - s / n
    v, u = np.linalg.eigh(c.T @ c / n)
    v, u = v[::-1], u[:, ::-1]
    deviation = [int(((n * r.astype(object) - s.astype(object)) ** 2).sum()) for r in x]
    return n, deviation, c @ u[:, :k] / np.sqrt(v[:k]), v[:k] / v.sum()


def test_query_is_numpy(spark):
    table = spark.read.parquet(f"{DATA}/embeddings.parquet").collect()
    rows = queries.op11_whitening(spark, DATA).collect()
    assert len(rows) == 8 * len(table)
    n, deviation, y, explained = expected([r.embedding for r in table])
    at = {r.vec_id: i for i, r in enumerate(table)}
    got = np.zeros_like(y)
    for r in rows:
        got[at[r.vec_id], r.component - 1] = r.whitened
        assert r.n == n and r.deviation == deviation[at[r.vec_id]] and r.explained == pytest.approx(explained[r.component - 1], rel=1e-9) and r.identity_error < 1e-9
    assert np.abs(got * np.sign((got * y).sum(0)) - y).max() < 1e-9


def test_odd_vectors_many_tasks_and_a_hot_one(spark):
    rng = np.random.default_rng(3)
    good = [(i, [float(v) for v in rng.normal(size=5)]) for i in range(60)] + [(None, [0.25, -0.5, 1.0, 2.0, 3.0])] * 40
    odd = [(1000, None), (1001, []), (1002, [1.0, None, 1.0, 1.0, 1.0]), (1003, [float("nan")] * 5), (1004, [float("inf"), 0.0, 0.0, 0.0, 0.0]), (1005, [1.0, 2.0]), (1006, [1e30] * 5)]
    df = spark.createDataFrame(odd[:4] + good + odd[4:], "vec_id long, embedding array<float>").withColumn("n", F.lit("clash")).withColumn("r", F.lit("clash")).repartition(40)
    got = whitened(df, ["vec_id", "r", "n"], shape=Shape(fan_in=3, block=2)).collect()
    n, deviation, y, explained = expected([np.float32(v).tolist() for _, v in good])
    assert len(got) == 100 == n and {r.vec_id for r in got} == {i for i, _ in good} and {r.r for r in got} == {"clash"}
    by = {r.vec_id: r for r in got}
    own = np.array([by[i].whitened for i, _ in good])
    assert np.abs(own * np.sign((own * y).sum(0)) - y).max() < 1e-9 and [int(by[i].deviation) for i, _ in good] == deviation
    assert got[0].explained == pytest.approx(explained.tolist()) and got[0].identity_error < 1e-9


def test_flat_and_empty(spark):
    schema = "vec_id long, embedding array<double>"
    one = whitened(spark.createDataFrame([(1, [0.5, 0.25])] * 3, schema), ["vec_id"]).collect()
    assert [(r.n, int(r.deviation), r.whitened, r.explained, r.identity_error) for r in one] == [(3, 0, [None, None], [None, None], None)] * 3
    line = whitened(spark.createDataFrame([(i, [float(i), float(i)]) for i in range(4)], schema), ["vec_id"]).collect()  # one direction varies
    assert all(r.whitened[1] is None and r.explained == pytest.approx([1.0, 0.0]) and r.identity_error < 1e-12 for r in line)
    assert whitened(spark.createDataFrame([(1, None)], schema), ["vec_id"]).count() == 0 == whitened(spark.createDataFrame([], schema), ["vec_id"]).count()
    huge = whitened(spark.createDataFrame([(i, [float(1 << 29) * (i % 2)] * 4) for i in range(64)], schema), ["vec_id"]).first()
    assert int(huge.deviation) == 4 * (64 * 2**39 // 2) ** 2  # beyond 64 bits
