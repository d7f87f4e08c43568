import math

import numpy as np
import pytest

from triplane.llm import whitening as W

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, k=W.COMPONENTS):
    """{vec_id: (deviation, projections)}, explained shares, from numpy's own eigenvectors in double precision."""
    kept = [(i, [math.floor(256 * float(np.float32(c))) for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(v) for _, v in kept})
    n, d = len(fit), len(fit[0])
    sums = [sum(v[j] for v in fit) for j in range(d)]
    x = np.array(fit) - np.array([s / n for s in sums])
    e, axes = np.linalg.eigh(x.T @ x / n)
    e, axes = e[::-1], axes[:, ::-1]
    out = {i: (sum((n * c - s) ** 2 for c, s in zip(v, sums)), (np.array(v) - np.array(sums) / n) @ axes[:, :k] / np.sqrt(e[:k])) for i, v in kept}
    return n, out, e / e.sum()


def check(spark, rows):
    n, want, shares = brute([(i, v) for i, v, _ in rows])
    got = W.digest(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(want) * min(W.COMPONENTS, len(shares))
    signs = {}
    for r in got:
        deviation, white = want[r.vec_id]
        assert (r.n, r.deviation) == (n, deviation)
        assert r.explained == pytest.approx(shares[r.component - 1], rel=1e-10) and r.identity_error < 1e-9
        expected = white[r.component - 1]
        assert abs(r.whitened) == pytest.approx(abs(expected), rel=1e-8, abs=1e-9)
        if abs(expected) > 1e-6:
            assert signs.setdefault(r.component, r.whitened * expected > 0) == (r.whitened * expected > 0)


def test_against_numpy(spark):
    r = np.random.default_rng(0)
    x = r.normal(size=(300, 12)) * np.linspace(0.1, 2, 12) + r.normal(size=12)
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    rows += [(1000 + i, x[0].tolist(), None) for i in range(400)]  # copies count once
    rows += [(5000, None, 1), (5001, [float("nan")] * 12, 1), (5002, [None] * 12, 1), (5003, [float("inf")] + [0.0] * 11, 1)]
    check(spark, rows)


def test_given_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    check(spark, [tuple(r) for r in table.select("vec_id", "embedding", "label").collect()])
    assert W.digest(table.limit(0)).count() == 0


def with_values(values, seed=0):
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(len(values), len(values))))[0]
    m = (q * np.array(values)) @ q.T
    return (m + m.T) / 2


@pytest.mark.parametrize(
    "values",
    [
        np.linspace(1, 50, 40),
        [5, 5, 5, 3, 3, 1, 0, 0],  # equal ones
        [5 + 1e-9, 5, 5 - 1e-9, 2, 1e-12, 0],  # closer than single precision tells apart
        [1e6, 1e6 + 1e-3, 1, 1 + 1e-7, 1 - 1e-7, 1e-6],
        10.0 ** -np.arange(12),
        [0.0] * 5,
        [3.0],
    ],
)
def test_refinement(values):
    m = with_values(values)
    e, x = W.refined(m)
    top = max(1e-300, np.abs(m).max())
    assert np.abs(x.T @ x - np.eye(len(m))).max() < 1e-14
    assert np.abs(m @ x - x * e).max() < 5e-15 * top * len(m)
    assert np.allclose(e, np.linalg.eigvalsh(m)[::-1], rtol=0, atol=1e-14 * top * len(m))


def test_close_values_give_the_vectors_of_double_precision():
    values = [4, 3 + 1e-6, 3, 3 - 1e-6, 1, 0.5]
    m = with_values(values, 3)
    x = W.refined(m)[1]
    known = np.linalg.eigh(m)[1][:, ::-1]
    assert np.abs(np.abs((x * known).sum(axis=0)) - 1).max() < 1e-12 and np.abs(x * np.sign((x * known).sum(axis=0)) - known).max() < 1e-8


def test_odd_tables(spark):
    rows = [
        (1, [1.0, 2.0], 1), (1, [1.0, 2.0], 1), (None, [0.0, 5.0], None), (3, [2.0, 1.0], 1), (4, [], 1), (5, [3e38, 1.0, 1.0], 1),
        (6, [0.0, 0.0, -3e38], 1), (7, [7.0], 1), (8, None, 1),
    ]
    got = W.digest(spark.createDataFrame(rows, SCHEMA).withColumn("component", W.F.lit("x"))).collect()
    by = {}
    for r in got:
        by.setdefault(r.vec_id, []).append(r)
    assert {k: len(v) for k, v in by.items()} == {1: 4, None: 2, 3: 2, 5: 3, 6: 3, 7: 1}
    assert by[7][0].whitened is None and by[7][0].explained is None and by[7][0].deviation == 0
    assert by[5][0].deviation is None and by[1][0].n == 3
    assert by[None][0].deviation == (0 - 3 * 256) ** 2 + (15 * 256 - 8 * 256) ** 2
