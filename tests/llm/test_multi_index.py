import math

import numpy as np
import pytest

from triplane.llm import multi_index as M

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, every=M.EVERY, k=M.NEIGHBOURS):
    """{(query_id, vector): [(score, vec_id)]} by all pairs."""
    fit = {}
    for i, v, *_ in rows:
        if v is not None and all(c is not None and math.isfinite(c) for c in v) and any(v):
            fit[i, tuple(float(np.float32(c)) for c in v)] = None
    by_size = {}
    for i, v in fit:
        by_size.setdefault(len(v), []).append((i, v))
    out = {}
    for own in by_size.values():
        x, ids = np.array([v for _, v in own]), [i for i, _ in own]
        for i, v in own:
            if i is not None and i % every == 0:
                far = M.distance(x, np.array(v))
                out[i, v] = sorted(((f, j) for f, j in zip(far, ids) if j != i), key=lambda s: (s[0], s[1] is None, s[1]))[:k]
    return out


def lists(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["score"], r["vec_id"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def recall(got, want):
    met = sum(len({v for _, v in got.get(q, [])} & {v for _, v in own}) for (q, _), own in want.items())
    return met / sum(len(own) for own in want.values())


def spread(n, d=16, seed=0, cones=20):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(cones, d))
    return [(i, (centres[i % cones] + r.normal(size=d) * 0.5).tolist(), 1) for i in range(n)]


def test_small_tables_are_exact(spark):
    """Fewer entries than a query meets, or so few that measuring finds all needed."""
    rows = spread(60)
    got = lists(M.digest(spark.createDataFrame(rows, SCHEMA), every=7, recall=1.0).collect())
    assert got == {q: own for (q, _), own in brute(rows, 7).items()}


@pytest.mark.parametrize("cones", [1, 200])
def test_recall_and_scores(spark, cones):
    rows = spread(3000, 24, 1, cones)
    want = brute(rows, 20)
    got = lists(M.digest(spark.createDataFrame(rows, SCHEMA), every=20).collect())
    assert set(got) == {q for q, _ in want} and recall(got, want) >= 0.93
    exact = {i: np.array([float(np.float32(c)) for c in v]) for i, v, _ in rows}
    for q, own in got.items():
        assert len(own) == 10 and own == sorted(own)
        assert all(s == M.distance(exact[v][None], exact[q])[0] for s, v in own)


def test_given_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in table.collect()]
    got = lists(M.digest(table, every=20).collect())
    assert recall(got, brute(rows, 20)) >= 0.9
    assert M.digest(table.limit(0)).count() == 0


def test_only_part_of_the_index_is_met(spark):
    rows = spark.createDataFrame(spread(4000, 16, 2, 200), SCHEMA)
    entries = M.materialise(M.entries_of(rows).withColumn("least", M.F.coalesce("least", M.F.lit(M.NO_ID))))
    queries = entries.where("least % 100 = 0").select(M.F.col("least").alias("query"), "embedding")
    few = M.search(entries, queries, 10, enough=1).groupBy("query").count().collect()
    assert max(r["count"] for r in few) <= 10 and sum(r["count"] for r in few) < 400  # one cell each
    assert M.search(entries, queries, 10, enough=4000).count() == 400


def test_walk_is_in_order():
    r = np.random.default_rng(5)
    a, b, counts = r.random(9), r.random(7), r.integers(0, 3, size=(9, 7))
    met = M.walk(a, b, counts, 10**9)
    assert len(met) == (counts > 0).sum() == len(set(met))
    sums = [a[i] + b[j] for i, j in met]
    assert sums == sorted(sums)
    short = M.walk(a, b, counts, 10)
    assert short == met[: len(short)] and sum(counts[c] for c in short[:-1]) < 10 <= sum(counts[c] for c in short)


def test_crowds(spark, monkeypatch):
    """Groups are cut, of entries and of queries; copies of one vector are a third of the table."""
    monkeypatch.setattr(M, "PART", 30)
    monkeypatch.setattr(M, "QUERIES", 5)
    rows = spread(400, 8, 3, 2)
    rows += [(1000 + i, rows[0][1], 1) for i in range(200)]
    want = brute(rows, 5)
    got = lists(M.digest(spark.createDataFrame(rows, SCHEMA), every=5, recall=1.0).collect())
    assert recall(got, want) >= 0.99
    assert got[0] == [(0.0, 1000 + i) for i in range(10)] and got[1000][0] == (0.0, 0)


def test_awkward_vectors(spark):
    rows = [
        (0, [1.0, 0.0], 1), (0, [1.0, 0.0], 1), (100, [1.0, 0.0], None), (None, [1.0, 0.0], 1), (None, [0.5, 0.5], 1), (3, [0.0, 1.0], 1), (200, [0.0, 0.0], 1),
        (300, None, 1), (400, [float("nan"), 1.0], 1), (500, [None, 1.0], 1), (600, [], 1), (700, [1.0, 2.0, 3.0], 1), (800, [2.0], 1),
        (801, [3.0], 1), (900, [float("inf"), 0.0], 1), (1000, [3e38, 3e38], 1), (1100, [1e-30, 0.0], 1),
    ]
    got = lists(M.digest(spark.createDataFrame(rows, SCHEMA).withColumn("rank", M.F.lit("x")).withColumn("query", M.F.lit(1)), recall=1.0).collect())
    assert got == {q: own for (q, _), own in brute(rows).items() if own}


def test_one_id_with_two_vectors(spark):
    rows = [(0, [1.0, 0.0], 1), (0, [0.0, 1.0], 1), (1, [1.0, 0.1], 1), (2, [0.1, 1.0], 1)]
    got = M.digest(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r["rank"], r["vec_id"]) for r in got) == [(1, 1), (1, 2), (2, 1), (2, 2)]
