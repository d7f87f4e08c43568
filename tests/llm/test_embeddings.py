import math

import numpy as np
import pytest

from triplane.llm import embed_passes as E


def brute(rows, threshold=0.98):
    """{index: (links, root index)} by all pairs."""
    def good(v):
        return v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)

    n = len(rows)
    root, links = list(range(n)), [0] * n

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(n):
        for j in range(i):
            (_, a, la), (_, b, lb) = rows[i], rows[j]
            if la is not None and la == lb and good(a) and good(b) and len(a) == len(b):
                cos = np.dot(a, b) / np.sqrt(np.dot(a, a) * np.dot(b, b))
                if cos >= threshold:
                    links[i] += 1
                    links[j] += 1
                    x, y = sorted((top(i), top(j)))
                    root[y] = x
    return {i: (links[i], top(i)) for i in range(n)}


def check(spark, rows):
    got = {r.vec_id: r for r in E.digest(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], c) for i, v, c in rows]
    want = brute(rows)
    least = {}
    for k, (_, r) in want.items():
        least[r] = min(least.get(r, rows[k][0]), rows[k][0])
    for k, (links, r) in want.items():
        x = got[rows[k][0]]
        assert (x.n_links, x.component_id, x.kept) == (links, least[r], least[r] == x.vec_id), rows[k]


def test_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(E, "PART", 40)
    r = np.random.default_rng(1)
    rows = []
    for c in range(3):
        for _ in range(30):
            base = r.normal(size=16)
            rows += [(base + r.normal(size=16) * 0.08 * k).tolist() for k in range(r.integers(1, 4))]
    hot = r.normal(size=16)
    rows += [(hot + r.normal(size=16) * 0.1).tolist() for _ in range(150)]  # one crowded neighbourhood
    rows += [hot.tolist()] * 30  # and copies
    rows = [(7 * i % 1009, v, i % 2) for i, v in enumerate(rows)]
    check(spark, rows)


def test_awkward_vectors(spark):
    rows = [
        (1, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (3, [1.0, 0.0], None), (4, None, 1), (5, [0.0, 0.0], 1), (6, [0.0, 0.0], 1),
        (7, [float("nan"), 1.0], 1), (8, [float("inf"), 1.0], 1), (9, [None, 1.0], 1), (10, [2.0, 0.0], 1), (11, [1.0, 0.0], 2),
        (12, [], 1), (13, [1.0, 0.0, 0.0], 1), (14, [-1.0, 0.0], 1), (15, [1e-30, 0.0], 1), (16, [3e38, 3e37], 1),
    ]
    check(spark, rows)


def test_given_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    check(spark, [(r.vec_id, r.embedding, r.label) for r in table.collect()])
    assert E.digest(table.limit(0)).count() == 0


@pytest.mark.parametrize("cone", [0.0, 0.9, 0.97])
def test_recall_where_windows_bind(spark, cone):
    """Thousands of vectors of one label, all within a cone of that mutual cosine, and 300 close pairs."""
    r = np.random.default_rng(3)
    n, d = 4000, 64
    away = lambda k: np.stack([v / np.linalg.norm(v) for v in r.normal(size=(k, d)) * (np.arange(d) > 0)])
    x = np.sqrt(1 - cone) * away(n)
    x[:, 0] = np.sqrt(cone)
    own = x[:300, 1:] / np.linalg.norm(x[:300, 1:], axis=1, keepdims=True)
    side = away(300)[:, 1:]
    side -= (side * own).sum(axis=1, keepdims=True) * own
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    target = 0.982
    within = min(1.0, (target - cone) / (1 - cone))
    y = np.concatenate([np.full((300, 1), np.sqrt(cone)), np.sqrt(1 - cone) * (within * own + np.sqrt(1 - within**2) * side)], axis=1)
    both = np.concatenate([x, y])
    g = both.astype(np.float32).astype(float)
    g /= np.linalg.norm(g, axis=1, keepdims=True)
    true = int(((g @ g.T) >= E.THRESHOLD).sum()) - len(g)
    docs = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(both)], "vec_id long, embedding array<float>, label int")
    got = sum(v.n_links for v in E.digest(docs).collect())
    assert true >= 600 and 0.95 * true <= got <= true


def clustered(clusters, each, d=64, inner=0.95, close=40, seed=5):
    """Vectors in clusters of that mutual cosine; the last ones of each cluster have a partner at 0.981."""
    r = np.random.default_rng(seed)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    out = []
    for _ in range(clusters):
        middle = unit(r.normal(size=(1, d)))
        away = r.normal(size=(each, d))
        away = unit(away - (away @ middle.T) * middle)
        x = np.sqrt(inner) * middle + np.sqrt(1 - inner) * away
        side = r.normal(size=(close, d))
        side -= (side @ middle.T) * middle
        own = away[:close]
        side = unit(side - (side * own).sum(axis=1, keepdims=True) * own)
        within = (0.981 - inner) / (1 - inner)
        out += [x, np.sqrt(inner) * middle + np.sqrt(1 - inner) * (within * own + np.sqrt(1 - within**2) * side)]
    return np.concatenate(out).astype(np.float32)


def test_recall_in_clusters(spark):
    """One label holds ten cones, not one: thirty thousand vectors, each nearly as close to thousands of others as to its partner."""
    x = clustered(10, 3000)
    g = x.astype(float)
    g /= np.linalg.norm(g, axis=1, keepdims=True)
    true = sum(int((g[i : i + 2000] @ g.T >= E.THRESHOLD).sum()) for i in range(0, len(g), 2000)) - len(g)
    docs = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int")
    got = sum(v.n_links for v in E.digest(docs).collect())
    assert true >= 800 and 0.95 * true <= got <= true


def test_labels_that_need_too_many_passes_are_compared_whole(spark, monkeypatch):
    monkeypatch.setattr(E, "PASSES", 1)
    monkeypatch.setattr(E, "WINDOW", 2)
    monkeypatch.setattr(E, "PART", 100)
    x = clustered(2, 150, close=20)
    check(spark, [(i, v.tolist(), 1) for i, v in enumerate(x)])


@pytest.mark.parametrize("window,block", [(3, 10), (10, 20)])
def test_windows_reach_across_blocks(spark, window, block):
    """In one pass without crowds, every neighbour in the order is compared."""
    vectors = [(i, [math.cos(i * 0.1), math.sin(i * 0.1)], 1) for i in range(60)]  # neighbours have a cosine of 0.995
    nodes = E.nodes_of(spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int")).withColumn("dim", E.F.lit(2))
    from triplane.llm.components import components

    keys = nodes.select("node", "label", "dim", E.F.lit(0).alias("pass"), E.F.col("least").alias("key"))
    found = components(E.pass_links(nodes, keys, window=window, block=block), "a", "b")
    assert found.count() == 60 and found.select("root").distinct().count() == 1


def test_small_labels_go_the_same_way(spark, monkeypatch):
    """No label is compared whole because it is small: passes come first at any size, and here they find every link."""
    def never(*_):
        raise AssertionError("compared whole")

    monkeypatch.setattr(E, "all_links", never)
    x = clustered(2, 60, close=10)
    check(spark, [(i, v.tolist(), 1 if i < 115 else 2) for i, v in enumerate(x)])


def test_what_passes_leave_short_is_compared_whole(spark, monkeypatch):
    for name, value in (("PASSES", 1), ("MOST", 1), ("WINDOW", 1), ("RECALL", 2.0), ("PART", 100)):
        monkeypatch.setattr(E, name, value)
    calls, whole = [], E.all_links
    monkeypatch.setattr(E, "all_links", lambda *a: calls.append(1) or whole(*a))
    x = clustered(2, 80, close=10)
    check(spark, [(i, v.tolist(), 1) for i, v in enumerate(x)])
    assert calls == [1]
