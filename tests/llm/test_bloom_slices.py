import math
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from triplane.llm import bloom_slices as B

LOWER = str.maketrans(B.UPPER, B.LOWER)
DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"


def terms(text):
    return re.findall(B.TERM, (text or "").translate(LOWER))


def brute(docs, items):
    """Sorted rows (item_id, rank, doc_id, score), from every document."""
    cut = [(i, Counter(terms(t))) for i, t in docs]
    cut = [(i, c, c.total()) for i, c in cut if c]
    n, total = len(cut), sum(s for _, _, s in cut)
    df = Counter(t for _, c, _ in cut for t in c)
    out = []
    for item, text in set(items):
        own = set(terms(text))
        scored = []
        for i, c, size in cut:
            m = 100 - 90 + (90 * size * n) // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t in own if t in c)
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, r + 1, i, -s) for r, (s, _, _, i) in enumerate(sorted(scored)[: B.TOP])]
    return sorted(out, key=str)


def found(spark, docs, items):
    rows = B.search(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).collect()
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in rows), key=str)


def prose(r, words, n):
    return " ".join(words[min(len(words) - 1, int(r.exponential(40)))] for _ in range(n))


def made(seed, n=400):
    r = np.random.default_rng(seed)
    words = [f"w{i}" if i % 3 else f"Wé{i}ß" for i in range(300)]
    docs = [(i, prose(r, words, int(r.integers(0, 120)))) for i in range(n)]
    items = [(i, prose(r, words, 25)) for i in range(12)] + [(50, docs[5][1]), (51, docs[6][1])]
    return docs, items


def test_against_brute_force(spark):
    docs, items = made(0)
    docs += [(1000 + i, docs[5][1]) for i in range(150)]  # a group of copies above the ten
    docs += [(2000, "w1 " * 3000 + "w2"), (2001, " ".join(f"w{i}" for i in range(60_000)))]  # long ones
    assert found(spark, docs, items) == brute(docs, items)


@pytest.mark.parametrize("bits,hashes,documents,term_limit", [(1, 1, 8, 20_000), (12, 4, 16, 40)])
def test_poor_signatures_cost_work_only(spark, monkeypatch, bits, hashes, documents, term_limit):
    for name, value in (("BITS", bits), ("HASHES", hashes), ("DOCUMENTS", documents), ("TERMS", term_limit), ("BROADCAST", 0)):
        monkeypatch.setattr(B, name, value)
    docs, items = made(1, 150)
    assert found(spark, docs, items) == brute(docs, items)


def test_bounds_hold_and_prune(spark):
    docs, items = made(2)
    blocks = B.index(spark.createDataFrame(docs, DOCS)).collect()
    full = {(item, doc): score for item, _, doc, score in brute_all(docs, items)}
    cut = [Counter(terms(t)) for _, t in docs]
    n, total = sum(1 for c in cut if c), sum(c.total() for c in cut)
    df = Counter(t for c in cut for t in c)
    rows = [{"item": item, "term": t, "w": math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1)))} for item, text in items for t in set(terms(text)) if t in df]
    asked = B.Items(rows, n, total)
    close = checked = 0
    for block in blocks:
        bound = asked.bounds(block)
        for i, item in enumerate(asked.items):
            for j, doc in enumerate(block.ids):
                exact = full.get((item, doc), 0)
                assert bound[i, j] >= exact
                checked += 1
                close += bound[i, j] <= 1.1 * exact + 1000
    assert checked == len(set(i for i, _ in items)) * n and close > 0.8 * checked


def brute_all(docs, items):
    B_TOP, B.TOP = B.TOP, 10**9
    try:
        return brute(docs, items)
    finally:
        B.TOP = B_TOP


def test_terms_of_bytes_are_those_of_the_pattern(spark, monkeypatch):
    texts = ["", "  ", "Ab-cD ab cd", "É é ÀB x\u00a0y", "日本語 text。", "a" * 5000 + " b", "\x00a\x7fb", "x_y'z 1.5", "😀 a😀"]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select("text", B.terms_of(B.F.col("text")).alias("t")).collect()
    for limit in (1 << 21, 3):
        monkeypatch.setattr(B, "SLICE", limit)
        for r in rows:
            assert r.t == terms(r.text)
            assert B.text_terms(r.text.encode()).tolist() == [int(B.text_terms(t.encode())[0]) for t in r.t]
    words = [f"w{i}" for i in range(50_000)]
    assert len(set(B.text_terms(" ".join(words).encode()).tolist())) == len(words)


def test_odd_rows(spark):
    docs = [(1, None), (2, ""), (3, "--"), (4, "alpha beta"), (4, "alpha beta"), (4, "alpha"), (None, "alpha beta"), (None, "gamma"), (5, "delta " * 40)]
    items = [(1, "Alpha, beta!"), (1, "Alpha, beta!"), (2, None), (3, ""), (4, "nowhere"), (1, "gamma"), (None, "delta")]
    assert found(spark, docs, items) == brute(docs, items)
    assert found(spark, [], items) == [] and found(spark, docs, []) == [] and found(spark, docs[:3], items) == []
    extra = spark.createDataFrame([(1, "a b", "x", 2)], "doc_id long, text string, term string, n int")
    assert B.search(extra, extra.withColumnRenamed("doc_id", "item_id")).count() == 1


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_against_sql(spark, sf):
    db = duckdb.connect()
    for t in ("documents", "benchmark"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/{sf}/{t}.parquet'")
    want = sorted(db.execute(B.SQL).fetchall())
    read = lambda t: spark.read.parquet(f"/root/testdata/{sf}/{t}.parquet")
    got = sorted(tuple(r[c] for c in ("item_id", "rank", "doc_id", "score")) for r in B.search(read("documents"), read("benchmark")).collect())
    assert got == want and len(got) > 100
