from collections import Counter

import duckdb

from triplane.llm import mixing as M


def test_targets_share_the_excess(spark):
    sized = spark.createDataFrame([("a", 100), ("b", 10), ("c", 50), (None, 40)], "source string, size long")
    got = {r.source: r.target for r in M.targets(sized).collect()}
    # weights 5, 2, 1, 5 of 300 words; b and d stop at twice their size
    assert got["b"] == 20 and got[None] == 80 and abs(sum(got.values()) - 300) < 1e-9
    assert abs(got["a"] / got["c"] - 5) < 1e-9 or got["a"] == 200


def test_prefix_sums_whatever_the_parts(spark):
    rows = [(i % 3, (i * 7919) % 1000, i) for i in range(500)]
    df = spark.createDataFrame(rows, "s long, k long, v long").repartition(7)
    got = {(r.s, r.k, r.v): r.before for r in M._before(df, "s", ["k", "v"], "v").collect()}
    for s in range(3):
        total = 0
        for row in sorted(r for r in rows if r[0] == s):
            assert got[row] == total
            total += row[2]


def test_mix_of_awkward_rows(spark):
    rows = [(i, "word " * (i % 50), f"s{i % 4}", "x") for i in range(400)] + [(1000, None, "s0", "x"), (1001, "", None, "x"), (None, "a b c", "s1", "x"), (None, "d e", "s1", "x"), (7, "a b", "s2", "y"), (7, "a b", "s2", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, mix_key string")
    out = M.mix(docs)
    assert out.columns == docs.columns
    mixed, given = Counter(tuple(r) for r in out.collect()), Counter(rows)
    assert mixed.keys() <= given.keys() and all(n <= 2 * given[k] for k, n in mixed.items())
    plan = M.plan(docs).collect()
    assert sum(r.copies for r in plan) == sum(mixed.values()) and len(plan) == len(rows)
    by_source = Counter()
    for r in M.digest(docs).join(docs.select("doc_id", "source").distinct(), "doc_id").where("doc_id != 7").collect():
        assert r.taken <= 2 * r["size"]
        by_source[(r.source, r.target)] += r.taken
    assert all(abs(n - t) <= 110 for (_, t), n in by_source.items())
    assert M.digest(docs).exceptAll(M.digest(docs.repartition(5))).count() == 0
    assert M.digest(docs.limit(0)).count() == 0 and M.mix(docs.limit(0)).count() == 0


def test_given_table_against_sql(spark):
    path = "/root/testdata/sf0.001/documents.parquet"
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}'")
    want = sorted(db.execute(M.SQL).fetchall())
    assert sorted(tuple(r) for r in M.digest(spark.read.parquet(path)).collect()) == want
