"""Batches that a task takes one after the other, against a job for each of them."""

import os

import numpy as np
from pyspark.sql import functions as F

from triplane.functions.draws import draw32, drawn_vector
from triplane import shared
from triplane.operators import rank, store, train


def ring(spark, n=60, relations=3):
    return spark.range(n).select(F.col("id").alias("pos"), F.col("id").alias("head_id"), F.pmod("id", F.lit(relations)).alias("relation_id"), ((F.col("id") + 1) % n).alias("tail_id"))


def vectors(tables):
    return {(tbl, r.trial, r.id): r.x for tbl, table in zip("er", tables, strict=True) for r in table.collect()}


def test_windows_take_the_steps_that_jobs_of_their_own_would(spark, monkeypatch):
    t, ids, links = ring(spark), spark.range(60), spark.range(3)
    table = spark.createDataFrame([(0, "boxe", 4), (1, "transe", 4)], "trial long, model string, dim long")
    names = {"transe": ("vec",), "boxe": train.BOXE_ENTITY}, {"transe": ("vec",), "boxe": train.BOXE_RELATION}
    settings = {
        0: train.Settings("boxe", loss="nssa", margin=3.0, rate=0.05, optimizer="adam", negatives="basic", k=1, n_batches=3, seed=4),
        1: train.Settings("transe", 1, rate=0.05, optimizer="adam", negatives="basic", k=1, n_batches=2, seed=5, normalise="step"),
    }
    start = train._start(ids, table, names[0]), train._start(links, table, names[1])
    stepwise = train.Trainer(t, *start, dict(settings), 60, 3)
    stepwise.run(2)
    want = vectors(stepwise.result())
    for window in (1, 1 << 20):  # a batch each, and all batches of an epoch in one
        monkeypatch.setattr(train, "WINDOW", window)
        windows = train.Windows(t, *start, dict(settings), {0: (8, 18), 1: (4, 4)}, 60, 3)
        windows.epoch()
        windows.epoch()
        got = vectors(windows.result())
        assert got.keys() == want.keys() and all(np.allclose(got[key], want[key], atol=1e-9) for key in want)


def test_jobs_of_a_search_do_not_follow_its_batches(spark):
    """Each batch of each epoch had a dozen jobs."""
    t, jobs = ring(spark), []
    for batch in (24, 6):
        table = spark.createDataFrame([(0, "transe", 4, 2, 0.01, batch)], "trial long, model string, dim long, p long, rate double, batch long")
        spark.sparkContext.setJobGroup(f"batches of {batch}", "")
        assert train.search(t, spark.range(60), spark.range(3), table, epochs=1).first()["metric"] <= 60
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"batches of {batch}")))
    assert abs(jobs[0] - jobs[1]) <= 2


def stored(folder):
    return [os.path.join(d, f) for d, _, files in os.walk(folder) for f in files if f.endswith(".parquet")]


def test_a_search_keeps_only_what_later_steps_read(spark, monkeypatch, tmp_path):
    """Rows of ended trials, ranked vectors, start vectors and shuffles all stayed on the disk."""
    monkeypatch.setattr(train, "shared_dir", lambda _: str(tmp_path / "windows"))
    monkeypatch.setattr(shared, "shared_dir", lambda _: str(tmp_path / "tables"))
    monkeypatch.setattr(train, "RANKED", 1)  # a trial at a time
    monkeypatch.setattr(train, "PASSED", 1)
    seen, ranks = [], train.trial_ranks

    def look(tests, entities, relations, settings):
        tables = {os.path.dirname(f) for f in stored(tmp_path / "tables")}
        kept = {f.split("next=")[1].split("/")[0] for f in stored(tmp_path / "windows")}
        seen.append((entities.select("trial").distinct().count(), len(tables), len(kept), len(settings), spark.conf.get(shared._CLEAN)))
        return ranks(tests, entities, relations, settings)

    monkeypatch.setattr(train, "trial_ranks", look)
    table = spark.createDataFrame([(i, m, 4, 2, 0.01, 24) for i, m in enumerate(("transe", "boxe", "transe", "boxe"))], "trial long, model string, dim long, p long, rate double, batch long")
    assert train.search(ring(spark), spark.range(60), spark.range(3), table).count() == 4
    # one trial's vectors, beside the split and the stored tables it came from; a folder for each trial that goes on
    assert [(n, kept, live) for n, _, kept, live, _ in seen] == [(1, 4, 4)] * 4 + [(1, 2, 2)] * 2 and len({tables for _, tables, *_ in seen}) == 1
    assert {clean for *_, clean in seen} == {"true"} and not stored(tmp_path / "windows") and spark.conf.get(shared._CLEAN) == "false"


def test_ranks_of_a_trial_copy_less(spark):
    assert rank.of_trial(1025, 10_256) == rank._sides(1025, 10_256, None, None) == (2, 11)
    assert rank.of_trial(10_256, 102_560) == (3, 26) and rank._sides(10_256, 102_560, None, None) == (6, 51)


def test_windows_hold_what_they_may(monkeypatch):
    monkeypatch.setattr(train, "WINDOW", 64 << 20)
    s = train.Settings(n_batches=33, negatives="basic", k=1)
    together = train.batches_together(s, 8205, (512, 1026), 10_256, 10)
    rows = [min(10_256, 3 * 249 * n) * 512 + 10 * 1026 for n in (together, together + 1)]
    assert rows[0] * 24 <= train.WINDOW < rows[1] * 24
    assert train.batches_together(s, 8205, (4, 4), 10_256, 10) == 33 and train.batches_together(s, 10**9, (512, 1026), 10**9, 10) == 1


def test_rows_without_momentum_stay(monkeypatch):
    x = store.unit(np.random.default_rng(3).normal(size=(4, 5)))
    none, rule = np.zeros_like(x), store.Rule(0.1, "adam", 1)
    monkeypatch.setattr(store, "_momentum", None)  # not called for them
    got = store.caught_up(x, none, none, np.array([0, 1, 2, 3]), 50, rule)
    assert np.allclose(got[0], x, atol=1e-15)
    moved = store.caught_up(2 * x, none, none, np.zeros(4, dtype=int), 3, store.Rule(0.1, "adam", 2))
    assert np.allclose(moved[0], x, atol=1e-15)


def test_rows_are_caught_up_like_each_alone():
    """Rows with and without momentum that last changed in different steps, more than are caught up at once."""
    rng, last = np.random.default_rng(5), np.random.default_rng(6).integers(0, 30, 150)
    x, m = rng.normal(size=(150, 4)), rng.normal(size=(150, 4)) * 0.01
    m[::3] = 0
    v = m * m
    for every in (0, 1, 7):
        rule = store.Rule(0.01, "adam", every)
        got = store.caught_up(x, m, v, last, 33, rule)
        for i in range(150):
            a, b, c = x[i : i + 1].copy(), m[i : i + 1].copy(), v[i : i + 1].copy()
            for step in range(last[i] + 1, 34):
                b, c = b * store.DECAY_M, c * store.DECAY_V
                a = a - store._momentum(b, c, step, rule.rate)
                a = store.unit(a) if every and step % every == 0 else a
            assert np.allclose(got[0][i], a[0], atol=1e-12) and np.allclose(got[1][i], b[0]) and np.allclose(got[2][i], c[0])


def test_vectors_drawn_in_python_are_those_of_the_expression(spark):
    key = F.concat_ws(":", F.lit(3), F.col("id"))
    want = spark.range(3).select(F.transform(F.sequence(F.lit(0), F.lit(11)), lambda i: (draw32("search:vec", key, i) / float(1 << 32) * 2 - 1) * 0.5).alias("x")).collect()
    assert [r.x for r in want] == [drawn_vector(f"search:vec:3:{i}", 12, 0.5).tolist() for i in range(3)]
