"""TransE by updates one after the other, in strata.

A sample's update changes the vectors of its triple and of its corruption, so samples that share a vector have to wait for each
other. Entities are dealt into 2 * parts blocks and relations into ``parts``, and a triple belongs to a task: the blocks of its
two ends and of its relation. A stratum is a set of tasks no two of which share a block, so they run side by side, each with
updates in order, and the result is that of one long loop (Gemulla et al. 2011 do so for matrices). Strata follow each other;
together they hold every task once an epoch (:func:`strata`).

Corrupted ids are drawn from the block of the id they replace, so that they stay in the task. Relations are few, and so is
the number of parts. A stratum reads the rows it touches, and writes those it changes
(:mod:`triplane.operators.store`).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triplane.functions.draws import draw32, draw_below
from triplane.operators.store import SCHEMA, Rule, Store, unit
from triplane.shared import discard, materialise


def pairings(n: int) -> list[list[tuple[int, int]]]:
    """Rounds in which each of n (even) meets one other, until all have met: one stays, the others walk around a table."""
    seats, rounds = list(range(n)), []
    for _ in range(n - 1):
        rounds.append([tuple(sorted((seats[i], seats[n - 1 - i]))) for i in range(n // 2)])
        seats = [seats[0], seats[-1], *seats[1:-1]]
    return rounds


def strata(parts: int) -> list[list[tuple[int, int, int]]]:
    """Tasks (block, block, relation block) of each stratum; every combination is in one."""
    alone = [[(2 * i + k, 2 * i + k) for i in range(parts)] for k in (0, 1)]
    return [[(a, b, (k + shift) % parts) for k, (a, b) in enumerate(pairs)] for pairs in [*pairings(2 * parts), *alone] for shift in range(parts)]


def _in_block(true_id: Column, n: int, blocks: int, *key: Column) -> Column:
    """Another id of the same block; ids are 0 to n - 1, and a block has every ``blocks``-th."""
    block = F.pmod(true_id, F.lit(blocks))
    others = F.floor((F.lit(n - 1) - block) / blocks)
    c = draw_below(others, "strata:id", *key)
    return block + blocks * (c + F.when(c >= F.floor(true_id / blocks), 1).otherwise(0))


def corrupted(triples: DataFrame, n_entities: int, n_relations: int, parts: int, seed: int, epoch: int) -> DataFrame:
    """``triples`` with n_head, n_relation and n_tail, one of which differs, and ``turn``, the order within a task."""
    key = (F.lit(f"{seed}:{epoch}"), F.col("pos"))
    sides = F.when(F.floor((F.lit(n_relations - 1) - F.pmod("relation_id", F.lit(parts))) / parts) > 0, 3).otherwise(2)
    each = triples.withColumn("side", draw_below(sides, "strata:side", *key))
    new = lambda c, n, blocks: _in_block(F.col(c), n, blocks, *key)
    return each.select(
        "*",
        F.when(F.col("side") == 0, new("head_id", n_entities, 2 * parts)).otherwise(F.col("head_id")).alias("n_head"),
        F.when(F.col("side") == 2, new("relation_id", n_relations, parts)).otherwise(F.col("relation_id")).alias("n_relation"),
        F.when(F.col("side") == 1, new("tail_id", n_entities, 2 * parts)).otherwise(F.col("tail_id")).alias("n_tail"),
        draw32("strata:turn", *key).alias("turn"),
    )


def update(x: dict, ids: tuple[int, ...], rate: float, margin: float) -> float:
    """One sample, in place: x holds vectors by (table, id). Its loss, 0 if it violates nothing."""
    h, r, t, nh, nr, nt = [(tbl, i) for tbl, i in zip("ereere", ids, strict=True)]
    good, bad = x[h] + x[r] - x[t], x[nh] + x[nr] - x[nt]
    d_good, d_bad = np.sqrt(good @ good), np.sqrt(bad @ bad)
    loss = margin + d_good - d_bad
    if loss <= 0:
        return 0.0
    up, down = rate * good / max(d_good, 1e-12), rate * bad / max(d_bad, 1e-12)
    for key, move in ((h, -up), (r, -up), (t, up), (nh, down), (nr, down), (nt, -down)):
        x[key] = x[key] + move
    return float(loss)


TRIPLE = ["head_id", "relation_id", "tail_id", "n_head", "n_relation", "n_tail"]


def train_in_strata(triples: DataFrame, entities: DataFrame, relations: DataFrame, parts: int = 2, epochs: int = 1, rate: float = 0.01, margin: float = 1.0, seed: int = 0) -> tuple[DataFrame, DataFrame, list[dict]]:
    """Entity and relation vectors (id, vec), and per epoch the mean loss of violating samples and their number.

    Ids are 0 to n - 1. Entities are normalised at the start and after each epoch, relations never.
    """
    n_e, n_r = entities.count(), relations.count()
    if n_e < 4 * parts or n_r < parts:
        raise ValueError("too many parts: a block needs two entities and a relation")
    plan = strata(parts)
    of = {(min(a, b), max(a, b), q): (s, k) for s, tasks in enumerate(plan) for k, (a, b, q) in enumerate(tasks)}
    ends = [F.pmod(c, F.lit(2 * parts)) for c in ("head_id", "tail_id")]
    code = (F.least(*ends) * (2 * parts) + F.greatest(*ends)) * parts + F.pmod("relation_id", F.lit(parts))
    lookup = triples.sparkSession.createDataFrame([((a * 2 * parts + b) * parts + q, s, k) for (a, b, q), (s, k) in of.items()], "code long, stratum int, task int")
    dealt = materialise(triples.select("pos", "head_id", "relation_id", "tail_id").withColumn("code", code).join(F.broadcast(lookup), "code").drop("code").repartitionByRange("stratum", "task", "pos"))
    start = entities.select(F.lit("e").alias("tbl"), "id", "vec").unionByName(relations.select(F.lit("r").alias("tbl"), "id", "vec"))
    rules = {(0, "e"): Rule(rate, "sgd", len(plan)), (0, "r"): Rule(rate)}
    store = Store(start.select(F.lit(0).alias("trial"), "tbl", "id", F.col("vec").alias("x")), rules, normalise=True)

    def run(step: int):
        def loop(own: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
            if not len(own):
                return pd.DataFrame({c: pd.Series(dtype=object) for c in ("trial", "tbl", "id", "step", "x", "m", "v")})
            x = {(tbl, i): v.astype(np.float64) for tbl, i, v in zip(rows["tbl"], rows["id"], rows["x"], strict=True)}
            before, lost, updates = dict(x), 0.0, 0
            for ids in own.sort_values(["turn", "pos"])[TRIPLE].itertuples(index=False):
                loss = update(x, tuple(ids), rate, margin)
                lost, updates = lost + loss, updates + (loss > 0)
            changed = [(tbl, i, unit(v[None])[0] if tbl == "e" and step % len(plan) == 0 else v) for (tbl, i), v in x.items() if v is not before[tbl, i]]
            changed.append(("loss", 0, np.array([lost, updates])))
            tbl, ids, vectors = zip(*changed, strict=True)
            return pd.DataFrame({"trial": 0, "tbl": tbl, "id": ids, "step": step, "x": vectors, "m": None, "v": None})

        return loop

    history, step = [], 0
    for epoch in range(epochs):
        lost = updates = 0.0
        for s, tasks in enumerate(plan):
            step += 1
            own = materialise(corrupted(dealt.where(F.col("stratum") == s), n_e, n_r, parts, seed, epoch))
            names = [("e", "head_id"), ("e", "n_head"), ("e", "tail_id"), ("e", "n_tail"), ("r", "relation_id"), ("r", "n_relation")]
            touched = own.select("task", F.inline(F.array(*[F.struct(F.lit(tbl).alias("tbl"), F.col(c).alias("id")) for tbl, c in names]))).distinct()
            touched = materialise(touched.withColumn("trial", F.lit(0)))
            rows = store.rows({0: step - 1}, touched.select("trial", "tbl", "id")).join(touched, ["trial", "tbl", "id"])
            moved = materialise(own.groupBy("task").cogroup(rows.groupBy("task")).applyInPandas(run(step), SCHEMA))
            store.put(moved.where("tbl != 'loss'"))
            for row in moved.where("tbl = 'loss'").select("x").collect():  # one row per task
                lost, updates = lost + row["x"][0], updates + row["x"][1]
            for table in (own, touched, moved):
                discard(table)
        history.append({"epoch": epoch, "mean_loss": lost / updates if updates else 0.0, "updates": int(updates)})
    found = materialise(store.rows({0: step}).select("tbl", "id", F.col("x").alias("vec")))
    return found.where("tbl = 'e'").drop("tbl"), found.where("tbl = 'r'").drop("tbl"), history
