"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triplane.shared import discard, materialise

MOST_ROUNDS = 100


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum((F.xxhash64("b", "a") % 1_000_003))).first())


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``(node, root)`` for each node of an edge: root is the smallest node it is connected with.

    Each round hangs every neighbour on the smallest of its neighbours, so that paths shorten as powers of two; the
    rounds end when nothing changes. All steps are joins with one row per node or sums that combine before the shuffle,
    so a hub costs no single task its whole neighbourhood. Loops and null ends are dropped; an empty table has no rows.
    """
    x, y = F.col(a), F.col(b)
    now = edges.where(x != y).select(F.greatest(x, y).alias("a"), F.least(x, y).alias("b")).distinct()
    now = materialise(now)
    state = _state(now)
    if not state[0]:
        return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    for _ in range(MOST_ROUNDS):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = materialise(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct())
        reached = _state(after)
        discard(now)
        now = after
        if reached == state:
            break
        state = reached
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
