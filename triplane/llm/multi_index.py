"""Approximate nearest neighbours by an inverted multi-index.

Vectors are cut in halves, and each half is quantised by centroids of its own, so that k + k centroids name k * k cells. A
query sorts the centroids of either half by distance and walks over their pairs with a heap, by the sum of both distances,
until the cells it has met hold enough entries (Babenko and Lempitsky 2012). These are compared with it exactly.

How many are enough is measured, not assumed: queries of a bounded sample are compared with all vectors, and so many
entries are met as hold :data:`RECALL` of their true neighbours (:func:`entries_needed`). Centroids are learnt from a bounded
sample (:data:`SAMPLE`, :data:`NUMBERS`), the least by hash; every vector is indexed.

Spark groups entries and queries by the first centroid; a query comes to a group once, with the second centroids it
wants there. Crowded groups are cut into parts, of entries and of queries, and each pair of parts is a task that returns the
nearest of each query. Copies of a vector are one entry, so that they fill neither cells nor lists; their ids, as many of
the smallest as can be asked for, come back in at the end.

Vectors that are null, zero or hold a null or non-finite component take no part. Vectors of different lengths don't meet:
each length is an index of its own (lengths are few; a length without a query is not indexed). Rows that repeat id and
vector are one; rows of one id with unlike vectors are different entries, and as queries each gets its list. A row
that shares a query's id is its own. A row without an id is no query; as a neighbour it comes last among ties. An empty
table gives no rows; with fewer than k candidates all are returned.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from triplane.llm.embed_passes import comparable
from triplane.shared import materialise

EVERY, NEIGHBOURS = 100, 10
#: Share of the true neighbours of sampled queries that the entries met must hold.
RECALL = 0.97
#: Queries compared with all vectors to measure it, and vectors to learn centroids from; neither has more numbers than NUMBERS.
MEASURED, SAMPLE, NUMBERS = 256, 16_384, 1 << 22
#: Entries of a cell on average, and the most centroids of a half.
CELL, MOST_CENTROIDS = 16, 512
#: Entries and queries of a task at most.
PART, QUERIES = 20_000, 2000
NO_ID = (1 << 63) - 1


@dataclass
class Quantiser:
    """Centroids of both halves of vectors of one length."""

    first: np.ndarray
    second: np.ndarray

    def distances(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cut = self.first.shape[1]
        return _squares(x[:, :cut], self.first), _squares(x[:, cut:], self.second)

    def cells(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.distances(x)
        return a.argmin(axis=1), b.argmin(axis=1)


def _squares(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    far = (x * x).sum(axis=1)[:, None] + (centres * centres).sum(axis=1)[None] - 2 * x @ centres.T
    return np.maximum(far, 0.0)


def _means(x: np.ndarray, k: int, rounds: int = 20, seed: int = 0) -> np.ndarray:
    """Centroids by Lloyd's iterations; one that loses all its vectors moves to the one farthest from its own."""
    centres = x[np.random.default_rng(seed).permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        far = _squares(x, centres)
        own = far.argmin(axis=1)
        count = np.bincount(own, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, own, x)
        empty = np.flatnonzero(count == 0)
        centres = total / np.maximum(count, 1)[:, None]
        if len(empty):
            centres[empty] = x[np.argsort(far[np.arange(len(x)), own])[::-1][: len(empty)]]
    return centres


def entries_of(vectors: DataFrame) -> DataFrame:
    """``(entry, dim, embedding, least)``: each distinct comparable vector once; least: its smallest id, if it has any."""
    fit = vectors.where(comparable(F.col("embedding"))).select("vec_id", F.xxhash64("embedding").alias("entry"), F.col("embedding").cast("array<double>").alias("embedding"))
    return fit.groupBy("entry").agg(F.first("embedding").alias("embedding"), F.min("vec_id").alias("least")).withColumn("dim", F.size("embedding"))


def names_of(vectors: DataFrame, k: int) -> DataFrame:
    """``(entry, vec_id)``: the k + 1 smallest ids of each entry; the limit holds before the shuffle too."""
    ids = vectors.where(comparable(F.col("embedding"))).select(F.xxhash64("embedding").alias("entry"), "vec_id").distinct()
    order = Window.partitionBy("entry").orderBy(F.col("vec_id").asc_nulls_last())
    return ids.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k + 1).drop("place")


def learnt(entries: DataFrame, n: int, dim: int) -> Quantiser:
    """From the least :data:`SAMPLE` entries by hash, fewer where they are long."""
    most = max(64, min(SAMPLE, NUMBERS // max(1, dim)))
    rows = entries.select("embedding", F.xxhash64(F.lit(11), "entry").alias("draw")).orderBy("draw").limit(most).select("embedding").toArrow()["embedding"]
    x = rows.combine_chunks().values.to_numpy().reshape(-1, dim)
    k = int(min(MOST_CENTROIDS, len(x), max(1, round((n / CELL) ** 0.5))))
    return Quantiser(_means(x[:, : dim // 2], k), _means(x[:, dim // 2 :], k))


def celled(embedding: Column, known: Quantiser) -> Column:
    """``struct<first, second>``: the cell of a vector."""

    @F.pandas_udf("first int, second int")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for own in batches:
            a, b = known.cells(np.stack(own)) if len(own) else (np.zeros(0), np.zeros(0))
            yield pd.DataFrame({"first": a.astype(np.int32), "second": b.astype(np.int32)})

    return run(embedding)


def walk(a: np.ndarray, b: np.ndarray, counts: np.ndarray, enough: int) -> list[tuple[int, int]]:
    """Cells that hold entries, by the sum of both distances, until they hold ``enough``."""
    first, second = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
    a, b = a[first], b[second]
    heap, met, held = [(float(a[0] + b[0]), 0, 0)], [], 0
    while heap and held < enough:
        _, i, j = heapq.heappop(heap)
        here = int(counts[first[i], second[j]])
        if here:
            met.append((int(first[i]), int(second[j])))
            held += here
        # each pair is reached from its left neighbour, those of the first column from the row above
        if j + 1 < len(b):
            heapq.heappush(heap, (float(a[i] + b[j + 1]), i, j + 1))
        if j == 0 and i + 1 < len(a):
            heapq.heappush(heap, (float(a[i + 1] + b[0]), i + 1, 0))
    return met


def distance(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Euclidean, of rows from one vector, in double precision."""
    return np.sqrt(((x - q) ** 2).sum(axis=1))


def _nearest(far: np.ndarray, least: np.ndarray, k: int) -> np.ndarray:
    """Places of the k smallest by distance and id."""
    if len(far) > k:
        bound = np.partition(far, k - 1)[k - 1]
        kept = np.flatnonzero(far <= bound)
        return kept[np.lexsort((least[kept], far[kept]))[:k]]
    return np.lexsort((least, far))


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy("score", "least", "entry")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).drop("place")


FOUND = "query long, entry long, score double, least long"


def true_neighbours(asked: list[tuple[int, np.ndarray]], entries: DataFrame, k: int) -> DataFrame:
    """``(query, entry, score, least)``: the k nearest entries of a bounded list of queries, among all."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: dict[int, list] = {}
        for pdf in batches:
            if not len(pdf):
                continue
            x, ids, least = np.stack(pdf["embedding"]), pdf["entry"].to_numpy(), pdf["least"].to_numpy()
            for query, q in asked:
                far = distance(x, q)
                at = _nearest(far, least, k)
                old = kept.get(query, (np.zeros(0), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)))
                new = [np.concatenate(pair) for pair in zip(old, (far[at], ids[at], least[at]), strict=True)]
                at = _nearest(new[0], new[2], k)
                kept[query] = [v[at] for v in new]
        for query, (far, ids, least) in kept.items():
            yield pd.DataFrame({"query": query, "entry": ids, "score": far, "least": least})

    return _best(entries.select("entry", "embedding", "least").mapInPandas(run, FOUND), k)


def entries_needed(true: DataFrame, cells: DataFrame, known: Quantiser, asked: list[tuple[int, np.ndarray]], counts: np.ndarray, recall: float, k: int) -> int:
    """So many entries that the cells met first hold ``recall`` of the true neighbours of the queries asked."""
    near = true.join(cells.select("entry", "first", "second"), "entry").select("query", "first", "second").toPandas()
    needed = []
    for query, q in asked:
        own = near[near["query"] == query]
        a, b = known.distances(q[None])
        total = a[0][:, None] + b[0][None]
        order = np.argsort(total, axis=None, kind="stable")
        before = np.empty(total.size, dtype=np.int64)
        before[order] = np.concatenate([[0], np.cumsum(counts.ravel()[order])[:-1]])
        needed += (before.reshape(total.shape)[own["first"], own["second"]] + 1).tolist()
    if not needed:
        return k
    return int(np.quantile(needed, recall, method="higher"))


def search(entries: DataFrame, queries: DataFrame, k: int, recall: float = RECALL, enough: int | None = None) -> DataFrame:
    """``(query, entry, score, least)``: nearest entries of each query, all of one length.

    ``entries``: entry, embedding, least (no nulls), dim. ``queries``: query (a number), embedding. ``enough`` fixes the entries
    met per query instead of measuring them.
    """
    n, dim = entries.count(), entries.first()["dim"]
    known = learnt(entries, n, dim)
    cells = materialise(entries.withColumn("cell", celled(F.col("embedding"), known)).select("entry", "embedding", "least", "cell.first", "cell.second"))
    # k * k counts, MOST_CENTROIDS squared at most
    counts = np.zeros((len(known.first), len(known.second)), dtype=np.int64)
    held = cells.groupBy("first", "second").count().toPandas()
    counts[held["first"], held["second"]] = held["count"]
    if enough is None:
        most = max(1, min(MEASURED, NUMBERS // max(1, dim)))
        sample = queries.orderBy(F.xxhash64(F.lit(13), "query")).limit(most).collect()
        asked = [(row["query"], np.array(row["embedding"])) for row in sample]
        true = true_neighbours(asked, cells, k)
        enough = entries_needed(true, cells, known, asked, counts, recall, k)

    def wanted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            if len(pdf):
                a, b = known.distances(np.stack(pdf["embedding"]))
                for i, (query, own) in enumerate(zip(pdf["query"], pdf["embedding"], strict=True)):
                    groups: dict[int, list[int]] = {}
                    for first, second in walk(a[i], b[i], counts, enough):
                        groups.setdefault(first, []).append(second)
                    out += [(query, own, first, seconds) for first, seconds in groups.items()]
            yield pd.DataFrame(out, columns=["query", "embedding", "first", "seconds"])

    def compare(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = {"query": [], "entry": [], "score": [], "least": []}
        if len(left) and len(right):
            right = right.sort_values("second")
            second, x = right["second"].to_numpy(), np.stack(right["embedding"])
            ids, least = right["entry"].to_numpy(), right["least"].to_numpy()
            for query, own, seconds in zip(left["query"], left["embedding"], left["seconds"], strict=True):
                starts, ends = np.searchsorted(second, seconds), np.searchsorted(second, seconds, side="right")
                at = np.concatenate([np.arange(s, e) for s, e in zip(starts, ends, strict=True)])
                if len(at):
                    far = distance(x[at], own)
                    best = _nearest(far, least[at], k)
                    out["query"].append(np.full(len(best), query))
                    out["entry"].append(ids[at[best]])
                    out["score"].append(far[best])
                    out["least"].append(least[at[best]])
        return pd.DataFrame({c: np.concatenate(v) if v else np.zeros(0, dtype=float if c == "score" else np.int64) for c, v in out.items()})

    walks = materialise(queries.mapInPandas(wanted, "query long, embedding array<double>, first int, seconds array<int>"))
    of = walks.groupBy("first").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("blocks"))
    cut = cells.groupBy("first").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts")).join(of, "first")
    cut = materialise(cut)  # one row per centroid
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    left = walks.join(F.broadcast(cut), "first").withColumn("j", F.pmod(F.xxhash64(F.lit(3), "query"), F.col("blocks")).cast("int"))
    left = left.select("first", every("parts").alias("i"), "j", "query", "embedding", "seconds")
    right = cells.join(F.broadcast(cut), "first").withColumn("i", F.pmod(F.xxhash64(F.lit(5), "entry"), F.col("parts")).cast("int"))
    right = right.select("first", "i", every("blocks").alias("j"), "second", "entry", "embedding", "least")
    keys = ["first", "i", "j"]
    return _best(left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(compare, FOUND), k)


def digest(vectors: DataFrame, every: int = EVERY, k: int = NEIGHBOURS, recall: float = RECALL) -> DataFrame:
    """Per query (ids divisible by ``every``) and rank: query_id, rank, vec_id, score."""
    vectors = vectors.select("vec_id", "embedding")
    spark = vectors.sparkSession
    entries = materialise(entries_of(vectors).withColumn("least", F.coalesce("least", F.lit(NO_ID))))
    chosen = vectors.where((F.col("vec_id") % every == 0) & comparable(F.col("embedding")))
    chosen = chosen.select(F.col("vec_id").alias("query_id"), F.xxhash64("embedding").alias("own")).distinct().withColumn("query", F.xxhash64("query_id", "own"))
    chosen = materialise(chosen)
    asked = materialise(chosen.join(entries, F.col("own") == F.col("entry")).select("query", "embedding", "dim"))
    found = spark.createDataFrame([], FOUND)
    for (dim,) in sorted(asked.select("dim").distinct().collect()):
        # one more than asked for: the query's own vector is among them
        own = search(entries.where(F.col("dim") == dim), asked.where(F.col("dim") == dim).drop("dim"), k + 1, recall)
        found = found.unionByName(own)
    named = found.join(names_of(vectors, k), "entry").join(chosen.select("query", "query_id"), "query").where(~F.col("vec_id").eqNullSafe(F.col("query_id")))
    order = Window.partitionBy("query").orderBy("score", F.col("vec_id").asc_nulls_last())
    return named.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
