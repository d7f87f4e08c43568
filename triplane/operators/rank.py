"""Link prediction: scores, and ranks of true tails, heads or relations among all candidates.

``vectors``: (id, vec). ``relations``: (id, vec). ``tests``: head_id, relation_id, tail_id. Ranks are raw: other true tails
stay in. optimistic = 1 + candidates strictly better; realistic adds half of those equal. The true tail never counts
against itself, as candidate or by rounding: it is left out by id.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from triplane.functions import vectors as V
from triplane.shared import materialise

#: Test rows, and candidates, of a cell are at least and at most so many; within, cells are made to be :data:`CELLS`. Scores are made for so many of both at once.
LEAST, MOST, CELLS, CHUNK = 1000, 20_000, 256, 2000
#: Cells of a trial, whose rows are wide, so that copies weigh more than tasks.
OF_TRIAL = 64
#: Test rows and candidates of a cell of :func:`ball_ranks`.
BLOCK, CANDIDATES = 2000, 20_000
#: Queries and candidates compared at once where a kernel goes dimension by dimension; for rough scores, whose tiles are of small numbers.
TILE, STRIPE = 256, (64, 1024)
#: Bounds of rounding in single precision are in units of this, twice the error of one operation.
SINGLE = 2.0**-23


def gather(triples: DataFrame, vectors: DataFrame, relations: DataFrame) -> DataFrame:
    """``triples`` with the vectors h, r and t."""
    out = triples
    for table, key, name in ((vectors, "head_id", "h"), (relations, "relation_id", "r"), (vectors, "tail_id", "t")):
        out = out.join(table.select(F.col("id").alias(key), F.col("vec").alias(name)), key)
    return out


def transe_scores(triples: DataFrame, vectors: DataFrame, relations: DataFrame, p: int = 2) -> DataFrame:
    """``triples`` with ``distance``, the p-norm of h + r - t."""
    met = gather(triples, vectors, relations)
    return met.withColumn("distance", V.norm(V.translation(F.col("h"), F.col("r"), F.col("t")), p)).drop("h", "r", "t")


@dataclass(frozen=True)
class Scorer:
    """Scores [query, candidate] of one vector for each query, made from the two known ones.

    ``squared``: scores are minus squares of distances. ``translation``: h + r against t; then t - r against h and t - h against r are the same, and the second vector is negated.
    """

    query: Callable[[np.ndarray, np.ndarray], np.ndarray]
    score: Callable[[np.ndarray, np.ndarray], np.ndarray]
    translation: bool = False
    squared: bool = False
    paired: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None
    rough: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray | None]] | None = None

    @property
    def kernel(self) -> Kernel:
        """Of query vectors against candidates."""
        one = lambda f: f and (lambda q, c: f(q[0], c[0]))
        return Kernel(one(self.score), one(self.paired), one(self.rough))

    def __call__(self, a: np.ndarray, b: np.ndarray, candidates: np.ndarray) -> np.ndarray:
        return self.score(self.query(a, b), candidates)


def _minus_squares(q: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    return -((q * q).sum(axis=1)[:, None] + (candidates * candidates).sum(axis=1)[None] - 2 * q @ candidates.T)


def _minus_city_blocks(q: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """No matrix product gives these: dimension by dimension, over tiles that stay in the cache."""
    out = np.zeros((len(q), len(candidates)))
    for i in range(0, len(q), TILE):
        for j in range(0, len(candidates), TILE):
            tile, other, far = q[i : i + TILE], candidates[j : j + TILE], out[i : i + TILE, j : j + TILE]
            for d in range(q.shape[1]):
                far -= np.abs(tile[:, d, None] - other[None, :, d])
    return out


def _minus_city_rows(q: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """The same of row i and row i, added in the same order."""
    out = np.zeros(len(q))
    for d in range(q.shape[1]):
        out -= np.abs(q[:, d] - candidates[:, d])
    return out


def _tiles(n: int, m: int) -> Iterator[tuple[slice, slice]]:
    for i in range(0, n, STRIPE[0]):
        for j in range(0, m, STRIPE[1]):
            yield slice(i, min(n, i + STRIPE[0])), slice(j, min(m, j + STRIPE[1]))


def _rough_city_blocks(q: np.ndarray, candidates: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
    """In single precision, and how far each row's may be off; small whole numbers go by short integers and are exact (None)."""
    most, dims = np.abs(q).max() + np.abs(candidates).max(), q.shape[1]
    short = most <= 32767 and dims < 65536 and all((np.rint(x) == x).all() for x in (q, candidates))
    kind, kept = (np.int16, np.int32) if short else (np.float32, np.float32)
    run = min(dims, int(32767 // max(most, 1))) if short else dims  # so many differences add up in short integers
    out = np.zeros((len(q), len(candidates)), dtype=kept)
    known, offered = q.astype(kind), np.ascontiguousarray(candidates.astype(kind).T)
    for rows, columns in _tiles(*out.shape):
        far = out[rows, columns]
        one, total = np.empty(far.shape, dtype=kind), np.zeros(far.shape, dtype=kind)
        for d in range(dims):
            np.subtract(known[rows, d, None], offered[d, None, columns], out=one)
            np.abs(one, out=one)
            total += one
            if (d + 1) % run == 0 or d + 1 == dims:
                far -= total
                total[...] = 0
    if short:
        return out, None
    reach = np.abs(q).sum(axis=1) + np.abs(candidates).max(axis=0).sum()
    return out, _bounded(SINGLE * (dims + 4) * reach, reach)


def _bounded(off: np.ndarray, reach: np.ndarray) -> np.ndarray:
    """``off``, and no bound where single precision may not reach."""
    return np.where(reach < 1e30, off + 1e-15, np.inf)


#: Minus the squared distance, expanded so that the work is one matrix product.
squared_distance = Scorer(np.add, _minus_squares, translation=True, squared=True)
#: Minus the sum of absolute differences.
city_distance = Scorer(np.add, _minus_city_blocks, translation=True, paired=_minus_city_rows, rough=_rough_city_blocks)
dot_score = Scorer(np.multiply, lambda q, candidates: q @ candidates.T)


def distance_scorer(p: int) -> Scorer:
    """The scorer that ranks by the p-norm of h + r - t."""
    return {1: city_distance, 2: squared_distance}[p]


def _stacked(pdf: pd.DataFrame, names: list[str]) -> list[np.ndarray]:
    return [np.stack(pdf[n]).astype(np.float64) for n in names]


def _questions(tests: DataFrame, vectors: DataFrame, relations: DataFrame, target: str, scorer: Scorer) -> DataFrame:
    """``row, sought`` (the true id), the query vector ``q`` and ``own``, the score of the true one; each distinct test row once."""
    met = gather(tests, vectors, relations).withColumn("row", F.xxhash64("head_id", "relation_id", "tail_id")).dropDuplicates(["row"])
    a, b, t = {"tail": ("h", "r", "t"), "head": ("t", "r", "h"), "relation": ("t", "h", "r")}[target]
    sign = -1 if scorer.translation and target != "tail" else 1

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            if len(pdf):
                x, y, true = _stacked(pdf, [a, b, t])
                q = scorer.query(x, sign * y)
                own = scorer.kernel.rows([q], [true])
                yield pd.DataFrame({"row": pdf["row"], "sought": pdf["sought"], "q": list(q), "own": own})

    return met.select("row", F.col(f"{target}_id").alias("sought"), a, b, t).mapInPandas(run, "row long, sought long, q array<double>, own double")


@dataclass(frozen=True)
class Kernel:
    """``score``: [query, candidate]. ``paired``: of row i and row i. ``rough``: like ``score``, quick, and how far each query's may be off; None: exact.

    With ``rough`` there must be ``paired``, which then decides all pairs that are nearer to the true one's score than that.
    """

    score: Callable[[list[np.ndarray], list[np.ndarray]], np.ndarray]
    paired: Callable[[list[np.ndarray], list[np.ndarray]], np.ndarray] | None = None
    rough: Callable[[list[np.ndarray], list[np.ndarray]], tuple[np.ndarray, np.ndarray | None]] | None = None

    def rows(self, known: list[np.ndarray], offered: list[np.ndarray]) -> np.ndarray:
        """Scores of row i and row i."""
        if self.paired is not None:
            return self.paired(known, offered)
        return np.array([self.score([x[i : i + 1] for x in known], [x[i : i + 1] for x in offered])[0, 0] for i in range(len(known[0]))])

    def compared(self, known: list[np.ndarray], own: np.ndarray, sought: np.ndarray, offered: list[np.ndarray], ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each query, how many candidates but the sought one score better than ``own``, and just like it."""
        better, equal = np.zeros(len(own), dtype=np.int64), np.zeros(len(own), dtype=np.int64)
        for i in range(0, len(own), CHUNK):
            rows = slice(i, i + CHUNK)
            for j in range(0, len(ids), CHUNK):
                more, same = self._chunk([x[rows] for x in known], own[rows], ids[None, j : j + CHUNK] != sought[rows, None], [x[j : j + CHUNK] for x in offered])
                better[rows] += more
                equal[rows] += same
        return better, equal

    def _chunk(self, known: list[np.ndarray], own: np.ndarray, other: np.ndarray, offered: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        s, off = (self.score(known, offered), None) if self.rough is None else self.rough(known, offered)
        if off is None:
            return ((s > own[:, None]) & other).sum(axis=1), ((s == own[:, None]) & other).sum(axis=1)
        high, low = (np.nextafter(x.astype(np.float32), np.float32(to))[:, None] for x, to in ((own + off, np.inf), (own - off, -np.inf)))
        above = (s > high) & other
        at, to = np.nonzero(~(above | (s < low)) & other)  # scores that are no numbers too
        more, same = above.sum(axis=1), np.zeros(len(own), dtype=np.int64)
        for k in range(0, len(at), CHUNK * 100):
            i, j = at[k : k + CHUNK * 100], to[k : k + CHUNK * 100]
            s = self.paired([x[i] for x in known], [x[j] for x in offered])
            more += np.bincount(i[s > own[i]], minlength=len(own))
            same += np.bincount(i[s == own[i]], minlength=len(own))
        return more, same


def _sides(tests: int, pool: int, block: int | None, candidates: int | None, cells: int = CELLS) -> tuple[int, int]:
    """Blocks of tests and of candidates: enough cells for many tasks, but as few copies of both sides as cells of bounded size allow."""
    side = int(min(MOST, max(LEAST, (tests * pool / cells) ** 0.5)))
    return max(1, -(-tests // (block or side))), max(1, -(-pool // (candidates or side)))


def of_trial(tests: int, pool: int) -> tuple[int, int]:
    """How often :func:`counted_by_trial` copies the candidates of a trial, and its tests."""
    return _sides(tests, pool, None, None, OF_TRIAL)


def counted(asked: DataFrame, known: list[str], pool: DataFrame, offered: list[str], kernel: Kernel, block: int | None = None, candidates: int | None = None) -> DataFrame:
    """``(row, better, equal)``: candidates of ``pool`` that score better than, or just like, the true one.

    ``asked``: row, sought, own and the columns ``known``; ``pool``: id and the columns ``offered``; ``kernel`` scores queries
    against candidates. Both sides are dealt into blocks, and each pair of blocks is a task (a cell), which returns
    counts per row only. Pairs are never rows, and nothing passes through the driver.
    """
    asked = materialise(asked)
    blocks, parts = _sides(asked.count(), pool.count(), block, candidates)

    def cell(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({c: np.zeros(0, dtype=np.int64) for c in ("row", "better", "equal")})
        better, equal = kernel.compared(_stacked(left, known), left["own"].to_numpy(), left["sought"].to_numpy(), _stacked(right, offered), right["id"].to_numpy())
        return pd.DataFrame({"row": left["row"].to_numpy(), "better": better, "equal": equal})

    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asked.select("row", "sought", "own", *known, F.pmod(F.xxhash64(F.lit(1), "row"), F.lit(blocks)).cast("int").alias("i"), every(parts).alias("j"))
    right = pool.select("id", *offered, every(blocks).alias("i"), F.pmod(F.xxhash64(F.lit(2), "id"), F.lit(parts)).cast("int").alias("j"))
    cells = left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInPandas(cell, "row long, better long, equal long")
    return cells.groupBy("row").agg(F.sum("better").alias("better"), F.sum("equal").alias("equal"))


def counted_by_trial(asked: DataFrame, pool: DataFrame, of: Callable[[int, np.ndarray, np.ndarray, np.ndarray], tuple[Kernel, list[np.ndarray], list[np.ndarray]]], block: int | None = None, candidates: int | None = None) -> DataFrame:
    """``(trial, row, better, equal)``: like :func:`counted`, for many models at once.

    ``asked``: trial, row, sought, h, r, t; ``pool``: trial, id, x; ``of``: a trial's kernel, and what it takes of queries (h, r) and of candidates.
    """
    sizes = pool.groupBy("trial").count().agg(F.max("count")).first()[0] or 0, asked.groupBy("trial").count().agg(F.max("count")).first()[0] or 0
    blocks, parts = _sides(sizes[1], sizes[0], block, candidates, OF_TRIAL)

    def cell(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({c: np.zeros(0, dtype=np.int64) for c in ("trial", "row", "better", "equal")})
        trial, (h, r, t) = int(left["trial"].iloc[0]), _stacked(left, ["h", "r", "t"])
        kernel, known, true = of(trial, h, r, t)
        _, _, offered = of(trial, h, r, np.stack(right["x"]))
        better, equal = kernel.compared(known, kernel.rows(known, true), left["sought"].to_numpy(), offered, right["id"].to_numpy())
        return pd.DataFrame({"trial": trial, "row": left["row"].to_numpy(), "better": better, "equal": equal})

    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asked.select(F.col("trial").alias("trial"), "row", "sought", "h", "r", "t", F.pmod(F.xxhash64(F.lit(1), "row"), F.lit(blocks)).cast("int").alias("i"), every(parts).alias("j"))
    right = pool.select(F.col("trial").alias("trial"), "id", "x", every(blocks).alias("i"), F.pmod(F.xxhash64(F.lit(2), "id"), F.lit(parts)).cast("int").alias("j"))
    keys = ["trial", "i", "j"]
    dealt = min(MOST, 20 * blocks * parts)  # a cell, of some 20 trials, is much work for its bytes
    left, right = (side.repartition(dealt, *keys) for side in (left, right))
    cells = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(cell, "trial int, row long, better long, equal long")
    return cells.groupBy("trial", "row").agg(F.sum("better").alias("better"), F.sum("equal").alias("equal"))


def _of_tests(tests: DataFrame, counts: DataFrame) -> DataFrame:
    return with_ranks(tests.withColumn("row", F.xxhash64("head_id", "relation_id", "tail_id")).join(counts, "row").drop("row"))


def ranks(tests: DataFrame, vectors: DataFrame, relations: DataFrame, scorer: Scorer = squared_distance, target: str = "tail", block: int | None = None, candidates: int | None = None) -> DataFrame:
    """``tests`` with ``better`` and ``equal`` counts, and both ranks, of the true tail, head or relation.

    Heads and tails are sought among all entities, relations among all relations. A query travels as one vector and the score
    of its true answer. See :func:`counted`.
    """
    pool = relations if target == "relation" else vectors
    asked = _questions(tests, vectors, relations, target, scorer)
    return _of_tests(tests, counted(asked, ["q"], pool, ["vec"], scorer.kernel, block, candidates))


#: Candidates that centres of balls are drawn from.
DRAWN = 10_000


def balls(pool: DataFrame, scorer: Scorer, n: int) -> tuple[np.ndarray, DataFrame]:
    """Centres (drawn from the candidates, the least by hash), and ``pool`` with its nearest centre, ``ball``, and the distance, ``far``."""
    rows = pool.select("vec", F.xxhash64(F.lit(17), "id").alias("draw")).orderBy("draw").limit(min(n, DRAWN)).select("vec").collect()
    centres = np.array([r["vec"] for r in rows], dtype=np.float64)

    def nearest(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            if len(pdf):
                d = _distances(scorer, _stacked(pdf, ["vec"])[0], centres)
                yield pdf.assign(ball=d.argmin(axis=1), far=d.min(axis=1))

    return centres, pool.select("id", F.col("vec").cast("array<double>").alias("vec")).mapInPandas(nearest, "id long, vec array<double>, ball int, far double")


def _distances(scorer: Scorer, q: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    d = np.maximum(-scorer.score(q, candidates), 0.0)
    return np.sqrt(d) if scorer.squared else d


def ball_ranks(tests: DataFrame, vectors: DataFrame, relations: DataFrame, scorer: Scorer = squared_distance, n_balls: int = 256, block: int = BLOCK, candidates: int = CANDIDATES) -> DataFrame:
    """Tail ranks like :func:`ranks`, and ``scored``: how many candidates had to be scored for the row.

    Candidates lie in balls around their nearest centre. By the triangle inequality a ball may be wholly nearer than the true
    tail, and then counts unscored, or wholly farther, and then doesn't; only balls that the true tail's distance cuts are
    scored, one by one. Balls are a bounded table. For distances only (``scorer.translation``).
    """
    if not scorer.translation:
        raise ValueError("balls need a distance")
    asked = materialise(_questions(tests, vectors, relations, "tail", scorer))
    centres, placed = balls(vectors, scorer, n_balls)
    placed = materialise(placed)
    known = placed.groupBy("ball").agg(F.max("far").alias("radius"), F.count("*").alias("n")).toPandas()
    ball, radius, size = (known[c].to_numpy() for c in ("ball", "radius", "n"))

    def split(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            if not len(pdf):
                continue
            d = _distances(scorer, _stacked(pdf, ["q"])[0], centres[ball])
            own = np.maximum(-pdf["own"].to_numpy(), 0.0)
            own = (np.sqrt(own) if scorer.squared else own)[:, None]
            slack = 1e-6 * (1 + own + d + radius)  # distances are rounded
            nearer, farther = d + radius < own - slack, d - radius > own + slack
            cut = ~nearer & ~farther
            yield pdf.assign(sure=(nearer * size).sum(axis=1), scored=(cut * size).sum(axis=1), balls=[ball[row] for row in cut])

    asked = materialise(asked.mapInPandas(split, "row long, sought long, q array<double>, own double, sure long, scored long, balls array<int>"))
    visits = asked.select("row", "sought", "q", "own", F.explode("balls").alias("ball"))
    dealt = placed.groupBy("ball").agg(F.ceil(F.count("*") / candidates).cast("int").alias("parts")).join(visits.groupBy("ball").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks")), "ball")
    dealt = F.broadcast(materialise(dealt))  # one row per ball
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    left = visits.join(dealt, "ball").select("ball", F.pmod(F.xxhash64(F.lit(1), "row"), F.col("blocks")).cast("int").alias("i"), every("parts").alias("j"), "row", "sought", "q", "own")
    right = placed.join(dealt, "ball").select("ball", every("blocks").alias("i"), F.pmod(F.xxhash64(F.lit(2), "id"), F.col("parts")).cast("int").alias("j"), "id", "vec")

    def cell(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({c: np.zeros(0, dtype=np.int64) for c in ("row", "better", "equal")})
        s = scorer.score(_stacked(left, ["q"])[0], _stacked(right, ["vec"])[0])
        own, other = left["own"].to_numpy()[:, None], right["id"].to_numpy()[None] != left["sought"].to_numpy()[:, None]
        return pd.DataFrame({"row": left["row"].to_numpy(), "better": ((s > own) & other).sum(axis=1), "equal": ((s == own) & other).sum(axis=1)})

    cells = left.groupBy("ball", "i", "j").cogroup(right.groupBy("ball", "i", "j")).applyInPandas(cell, "row long, better long, equal long")
    counts = cells.groupBy("row").agg(F.sum("better").alias("more"), F.sum("equal").alias("equal"))
    total = asked.select("row", "sure", "scored").join(counts, "row", "left")
    return _of_tests(tests, total.select("row", (F.col("sure") + F.coalesce("more", F.lit(0))).alias("better"), F.coalesce("equal", F.lit(0)).alias("equal"), "scored"))


def with_ranks(counts: DataFrame) -> DataFrame:
    return counts.withColumns({"optimistic": F.col("better") + 1, "realistic": F.col("better") + 1 + F.col("equal") / 2})


def ranks_by_join(tests: DataFrame, vectors: DataFrame, relations: DataFrame) -> DataFrame:
    """The same by a join of all test rows with all entities, for small tables: distances as sums of squares."""
    met = gather(tests, vectors, relations)
    far = lambda v: F.aggregate(V.translation(F.col("h"), F.col("r"), v), F.lit(0).cast("long"), lambda s, x: s + (x * x).cast("long"))
    pairs = met.withColumn("own", far(F.col("t"))).join(vectors.select(F.col("id").alias("candidate"), F.col("vec").alias("v")), F.col("candidate") != F.col("tail_id"))
    pairs = pairs.withColumn("distance", far(F.col("v")))
    counts = pairs.groupBy("head_id", "relation_id", "tail_id").agg(F.count_if(F.col("distance") < F.col("own")).alias("better"), F.count_if(F.col("distance") == F.col("own")).alias("equal"))
    return with_ranks(counts)


def mean_rank(ranked: DataFrame, column: str = "optimistic") -> DataFrame:
    """One row: rows and mean rank; null of no rows."""
    return ranked.agg(F.count("*").alias("n"), F.avg(column).alias("mean_rank"))


BOXES = ("head_base", "head_delta", "head_size", "tail_base", "tail_delta", "tail_size")


def box_distance(point: np.ndarray, base: np.ndarray, delta: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Of each coordinate to its interval: centre = base, half-width = |delta| * softplus(size) / 2.

    Inside, the distance shrinks with the width, outside it grows (Abboud et al. 2020).
    """
    width = np.abs(delta) * np.log1p(np.exp(size))
    half, w1 = width / 2, width + 1
    off = np.abs(point - base)
    return np.where(off <= half, off / w1, off * w1 - half * (w1 - 1 / w1))


def boxe_block(p: int = 2, tanh: bool = True) -> Callable:
    """BoxE scores [row]: minus the p-norms of the distances of both bumped points to the relation's boxes."""
    squash = np.tanh if tanh else (lambda x: x)

    def score(h, h_bump, t, t_bump, r_head, r_tail):
        a = box_distance(squash(h + t_bump), *r_head)
        b = box_distance(squash(t + h_bump), *r_tail)
        return -(np.linalg.norm(a, ord=p, axis=1) + np.linalg.norm(b, ord=p, axis=1))

    return score


def boxe_kernel(p: int = 2, tanh: bool = True) -> Kernel:
    """Known: an entity, its bump, the box of its side and the box of the other; offered: an entity and its bump.

    The known entity is moved by the candidate's bump and held against its own box, the candidate by the known one's bump and
    held against the other. Both go dimension by dimension, in tiles, so that memory follows the tile and not the dimension.
    """
    squash = np.tanh if tanh else (lambda x: x)

    def far(known: np.ndarray, moved: np.ndarray, box: list[np.ndarray]) -> np.ndarray:
        """Of arrays whose last axis is the dimension, and whose others meet."""
        total, (base, delta, size) = 0.0, box
        for d in range(known.shape[-1]):
            one = box_distance(squash(known[..., d] + moved[..., d]), base[..., d], delta[..., d], size[..., 0])
            total = total + (one if p == 1 else one * one)
        return total if p == 1 else np.sqrt(total)

    def paired(known: list[np.ndarray], offered: list[np.ndarray]) -> np.ndarray:
        (entity, bump, *boxes), (candidate, candidate_bump) = known, offered
        return -far(entity, candidate_bump, boxes[:3]) - far(bump, candidate, boxes[3:])

    def score(known: list[np.ndarray], offered: list[np.ndarray]) -> np.ndarray:
        out = np.zeros((len(known[0]), len(offered[0])))
        for i in range(0, out.shape[0], TILE):
            for j in range(0, out.shape[1], TILE):
                out[i : i + TILE, j : j + TILE] = paired([x[i : i + TILE, None] for x in known], [x[None, j : j + TILE] for x in offered])
        return out

    def rough(known: list[np.ndarray], offered: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        (entity, bump, *boxes), (candidate, candidate_bump) = known, offered
        out, off, reach = np.zeros((len(entity), len(candidate)), dtype=np.float32), 0.0, 0.0
        for own, moved, (base, delta, size) in ((entity, candidate_bump, boxes[:3]), (bump, candidate, boxes[3:])):
            dims, widest = own.shape[1], np.abs(moved).max(axis=0)
            w1 = np.abs(delta) * np.log1p(np.exp(size)) + 1
            less = (w1 - 1) / 2 * (w1 - 1 / w1)
            # tanh(a + b) = (tanh a + tanh b) / (1 + tanh a * tanh b), which is quick and loses digits where this nears 0
            least = 1 - np.tanh(np.abs(own)) * np.tanh(widest)
            sums = tanh and least.min() > 0.05
            most = (1.0 if tanh else np.abs(own) + widest) + np.abs(base)
            # a norm is off by no more than the norm of what its terms are off by
            off = off + np.linalg.norm(w1 * (32 / least if sums else 2 * (np.abs(own) + widest)), p, axis=1) + (dims + 16) * np.linalg.norm(w1 * most + less, p, axis=1)
            reach = reach + (w1 * (most + np.abs(own) + widest) + less).sum(axis=1) ** 2  # squares are added
            single = lambda x: x.astype(np.float32)
            point, shift = (np.tanh(own), np.tanh(moved)) if sums else (own, moved)
            point, shift, base, w1, w0, less = single(point), np.ascontiguousarray(single(shift).T), *map(single, (base, w1, 1 / w1, less))
            for rows, columns in _tiles(*out.shape):
                tile = out[rows, columns]
                x, y, total = np.empty_like(tile), np.empty_like(tile), np.zeros_like(tile)
                for d in range(dims):
                    a, b = point[rows, d, None], shift[d, None, columns]
                    np.add(a, b, out=x)
                    if sums:
                        np.multiply(a, b, out=y)
                        y += 1
                        x /= y
                    elif tanh:
                        np.tanh(x, out=x)
                    x -= base[rows, d, None]
                    np.abs(x, out=x)
                    # the distance is convex: the larger one of its two slopes
                    np.multiply(x, w1[rows, d, None], out=y)
                    y -= less[rows, d, None]
                    x *= w0[rows, d, None]
                    np.maximum(x, y, out=x)
                    if p == 2:
                        x *= x
                    total += x
                tile -= np.sqrt(total) if p == 2 else total
        return out, _bounded(SINGLE * off, reach)

    return Kernel(score, paired, rough if p in (1, 2) else None)


def boxe_ranks(tests: DataFrame, entities: DataFrame, relations: DataFrame, p: int = 2, tanh: bool = True, target: str = "tail", block: int | None = None, candidates: int | None = None) -> DataFrame:
    """Like :func:`ranks`, of tails or heads by BoxE. ``entities``: id, vec, bump; ``relations``: id and :data:`BOXES`."""
    known, sought = ("head", "tail") if target == "tail" else ("tail", "head")
    side = lambda key, *names: entities.select(F.col("id").alias(key), *[F.col(c).alias(n) for c, n in zip(("vec", "bump"), names, strict=True)])
    boxes = [c for end in (known, sought) for c in BOXES if c.startswith(end)]
    met = tests.select("head_id", "relation_id", "tail_id").distinct().join(side(f"{known}_id", "a", "a_bump"), f"{known}_id").join(side(f"{sought}_id", "t", "t_bump"), f"{sought}_id")
    met = met.join(relations.select(F.col("id").alias("relation_id"), *boxes), "relation_id")
    met = met.select(F.xxhash64("head_id", "relation_id", "tail_id").alias("row"), F.col(f"{sought}_id").alias("sought"), "a", "a_bump", *boxes, "t", "t_bump")
    kernel, names = boxe_kernel(p, tanh), ["a", "a_bump", *boxes]

    def own(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            if len(pdf):
                q, true = _stacked(pdf, names), _stacked(pdf, ["t", "t_bump"])
                yield pdf.drop(columns=["t", "t_bump"]).assign(own=kernel.rows(q, true))

    kind = ", ".join(["row long, sought long", *[f"{n} array<double>" for n in names], "own double"])
    return _of_tests(tests, counted(met.mapInPandas(own, kind), names, entities, ["vec", "bump"], kernel, block, candidates))


def boxe_scores(triples: DataFrame, entities: DataFrame, relations: DataFrame, p: int = 2, tanh: bool = True) -> DataFrame:
    """``entities``: id, vec, bump. ``relations``: id and base, delta, size for head and tail. Adds ``score``."""
    ends = {"head_id": ("h", "h_bump"), "tail_id": ("t", "t_bump")}
    met = triples
    for key, (v, b) in ends.items():
        met = met.join(entities.select(F.col("id").alias(key), F.col("vec").alias(v), F.col("bump").alias(b)), key)
    tensors = list(BOXES)
    met = met.join(relations.select(F.col("id").alias("relation_id"), *tensors), "relation_id")
    names = ["head_id", "relation_id", "tail_id"]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        score = boxe_block(p, tanh)
        for pdf in parts:
            if len(pdf):
                m = {c: np.stack(pdf[c]).astype(np.float64) for c in ("h", "h_bump", "t", "t_bump", *tensors)}
                out = score(m["h"], m["h_bump"], m["t"], m["t_bump"], [m[c] for c in tensors[:3]], [m[c] for c in tensors[3:]])
                yield pdf[names].assign(score=out)

    return met.mapInPandas(run, "head_id long, relation_id long, tail_id long, score double")


def losses(scores: DataFrame, margin: float = 3.0, temperature: float = 2.0) -> DataFrame:
    """Per positive row ``pos``: softplus, margin and self-adversarial losses over its negatives.

    ``scores``: pos, positive (its score) and negative (one row per negative).
    """
    softplus = lambda x: F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))
    weight = F.exp(F.col("negative") * temperature - F.max(F.col("negative") * temperature).over(Window.partitionBy("pos")))
    rows = scores.withColumn("weight", weight)
    return rows.groupBy("pos").agg(
        (F.avg(softplus(F.col("negative"))) + softplus(-F.first("positive"))).alias("softplus"),
        F.avg(F.greatest(F.lit(0.0), margin - F.col("positive") + F.col("negative"))).alias("margin"),
        ((softplus(-(F.first("positive") + margin)) + F.sum(F.col("weight") * softplus(F.col("negative") + margin)) / F.sum("weight")) / 2).alias("nssa"),
    )
