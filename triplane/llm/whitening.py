"""Whitening of embeddings by refined eigenvectors of their covariance.

Entries become whole numbers, ``floor(256 * c)``, so equal vectors are equal exactly; each distinct one counts once. Spark
sums them, then sums the products of what is left of them less their mean: tasks add up a matrix each and return it by
rows, and rows are added by number, so that no place receives a matrix of every task.

The driver holds one matrix of dimension squared. Its eigenvectors are found in 32-bit floats first. Iterations of
Ogita and Aishima (2018) then correct them by matrix products in extended precision, which double the right digits each
time: the residual of orthogonality and the off-diagonal of the transformed matrix give the correction of every vector by
every other one. For eigenvalues closer than the error that is left, the quotient of that correction means nothing;
such clusters get a small eigenproblem of their own, of the matrix less the cluster's mean within the cluster's space
(Ogita and Aishima 2019), and the iterations go on.

A vector that is null or has a null or non-finite entry is dropped; one without entries has no component and gives no
row. Vectors of different lengths are populations of their own; lengths are few. A length with fewer than four entries has
fewer components. A component without variance has an eigenvalue of zero: its ``whitened`` is null, its share 0 (null if
nothing varies), and it doesn't count in ``identity_error``. Repeated rows stay and are transformed alike; a null vec_id
stays null. Entries past 2**63 stop there; ``deviation`` is null where it passes 2**63.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triplane.shared import materialise

SCALE, COMPONENTS = 256, 4
#: Rows of a batch whose products are added before the next.
BATCH = 4096
#: Share of the trace below which an eigenvalue is rounding of zero.
NOTHING = 1e-13


def fit(embedding: Column) -> Column:
    """False for null vectors and those with null or non-finite entries."""
    odd = F.exists(embedding, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return F.coalesce(~odd, F.lit(False))


def whole(embedding: Column) -> Column:
    return F.transform(embedding, lambda c: F.floor(SCALE * c.cast("double")).cast("long"))


@dataclass
class Fit:
    """What the rows of one length have in common; ``axes`` are rows of unit length, by falling ``values``."""

    n: int
    sums: list[int]
    values: np.ndarray
    axes: np.ndarray
    trace: float

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Exact in 64 bits, whose overflows cancel out unless the result itself is too large."""
        rough = ((self.n * x.astype(np.float64) - np.array(self.sums, dtype=np.float64)) ** 2).sum(axis=1)
        wrapped = np.array([(s + 2**63) % 2**64 - 2**63 for s in self.sums], dtype=np.int64)
        exact = ((self.n * x - wrapped) ** 2).sum(axis=1)
        return [int(e) if r < 2**63 else None for e, r in zip(exact, rough, strict=True)]


def sums_of(distinct: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """Rows and sums of each entry, by length; the upper and lower halves of the numbers are added apart."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for dim, own in pdf["x"].groupby(pdf["x"].map(len)):
                x = np.stack(own)
                yield pd.DataFrame({"dim": [dim], "n": [len(x)], "high": [(x >> 32).sum(axis=0)], "low": [(x & 0xFFFFFFFF).sum(axis=0)]})

    @F.pandas_udf("array<long>")
    def added(rows: pd.Series) -> np.ndarray:
        return np.stack(rows).sum(axis=0)

    parts = distinct.select("x").mapInPandas(partial, "dim int, n long, high array<long>, low array<long>")
    counts = parts.groupBy("dim").agg(F.sum("n").alias("n"))
    halves = parts.groupBy("dim").agg(added("high").alias("high"), added("low").alias("low"))
    rows = counts.join(halves, "dim").collect()
    return {row["dim"]: (row["n"], [(h << 32) + low for h, low in zip(row["high"], row["low"], strict=True)]) for row in rows}


def covariance(distinct: DataFrame, dim: int, n: int, mean: np.ndarray) -> np.ndarray:
    """Of all rows of that length, about ``mean``, with divisor n."""

    def products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, seen = np.zeros((dim, dim)), False
        for pdf in batches:
            for at in range(0, len(pdf), BATCH):
                x = np.stack(pdf["x"].iloc[at : at + BATCH]) - mean
                total += x.T @ x
                seen = True
        if seen:
            yield pd.DataFrame({"at": np.arange(dim), "row": list(total)})

    @F.pandas_udf("array<double>")
    def added(rows: pd.Series) -> np.ndarray:
        return np.stack(rows).sum(axis=0)

    rows = distinct.where(F.size("x") == dim).select("x").mapInPandas(products, "at int, row array<double>").groupBy("at").agg(added("row").alias("row"))
    found = rows.toPandas().sort_values("at")
    total = np.stack(found["row"]) / n
    return (total + total.T) / 2


def refined(matrix: np.ndarray, most: int = 30) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and eigenvectors as columns: single precision, corrected until nothing in double changes."""
    a = matrix.astype(np.longdouble)
    size = np.abs(matrix).max(initial=0.0)
    if not size:
        return np.zeros(len(a)), np.eye(len(a))
    a /= size
    x = np.linalg.eigh(a.astype(np.float32))[1].astype(np.longdouble)
    eye, best, tiny = np.eye(len(a), dtype=np.longdouble), np.inf, 1e-19 * len(a)
    for _ in range(most):
        r, s = eye - x.T @ x, x.T @ (a @ x)
        s = (s + s.T) / 2  # or rounding, over a small gap, would undo orthogonality
        values = np.diag(s) / (1 - np.diag(r))
        order = np.argsort(-values, kind="stable")
        x, r, s, values = x[:, order], r[np.ix_(order, order)], s[np.ix_(order, order)], values[order]
        off = s - np.diag(np.diag(s))
        left = float(max(np.abs(r).max(), np.abs(off).max()))
        if left < tiny or (left < 1e-16 and left > best / 2):
            break  # the last digits of the extended format only tremble
        best = min(best, left)
        reach = 2 * (np.linalg.norm((s - np.diag(values)).astype(np.float64)) + np.abs(values).max() * np.linalg.norm(r.astype(np.float64)))
        gap = values[None, :] - values[:, None]
        near = np.abs(gap) <= reach
        x = x + x @ np.where(near, r / 2, (s + values[None, :] * r) / np.where(near, 1, gap))
        for own in _clusters(values, reach):
            x[:, own] = _within(a, x[:, own])
    x /= np.sqrt((x * x).sum(axis=0))
    values = np.einsum("ij,ij->j", x, a @ x) * size
    order = np.argsort(-values, kind="stable")
    return values[order].astype(np.float64), x[:, order].astype(np.float64)


def _clusters(values: np.ndarray, reach: float) -> Iterator[slice]:
    """Runs of falling values that follow each other within ``reach``."""
    cuts = np.flatnonzero(values[:-1] - values[1:] > reach) + 1
    for first, last in zip([0, *cuts], [*cuts, len(values)], strict=True):
        if last - first > 1:
            yield slice(first, last)


def _within(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The vectors of a cluster, turned to the axes of the matrix within their space."""
    ax = a @ x
    middle = np.einsum("ij,ij->", x, ax) / x.shape[1]
    own = x.T @ (ax - middle * x)
    scale = np.abs(own).max()
    if not scale:
        return x
    turn = np.linalg.eigh(((own + own.T) / (2 * scale)).astype(np.float64))[1][:, ::-1]
    return x @ turn.astype(np.longdouble)


def fits(distinct: DataFrame) -> dict[int, Fit]:
    """By length of vectors; ``distinct`` has each ``x`` once."""
    out = {}
    for dim, (n, sums) in sums_of(distinct).items():
        v = covariance(distinct, dim, n, np.array([s / n for s in sums]))
        values, axes = refined(v)
        trace = float(np.trace(v))
        values = np.where(values > NOTHING * trace, values, 0.0)
        axes = axes.T
        axes *= np.sign(axes[np.arange(dim), np.abs(axes).argmax(axis=1)])[:, None]
        out[dim] = Fit(n, sums, values, axes, trace)
    return out


def _projected(x: np.ndarray, f: Fit, k: int) -> np.ndarray:
    """Rows by components; NaN where nothing varies."""
    e = f.values[:k]
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(e > 0, (x - f.mean) @ f.axes[:k].T / np.sqrt(e), np.nan)


def transformed(x: Column, known: dict[int, Fit], k: int = COMPONENTS) -> Column:
    """``struct<deviation, whitened array<double>>`` of vectors of whole numbers."""

    @F.arrow_udf("struct<deviation: bigint, whitened: array<double>>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for vectors in batches:
            ends = vectors.offsets.to_numpy()
            flat, sizes = vectors.values.to_numpy(zero_copy_only=False), np.diff(ends)
            deviation, white = [None] * len(vectors), [None] * len(vectors)
            for dim in np.unique(sizes):
                rows = np.flatnonzero(sizes == dim)
                f = known.get(int(dim))
                if f is None:
                    continue
                own = flat[ends[rows][:, None] + np.arange(dim)]
                w = _projected(own, f, min(k, dim))
                for row, far, values in zip(rows, f.deviation(own), w, strict=True):
                    deviation[row], white[row] = far, [None if np.isnan(c) else c for c in values]
            yield pa.StructArray.from_arrays([pa.array(deviation, pa.int64()), pa.array(white, pa.list_(pa.float64()))], ["deviation", "whitened"])

    return run(x)


def identity_errors(distinct: DataFrame, known: dict[int, Fit], k: int = COMPONENTS) -> dict[int, float]:
    """By length: the largest entry of the covariance of ``whitened`` less the identity, over each distinct vector once."""
    white = distinct.select(F.size("x").alias("dim"), transformed(F.col("x"), known, k)["whitened"].alias("w"))
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    at = lambda i: F.get("w", F.lit(i))
    found = white.groupBy("dim").agg(*[F.covar_pop(at(i), at(j)).alias(f"c{i}_{j}") for i, j in pairs])
    out = {}
    for row in found.collect():
        live = [i for i in range(min(k, row["dim"])) if known[row["dim"]].values[i] > 0]
        out[row["dim"]] = max((abs(row[f"c{i}_{j}"] - (i == j)) for i, j in pairs if i in live and j in live), default=0.0)
    return out


def digest(vectors: DataFrame, k: int = COMPONENTS) -> DataFrame:
    """Per row and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    kept = vectors.where(fit(F.col("embedding")) & (F.size("embedding") > 0)).select("vec_id", whole(F.col("embedding")).alias("x"))
    distinct = materialise(kept.select("x").distinct())
    known = fits(distinct)
    errors = identity_errors(distinct, known, k)
    rows = [
        (dim, c + 1, f.n, float(f.values[c] / f.trace) if f.trace else None, float(errors[dim]))
        for dim, f in known.items() for c in range(min(k, dim))
    ]
    shared = vectors.sparkSession.createDataFrame(rows, "dim int, component int, n long, explained double, identity_error double")
    each = kept.select("vec_id", F.size("x").alias("dim"), transformed(F.col("x"), known, k).alias("t"))
    each = each.select("vec_id", "dim", F.col("t.deviation").alias("deviation"), F.posexplode("t.whitened").alias("at", "whitened"))
    met = each.join(F.broadcast(shared), (each["dim"] == shared["dim"]) & (F.col("at") + 1 == F.col("component")))
    return met.select("vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error")
