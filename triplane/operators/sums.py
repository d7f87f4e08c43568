"""Sums of vectors by key: within each batch of rows first, so that what is shuffled has one row per key and batch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def _added(pdf: pd.DataFrame, keys: list[str], vec: str, n: np.ndarray) -> pd.DataFrame:
    """One row per key: ``vec`` and ``n`` added. Keys come in the order in which they are first met."""
    at = pdf.groupby(keys, sort=False).ngroup().to_numpy()
    first = np.unique(at, return_index=True)[1]
    x = np.stack(pdf[vec]).astype(np.float64)
    order = np.argsort(at, kind="stable")
    total = np.add.reduceat(x[order], np.flatnonzero(np.diff(at[order], prepend=-1)), axis=0)
    return pdf.iloc[first][keys].assign(total=list(total), n=np.bincount(at, n).astype(np.int64))


def by_runs(sums: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key of rows (*keys, total, n), in tasks that see the rows of a key one after the other and hold a batch of them.

    Vectors of a table may have one length for each value of the keys' columns but the last.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = None  # the last key, whose rows may go on in the next batch
        for pdf in parts:
            if not len(pdf):
                continue
            pdf = pdf if kept is None else pd.concat([kept, pdf], ignore_index=True)
            lengths = pdf["total"].str.len().to_numpy()
            cuts = np.flatnonzero(np.diff(lengths)) + 1
            pieces = [_added(piece, keys, "total", piece["n"].to_numpy()) for piece in (pdf.iloc[a:b] for a, b in zip([0, *cuts], [*cuts, len(pdf)], strict=True))]
            yield from pieces[:-1]
            yield pieces[-1].iloc[:-1]
            kept = pieces[-1].iloc[-1:]
        if kept is not None:
            yield kept

    return sums.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(run, sums.schema)


def summed_vectors(df: DataFrame, keys: list[str], vec: str = "vec") -> DataFrame:
    """``(*keys, total, n)``: sums of the vectors of a key, all of one length, and their number. Keys are not null."""
    kinds = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)

    def partial(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            if len(pdf):
                yield _added(pdf, keys, vec, np.ones(len(pdf)))

    return by_runs(df.select(*keys, vec).mapInPandas(partial, f"{kinds}, total array<double>, n long"), keys)
