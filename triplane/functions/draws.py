"""Reproducible draws: hashes of (seed, purpose, row key, index), so that partitioning cannot change them."""

from __future__ import annotations

from hashlib import md5

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def draw32(purpose: str, *parts: Column) -> Column:
    """A number in [0, 2**32), from MD5, which any SQL engine can repeat."""
    key = F.concat_ws(":", F.lit(purpose), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long")


def draw_below(n: Column, purpose: str, *parts: Column) -> Column:
    """A number in [0, n), for n well below 2**32."""
    return F.pmod(draw32(purpose, *parts), n)


def other_than(true_id: Column, n: Column, purpose: str, *parts: Column) -> Column:
    """Uniform over [0, n) without ``true_id``; n must be 2 or more."""
    c = draw_below(n - 1, purpose, *parts)
    return c + F.when(c >= true_id, 1).otherwise(0)


def drawn_vector(key: str, dim: int, reach: float) -> np.ndarray:
    """Uniform in (-reach, reach): numbers that :func:`draw32` gives for ``key`` and 0, 1, ..., in a task of Python at a fraction of the time."""
    first = f"{key}:".encode()
    heads = b"".join([md5(first + b"%d" % i).digest()[:4] for i in range(dim)])
    return (np.frombuffer(heads, ">u4") / float(1 << 32) * 2 - 1) * reach
