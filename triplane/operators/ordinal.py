"""Prefix sums and dense numbers over a total order, without one task that holds all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from triplane.shared import materialise


#: Rows of a task of :func:`parted`, about.
PART_ROWS = 1 << 18


def parts_of(rows: int) -> int:
    return max(1, -(-rows // PART_ROWS))


def parted(df: DataFrame, parts: int, *keys: str) -> DataFrame:
    """``df`` dealt by ``keys`` into so many parts, in which sums by these keys follow at once.

    The number of parts grows with the rows (:func:`parts_of`), so the memory of a task does not, whatever the session's number of
    shuffle partitions. For keys of which none has a great share of the rows; where one may, sums come before the shuffle.
    """
    return df.repartition(parts, *keys)


def prefix_sums(df: DataFrame, order: list[str], value: str, out: str = "before") -> DataFrame:
    """``df`` with the sum of ``value`` over all earlier rows.

    Range partitions keep the order; the sums of the parts are one row each, and only those meet in one place.
    """
    parts = materialise(df.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    sums = parts.groupBy("part").agg(F.sum(value).alias("own"))
    earlier = sums.select("part", (F.sum("own").over(Window.orderBy("part")) - F.col("own")).alias("earlier"))
    here = F.sum(value).over(Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)) - F.col(value)
    return parts.withColumn("here", here).join(F.broadcast(earlier), "part").withColumn(out, F.col("earlier") + F.col("here")).drop("part", "here", "earlier")


def dense_numbers(df: DataFrame, order: list[str], out: str = "id") -> DataFrame:
    """``df`` with 0, 1, 2, ... in the given order, which must be total."""
    return prefix_sums(df.withColumn("one", F.lit(1).cast("long")), order, "one", out).drop("one")


def top_k(df: DataFrame, group: list[str], count: Column, tie: Column, k: int) -> DataFrame:
    """The ``k`` rows of each group with the largest counts; ties by the smaller ``tie``. Adds ``rank``."""
    by = Window.partitionBy(*group) if group else Window.partitionBy()
    return df.withColumn("rank", F.row_number().over(by.orderBy(count.desc(), tie.asc()))).where(F.col("rank") <= k)
