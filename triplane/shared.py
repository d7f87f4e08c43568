"""Helpers that every subpackage may use: table reads and lineage cuts."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, as a lazy scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Only a session on one machine, as in tests, may do without."""
    named = spark.conf.get("spark.checkpoint.dir", "")
    if not named and not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return named or tempfile.mkdtemp(prefix="triplane-")


#: Spark's own setting for this; queries that a block only plans, and others run later, are not concerned.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of each query run within this block are deleted when it ends, not when the driver happens to collect garbage."""
    before = spark.conf.get(_CLEAN)
    spark.conf.set(_CLEAN, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEAN, before)


_tables: ContextVar[list[str] | None] = ContextVar("tables", default=None)


@contextmanager
def temporary_tables(spark: SparkSession) -> Iterator[None]:
    """What :func:`materialise` writes within this block is deleted at its end; results must be written elsewhere by then."""
    token = _tables.set([])
    try:
        yield
    finally:
        paths = _tables.get()
        _tables.reset(token)
        for path in paths:
            delete(spark, path)


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    This cuts the lineage like ``checkpoint()`` does, but computes the plan a single time, keeps the
    columns compressed, and survives the loss of any executor.
    """
    path = f"{shared_dir(df.sparkSession)}/triplane-{uuid.uuid4().hex}"
    if (tables := _tables.get()) is not None:
        tables.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def discard(df: DataFrame) -> None:
    """Delete the files of a :func:`materialise` result that no plan reads any more."""
    spark = df.sparkSession
    for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if "/triplane-" in path:
            delete(spark, path)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or a longer one that no column of ``df`` has, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
