"""Writers. Executors write; nothing passes through the driver but one-row summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triplane.shared import shuffles_dropped


def _save(writer, path: str, fmt: str) -> None:
    if fmt == "csv":
        writer.option("header", True).option("escape", '"').csv(path)
    else:
        writer.format(fmt).save(path)


def write_dictionary(dictionary: DataFrame, path: str, fmt: str = "parquet") -> None:
    """In id order, range-partitioned; ``fmt``: parquet or csv."""
    _save(dictionary.orderBy("id").write.mode("overwrite"), path, fmt)


def write_indexed(triples: DataFrame, path: str, by_split: bool = False, fmt: str = "parquet") -> None:
    writer = triples.write.mode("overwrite")
    _save(writer.partitionBy("split") if by_split else writer, path, fmt)


#: Rows of a compressed file at most: it is read by one task.
FILE_ROWS = 1 << 21


def write_triples(triples: DataFrame, path: str, fmt: str = "csv", compression: str = "none") -> None:
    """``head, relation, tail`` in the order of ``pos``, then of the terms: CSV with the header sub, pred, obj, or TSV without one.

    ``compression``: a codec that readers know by the files' names, like gzip; triples take a tenth of the disk then. Such files are
    many rather than large. What the order has shuffled is deleted.
    """
    rows, limit = triples.orderBy("pos", "head", "relation", "tail"), 0 if compression == "none" else FILE_ROWS
    if fmt == "csv":
        rows = rows.select(F.col("head").alias("sub"), F.col("relation").alias("pred"), F.col("tail").alias("obj"))
    else:
        rows = rows.select(F.concat_ws("\t", "head", "relation", "tail").alias("value"))
    writer = rows.write.mode("overwrite").option("compression", compression).option("maxRecordsPerFile", limit)
    with shuffles_dropped(triples.sparkSession):
        _save(writer, path, "csv" if fmt == "csv" else "text")


def write_tensors(parameters: DataFrame, path: str) -> None:
    """Each tensor of a model as a table of its own, ``path/name`` with id and vec; other columns than arrays are left out."""
    for name, kind in parameters.dtypes:
        if kind.startswith("array"):
            write_vectors(parameters.select("id", F.col(name).alias("vec")), f"{path}/{name}")


def write_metrics(path: str, history: DataFrame, config: dict, **evaluations: DataFrame) -> None:
    """One JSON document: the parameters, the loss of each epoch, and each evaluation's one row under its name."""
    rows = history.agg(F.array_sort(F.collect_list(F.struct(*history.columns))).alias("history"))
    named = [F.lit(v).alias(k) for k, v in config.items()]
    out = rows.select(F.struct(*named).alias("config") if named else F.lit(None).alias("config"), "history")
    for name, row in evaluations.items():
        out = out.crossJoin(row.limit(1).select(F.struct("*").alias(name)))  # one row each
    write_json(out, path)


def write_vectors(vectors: DataFrame, path: str) -> None:
    vectors.select("id", "vec").write.mode("overwrite").parquet(path)


def write_json(row: DataFrame, path: str) -> None:
    """Metadata, metrics or reports: one row, one document."""
    row.coalesce(1).write.mode("overwrite").json(path)


def write_catalog(catalog: DataFrame, path: str, *order) -> None:
    catalog.orderBy(*order).write.mode("overwrite").csv(path, header=True, escape='"')


def write_text(lines: DataFrame, path: str) -> None:
    """``(section, rank, line)`` in that order."""
    lines.orderBy("section", "rank").select(F.col("line").alias("value")).coalesce(1).write.mode("overwrite").text(path)
