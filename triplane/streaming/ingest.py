"""Triples from files that keep arriving, by the same parser as the batch readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triplane.sources.readers import split_fields


def stream_triples(spark: SparkSession, path: str) -> DataFrame:
    """``head, relation, tail`` of tab-separated files in a folder; lines without three fields are left out."""
    lines = spark.readStream.text(path)
    return split_fields(lines, strict=False).where("NOT bad").drop("bad")


def relation_counts(triples: DataFrame) -> DataFrame:
    return triples.groupBy("relation").agg(F.count("*").alias("n"))
