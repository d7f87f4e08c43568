"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again by the next.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from triplane.llm import bpe_twotier, line_templates, mixing, quality_mil, simhash_trie
from triplane.shared import discard, shared_dir, table, temporary_tables


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it learns from ``labels``, but not from the held-out third.

    Null and empty texts are scored like others; rows that repeat stay or go alike; without labels of both kinds all have their share.
    """
    return quality_mil.accepted(docs, table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of recurring templates go, but for the first of each; all rows stay.

    Null texts stay null; a text that loses all lines is empty; rows that repeat id and text lose the same lines.
    """
    return line_templates.without_recurring(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: five-word shingles, a similarity of 0.8 or more.

    Texts without words, null ones among them, are one group. Rows that repeat an id with different texts, and rows without
    an id, are documents of their own; of rows that repeat both, one stays.
    """
    return simhash_trie.drop_similar(docs, shingle=5, similarity=0.8)


def mixing_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target takes it, twice at most.

    Texts without words have no size, and are taken like others of their source; a null source is one of its own.
    """
    return mixing.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The digest of ids and decoded bytes of each document of the mix; null texts have no ids."""
    tokenizer = bpe_twotier.Tokenizer(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return bpe_twotier.digest(docs, tokenizer)


STAGES = [
    ("quality", quality),
    ("lines", lines),
    ("near_duplicates", near_duplicates),
    ("mixing", mixing_to_weights),
    ("tokens", tokens),
]

#: A trained classifier and SimHash are beyond SQL; tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's result is a table in the shared folder, which goes once the next one is written."""
    docs = table(spark, sf_dir, "documents")
    base = f"{shared_dir(spark)}/triplane-pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        with temporary_tables(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        if k:
            discard(docs)
        docs = spark.read.parquet(f"{base}/{name}")
    return docs
