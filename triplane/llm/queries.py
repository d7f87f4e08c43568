"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from triplane.llm import (
    bloom_slices,
    bpe_twotier,
    embed_passes,
    flac_media,
    html_tagpath,
    line_templates,
    mixing,
    multi_index,
    quality_mil,
    simhash_trie,
    suffix_sparse,
    url_rank,
    whitening,
)
from triplane.shared import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_mil.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_tagpath.digest(table(spark, sf_dir, "pages"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_trie.digest(table(spark, sf_dir, "documents"))


def op4_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_templates.digest(table(spark, sf_dir, "documents"))


def op5_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_sparse.passages(table(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.digest(table(spark, sf_dir, "documents"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokenizer = bpe_twotier.Tokenizer(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return bpe_twotier.digest(table(spark, sf_dir, "documents"), tokenizer)


def op8_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_passes.digest(table(spark, sf_dir, "embeddings"))


def op9_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rank.verdicts(table(spark, sf_dir, "pages"))


def op10_flac(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flac_media.digest(table(spark, sf_dir, "documents"))


def op11_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bloom_slices.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_index.digest(table(spark, sf_dir, "embeddings"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.digest(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Query] = {
    "op1_quality": op1_quality,
    "op2_html": op2_html,
    "op3_simhash": op3_simhash,
    "op4_line_templates": op4_line_templates,
    "op5_suffixes": op5_suffixes,
    "op6_mixing": op6_mixing,
    "op7_bpe": op7_bpe,
    "op8_embeddings": op8_embeddings,
    "op9_urls": op9_urls,
    "op10_flac": op10_flac,
    "op11_lexical": op11_lexical,
    "op12_neighbours": op12_neighbours,
    "op13_whitening": op13_whitening,
}

ORACLE_SQL: dict[str, str] = {
    "op4_line_templates": line_templates.SQL,
    "op6_mixing": mixing.SQL,
    "op11_lexical": bloom_slices.SQL,
}
