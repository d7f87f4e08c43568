"""Prior vectors: links from family members to sequences, an encoder given by the caller, and coverage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triplane.functions import config as C
from triplane.functions import terms as T
from triplane.functions import vectors as V
from triplane.operators.sums import summed_vectors

MOST = 1022
SAMPLE = 10


def members(entities: DataFrame, pattern: str = C.MEMBER) -> DataFrame:
    return entities.where(F.col("entity").rlike(pattern)).select("entity")


def links(triples: DataFrame) -> DataFrame:
    """``(entity, key)``: the last link of a member wins."""
    rows = triples.where(F.col("head").rlike(C.MEMBER) & (F.col("relation") == C.LINK_RELATION) & F.col("tail").rlike(C.LINK_TARGET))
    return rows.groupBy(F.col("head").alias("entity")).agg(F.max_by(F.regexp_extract("tail", C.LINK_TARGET, 1), "pos").alias("key"))


def qualified(of: DataFrame, linked: DataFrame, sequences: DataFrame, most: int = MOST) -> DataFrame:
    """Each member with key, cut chains and status: no link, no row, empty chain or ok."""
    rows = sequences.select(F.col("inn_number").alias("key"), "heavy", "light")
    met = of.join(linked, "entity", "left").join(rows, "key", "left")
    status = F.when(F.col("key").isNull(), "missing link").when(F.col("heavy").isNull(), "missing row").when((F.col("heavy") == "") | (F.col("light") == ""), "empty chain").otherwise("ok")
    (heavy, cut_h), (light, cut_l) = T.truncate(F.col("heavy"), most), T.truncate(F.col("light"), most)
    ok = status == "ok"
    return met.select("entity", "key", status.alias("status"), F.when(ok, heavy).alias("heavy"), F.when(ok, light).alias("light"), (ok & (cut_h | cut_l)).alias("was_cut"))


def coverage(of: DataFrame, linked: DataFrame) -> DataFrame:
    """One row: eight counts and four sorted samples. ``of``: :func:`qualified`; ``linked``: all links."""
    s, key = F.col("status"), F.col("key")
    sample = lambda test, what: F.slice(F.array_sort(F.collect_set(F.when(test, what))), 1, SAMPLE)
    out = of.agg(
        F.count("*").alias("members"),
        F.count_if(s == "ok").alias("with_prior"),
        F.count_if(s != "ok").alias("fallback"),
        F.count_if(s == "missing link").alias("missing_link"),
        F.count_if(s == "missing row").alias("missing_row"),
        F.count_distinct(F.when(s == "empty chain", key)).alias("empty_keys"),
        F.count_distinct(F.when(F.col("was_cut"), key)).alias("cut_keys"),
        sample(s == "missing link", F.col("entity")).alias("missing_link_sample"),
        sample(s == "missing row", F.col("entity")).alias("missing_row_sample"),
        sample(s == "empty chain", key).alias("empty_sample"),
        sample(F.col("was_cut"), key).alias("cut_sample"),
    )
    return out.crossJoin(linked.agg(F.count("*").alias("linked")))


def distinct_sequences(of: DataFrame) -> DataFrame:
    return of.where("status = 'ok'").select(F.explode(F.array("heavy", "light")).alias("sequence")).distinct()


#: Characters that a batch of sequences may have, filled up to its longest.
BATCH = 4096


def batches_by_length(lengths: np.ndarray, most: int = BATCH) -> list[slice]:
    """Cuts of ascending lengths: each has as many sequences as fit when all are filled up to the longest, at least one."""
    out, at = [], 0
    while at < len(lengths):
        end = at + 1
        while end < len(lengths) and lengths[end] * (end + 1 - at) <= most:
            end += 1
        out.append(slice(at, end))
        at = end
    return out


def encode(sequences: DataFrame, encoder: Callable[[list[str]], np.ndarray], most: int = BATCH, known: DataFrame | None = None) -> DataFrame:
    """``(sequence, vec)``: each distinct sequence once; ``encoder`` gives one row per sequence of a batch.

    Sequences are dealt into ranges of like length, and batches of a range are bounded by their filled-up size, so that little
    is filled up and a long sequence is alone. ``known`` (hash, vec; see :func:`encoded_by_hash`) has the vectors of sequences
    encoded before, which aren't encoded again.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            pdf = pdf.sort_values("n", kind="stable")
            texts = pdf["sequence"].tolist()
            rows = [v for own in batches_by_length(pdf["n"].to_numpy(), most) for v in np.asarray(encoder(texts[own]), dtype=np.float32)]
            yield pd.DataFrame({"sequence": texts, "vec": rows})

    own = sequences.select("sequence", F.length("sequence").alias("n"), F.sha2("sequence", 256).alias("hash"))
    found = None
    if known is not None:
        met = own.join(known.select("hash", F.col("vec").alias("old")), "hash", "left")
        found, own = met.where("old IS NOT NULL").select("sequence", F.col("old").alias("vec")), met.where("old IS NULL")
    fresh = own.select("sequence", "n").repartitionByRange("n", F.xxhash64("sequence")).mapInPandas(run, "sequence string, vec array<float>")
    return fresh if found is None else found.unionByName(fresh)


def encoded_by_hash(encoded: DataFrame) -> DataFrame:
    """``(hash, vec)``: to be kept, for :func:`encode` to find what it has encoded before."""
    return encoded.select(F.sha2("sequence", 256).alias("hash"), "vec")


def pool(tokens: DataFrame, key: str, position: str = "at", length: str = "n") -> DataFrame:
    """Mean of token vectors over positions 1..n, which leaves special tokens out."""
    inside = tokens.where((F.col(position) >= 1) & (F.col(position) <= F.col(length)))
    return summed_vectors(inside, [key]).select(key, F.transform("total", lambda x: (x / F.col("n")).cast("float")).alias("vec"))


def prior_vectors(of: DataFrame, encoded: DataFrame) -> DataFrame:
    """``(entity, prior)``: both chains' vectors, one after the other."""
    heavy, light = (encoded.select(F.col("sequence").alias(c), F.col("vec").alias(f"{c}_vec")) for c in ("heavy", "light"))
    return of.where("status = 'ok'").join(heavy, "heavy").join(light, "light").select("entity", F.concat("heavy_vec", "light_vec").alias("prior"))


def with_priors(vocabulary: DataFrame, priors: DataFrame, dim: int, seed: int = 0) -> DataFrame:
    """``(id, vec, has_prior)``: the prior where there is one, else a random vector."""
    met = vocabulary.join(priors, "entity", "left")
    vec = F.coalesce("prior", V.random_vector("entity", F.col("id"), dim, seed))
    return met.select("id", vec.alias("vec"), F.col("prior").isNotNull().alias("has_prior"))
