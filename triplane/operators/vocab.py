"""Dictionaries, indexed triples and their filters.

Triples are ``(head, relation, tail, pos)``; ``pos`` is unique and ordered.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from triplane.functions import config as C
from triplane.functions import terms as T
from triplane.operators.ordinal import dense_numbers
from triplane.shared import materialise, shuffles_dropped


def mentions(triples: DataFrame, *keep: str) -> DataFrame:
    """``(entity, place)``: both ends of each triple; heads come before tails."""
    ends = F.array(F.struct(F.col("head").alias("entity"), (2 * F.col("pos")).alias("place")), F.struct(F.col("tail").alias("entity"), (2 * F.col("pos") + 1).alias("place")))
    return triples.select(*keep, F.inline(ends))


def entity_vocab(triples: DataFrame) -> DataFrame:
    """``(entity, id)``: dense ids by first appearance; where places are shared, by name, so that every reading gives the same ids."""
    first = mentions(triples).groupBy("entity").agg(F.min("place").alias("first"))
    return dense_numbers(first, ["first", "entity"]).select("entity", "id")


def relation_vocab(triples: DataFrame) -> DataFrame:
    """``(relation, id)``. Relations are few, so a plain window numbers them after the sum."""
    first = triples.groupBy("relation").agg(F.min("pos").alias("first"))
    return first.select("relation", (F.row_number().over(Window.orderBy("first", "relation")) - 1).cast("long").alias("id"))


def fingerprint(term: Column) -> tuple[Column, Column]:
    """128 bits of a term, as two numbers."""
    return F.xxhash64(term), F.xxhash64(F.lit(7), term)


def short_fingerprint(term: Column) -> tuple[Column, Column]:
    """64 bits: enough where the dictionary has every term, because shared ones are told apart, and only a term it lacks might pass for another."""
    return F.xxhash64(term), F.lit(0).cast("long")


#: Fingerprints that several terms share, as rows of a broadcast at most.
CLASHES = 1 << 20
#: Triples that go through the joins of :func:`index_by_own_ids` at once, about.
AT_ONCE = 1 << 25


def index_by_own_ids(triples: DataFrame, rows: int) -> tuple[DataFrame, DataFrame]:
    """:func:`index_triples` by the terms' own first appearance, and the relations. ``rows``: how many triples there are, about."""
    parts = max(1, -(-rows // AT_ONCE))
    with shuffles_dropped(triples.sparkSession):
        entities, relations = entity_vocab(triples), relation_vocab(triples)
        if parts > 1:
            entities, relations = materialise(entities), materialise(relations)
        return index_triples(triples, entities, relations, short_fingerprint, parts), relations


def index_triples(triples: DataFrame, entities: DataFrame, relations: DataFrame, of: Callable[[Column], tuple[Column, Column]] = fingerprint, parts: int = 1) -> DataFrame:
    """``(pos, head_id, relation_id, tail_id)``; a term without an id raises when its row is computed.

    Triples meet the dictionary by fingerprints of their terms, so that no term goes through a shuffle, only two numbers for
    it. Fingerprints that several entities share are counted first; triples with one of these (normally none) meet by whole
    terms. With several ``parts``, rows are dealt to them by ``pos`` and each is stored before the next, so that besides the result
    the disk holds the shuffles of one part, if they are deleted (:func:`shuffles_dropped`).
    """
    named = triples.join(F.broadcast(relations.select("relation", F.col("id").alias("r"))), "relation", "left")  # few, and some are most of the triples
    known = entities.select("entity", "id", *[c.alias(n) for c, n in zip(of(F.col("entity")), ("k1", "k2"), strict=True)])
    clash = materialise(known.groupBy("k1", "k2").count().where("count > 1").select("k1", "k2"))
    ends = {f"{end}{i + 1}": c for end, term in (("h", "head"), ("t", "tail")) for i, c in enumerate(of(F.col(term)))}
    marked, n = named.withColumns(ends), clash.limit(CLASHES + 1).count()
    if parts == 1:
        return _indexed(marked, entities, known, clash, n)
    part = F.pmod(F.xxhash64("pos"), F.lit(parts))
    return reduce(DataFrame.unionByName, [materialise(_indexed(marked.where(part == k), entities, known, clash, n)) for k in range(parts)])


def _indexed(marked: DataFrame, entities: DataFrame, known: DataFrame, clash: DataFrame, n: int) -> DataFrame:
    if not n:
        return _numbers(marked.drop("head", "tail"), known)
    few = F.broadcast(clash) if n <= CLASHES else clash
    for end in ("h", "t"):
        names = clash.columns
        of_end = few.select(*[F.col(c).alias(f"{end}{c[1]}") for c in names], F.lit(True).alias(f"{end}_clash"))
        marked = marked.join(of_end, [f"{end}1", f"{end}2"], "left")
    twofold = F.coalesce("h_clash", F.lit(False)) | F.coalesce("t_clash", F.lit(False))
    clean = _numbers(marked.where(~twofold).drop("head", "tail", "h_clash", "t_clash"), known)
    return clean.unionByName(_numbers_by_term(marked.where(twofold).select("pos", "head", "r", "tail"), entities))


def _need(column: str, what: str) -> Column:
    return F.coalesce(F.col(column), F.raise_error(F.concat(F.lit(f"no id: {what} of the triple at "), F.col("pos"))).cast("long"))


def _ids(met: DataFrame) -> DataFrame:
    return met.select("pos", _need("h", "head").alias("head_id"), _need("r", "relation").alias("relation_id"), _need("t", "tail").alias("tail_id"))


def _numbers(triples: DataFrame, known: DataFrame) -> DataFrame:
    """By fingerprints: pos, r, h1, h2, t1, t2."""
    for end in ("h", "t"):
        triples = triples.join(known.select(F.col("k1").alias(f"{end}1"), F.col("k2").alias(f"{end}2"), F.col("id").alias(end)), [f"{end}1", f"{end}2"], "left").drop(f"{end}1", f"{end}2")
    return _ids(triples)


def _numbers_by_term(triples: DataFrame, entities: DataFrame) -> DataFrame:
    """By whole terms: pos, head, r, tail."""
    for end, term in (("h", "head"), ("t", "tail")):
        triples = triples.join(entities.select(F.col("entity").alias(term), F.col("id").alias(end)), term, "left")
    return _ids(triples)


def uri_only(triples: DataFrame) -> DataFrame:
    return triples.where(T.is_uri(F.col("head")) & T.is_uri(F.col("tail")))


def uri_counts(triples: DataFrame) -> DataFrame:
    """One row: kept, dropped, total."""
    good = T.is_uri(F.col("head")) & T.is_uri(F.col("tail"))
    return triples.agg(F.count_if(good).alias("kept"), F.count_if(~good).alias("dropped"), F.count("*").alias("total"))


def resources_only(rdf: DataFrame) -> DataFrame:
    """RDF triples whose object is not a literal."""
    return rdf.where(F.col("obj.kind") != "Literal")


def term_kinds(rdf: DataFrame) -> DataFrame:
    """``(position, kind, n)`` over subjects, predicates and objects."""
    each = F.array(*[F.struct(F.lit(p).alias("position"), F.col(f"{c}.kind").alias("kind")) for p, c in (("subject", "subj"), ("predicate", "pred"), ("object", "obj"))])
    return rdf.select(F.inline(each)).groupBy("position", "kind").agg(F.count("*").alias("n"))


def relation_ids(relations: DataFrame, names: tuple[str, ...] = C.INDICATION_RELATIONS, at_least: int = 2) -> list[int]:
    """Sorted ids of the named relations; fewer than ``at_least`` are an error. Names are a short list."""
    found = sorted({r["id"] for r in relations.where(F.col("relation").isin(*names)).select("id").collect()})
    if len(found) < at_least:
        raise ValueError(f"found {len(found)} of the relations {names}, need {at_least}")
    return found


def only_relations(indexed: DataFrame, ids: list[int]) -> DataFrame:
    return indexed.where(F.col("relation_id").isin(*ids))


def check_ids(indexed: DataFrame, n_entities: int, n_relations: int) -> DataFrame:
    """``indexed``; a row with an id outside of 0..n-1 raises when it is computed."""
    inside = lambda c, n: F.col(c).isNotNull() & (F.col(c) >= 0) & (F.col(c) < n)
    good = inside("head_id", n_entities) & inside("tail_id", n_entities) & inside("relation_id", n_relations)
    said = F.format_string("id out of range: %s %s %s", "head_id", "relation_id", "tail_id")
    return indexed.withColumn("head_id", F.when(good, F.col("head_id")).otherwise(F.raise_error(said).cast("long")))


def with_inverses(indexed: DataFrame, n_relations: int) -> DataFrame:
    """Edges and their inverses, whose relation ids follow the others."""
    back = indexed.select(F.col("tail_id").alias("head_id"), (F.col("relation_id") + n_relations).alias("relation_id"), F.col("head_id").alias("tail_id"))
    return indexed.select("head_id", "relation_id", "tail_id").unionByName(back)


def metadata(triples: DataFrame, dim: int, dropped: int = 0, kinds: DataFrame | None = None, files: dict[str, str] | None = None) -> DataFrame:
    """One row: counts of entities, relations, triples, rows dropped before, and each split.

    ``kinds`` (:func:`term_kinds`) adds the map ``term_counts``, by position and kind; ``files`` adds itself as a map.
    """
    ends = F.explode(F.array("head", "tail"))
    counts = triples.agg(F.count("*").alias("num_triples"), F.count_distinct("relation").alias("num_relations"), *[F.count_if(F.col("split") == s).alias(f"num_{s}") for s in ("train", "valid", "test")])
    out = counts.crossJoin(triples.select(ends.alias("e")).agg(F.count_distinct("e").alias("num_entities"))).withColumns({"embedding_dim": F.lit(dim), "num_dropped": F.lit(dropped).cast("long")})
    if kinds is not None:
        entry = F.struct(F.concat_ws(":", "position", "kind"), "n")
        out = out.crossJoin(kinds.agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("term_counts")))  # one row each
    if files is not None:
        out = out.withColumn("files", F.create_map(*[F.lit(x) for pair in sorted(files.items()) for x in pair]))
    return out
