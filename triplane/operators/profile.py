"""Profiles of a graph: statistics, entity typing, relation histograms, catalogs and reports.

``triples``: head, relation, tail, pos, split. ``annotations``: sub, pred, obj, pos. Strings sort by code point.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from triplane.functions import config as C
from triplane.functions import terms as T
from triplane.operators.ordinal import parted, parts_of, top_k
from triplane.operators.vocab import mentions
from triplane.shared import materialise

TOP = 15


def split_stats(triples: DataFrame, rows: int | None = None) -> DataFrame:
    """Per split: triples, entities, relations. ``rows``: about how many triples there are, where that is known."""
    ends = entity_mentions(triples, rows).groupBy("split").agg(F.count("entity").alias("entities"))
    return triples.groupBy("split").agg(F.count("*").alias("triples"), F.count_distinct("relation").alias("relations")).join(ends, "split")


def relation_topk(triples: DataFrame, k: int = TOP) -> DataFrame:
    """Per split, the most frequent relations; ties by first appearance."""
    counts = triples.groupBy("split", "relation").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    return top_k(counts, ["split"], F.col("n"), F.col("first"), k).select("split", "relation", "n", "rank")


def entity_mentions(triples: DataFrame, rows: int | None = None) -> DataFrame:
    """``(split, entity, n)``. ``rows``: about how many triples there are, where that is known."""
    rows = triples.count() if rows is None else rows
    return parted(mentions(triples, "split").drop("place"), parts_of(2 * rows), "split", "entity").groupBy("split", "entity").agg(F.count("*").alias("n"))


def entities_of(triples: DataFrame) -> DataFrame:
    return mentions(triples).select("entity").distinct()


def relations_of(triples: DataFrame) -> DataFrame:
    return triples.select("relation").distinct()


def routed(annotations: DataFrame, triples: DataFrame) -> DataFrame:
    """Annotations that matter; see :func:`routed_to`."""
    return routed_to(annotations, entities_of(triples), relations_of(triples))


def routed_to(annotations: DataFrame, entities: DataFrame, relations: DataFrame) -> DataFrame:
    """Annotations that matter: ``(subject, what, value, pos, is_entity, is_relation)``; what: type, label or definition.

    Types need a subject of the graph; labels and definitions may also be of well-known vocabularies. ``entities``: entity,
    ``relations``: relation, both distinct.
    """
    what = F.when(F.col("pred") == C.RDF_TYPE, "type").when(F.col("pred") == C.RDFS_LABEL, "label").when(F.col("pred") == C.SKOS_DEFINITION, "definition")
    value = F.when(F.col("pred") == C.SKOS_DEFINITION, F.col("obj")).otherwise(T.compact_term(F.col("obj")))
    rows = annotations.select(T.compact_term(F.col("sub")).alias("subject"), what.alias("what"), value.alias("value"), "pos").where("what IS NOT NULL")
    rows = rows.join(entities.select(F.col("entity").alias("subject"), F.lit(True).alias("is_entity")), "subject", "left")
    rows = rows.join(relations.select(F.col("relation").alias("subject"), F.lit(True).alias("is_relation")), "subject", "left")
    known = F.col("is_entity").isNotNull() | F.col("is_relation").isNotNull()
    named = (F.col("what") != "type") & T.starts_with_any(F.col("subject"), C.LABELLED_PREFIXES)
    return rows.where(known | named)


def latest(rows: DataFrame, what: str) -> DataFrame:
    """``(subject, value)``: the last annotation of a kind wins."""
    return rows.where(F.col("what") == what).groupBy("subject").agg(F.max_by("value", "pos").alias("value"))


def type_sets(rows: DataFrame) -> DataFrame:
    """``(entity, types)``: sorted distinct types."""
    own = rows.where("what = 'type' AND is_entity")
    return own.groupBy(F.col("subject").alias("entity")).agg(F.array_sort(F.collect_set("value")).alias("types"))


def primary_types(entities: DataFrame, types: DataFrame, labels: DataFrame) -> DataFrame:
    """``(entity, family, types, primary_type)``: the first type in order that names a generic category, else the first
    with a telling label, else the family."""
    each = types.select("entity", F.explode("types").alias("type")).join(labels.select(F.col("subject").alias("type"), F.col("value").alias("label")), "type", "left")
    each = each.withColumn("local", T.local_name(F.col("type")))
    local = F.col("local")
    generic = F.when(F.col("label").isin(*C.GENERIC_CATEGORIES), F.col("label")).when(local.isin(*C.GENERIC_CATEGORIES), local)
    telling = F.when((F.col("label") != "") & ~F.col("label").isin(*C.NO_CATEGORY), F.col("label"))
    named = each.select("entity", "type", generic.alias("generic"), telling.alias("telling")).withColumn("found", F.coalesce("generic", "telling"))
    best = named.where("found IS NOT NULL").groupBy("entity").agg(F.min_by("found", F.struct(F.col("generic").isNull(), "type")).alias("named"))
    all_ = entities.join(types, "entity", "left").join(best, "entity", "left").withColumn("family", T.family(F.col("entity")))
    return all_.select("entity", "family", "types", F.coalesce("named", "family").alias("primary_type"))


def entity_dim(triples: DataFrame, rows: DataFrame) -> DataFrame:
    """:func:`dim_of` the entities of ``triples``."""
    return dim_of(entities_of(triples), rows)


def dim_of(entities: DataFrame, rows: DataFrame) -> DataFrame:
    """``(entity, family, types, primary_type, coarse_category)`` of every entity; ``rows``: :func:`routed`."""
    typed = primary_types(entities, type_sets(rows), latest(rows, "label"))
    return typed.withColumn("coarse_category", T.coarse_category(F.col("entity"), F.col("family"), F.col("primary_type"), F.col("types")))


def global_stats(triples: DataFrame, dim: DataFrame) -> DataFrame:
    typed = F.count_if(F.size(F.coalesce("types", F.array())) > 0)
    counts = dim.agg(F.count("*").alias("entities"), typed.alias("typed_entities"))
    out = triples.agg(F.count("*").alias("triples"), F.count_distinct("relation").alias("relations")).crossJoin(counts)
    return out.withColumn("typed_fraction", T.ratio(F.col("typed_entities"), F.col("entities")))


def family_counts(dim: DataFrame) -> DataFrame:
    """``(kind, name, n)`` for families and primary types."""
    both = F.array(F.struct(F.lit("family").alias("kind"), F.col("family").alias("name")), F.struct(F.lit("primary_type").alias("kind"), F.col("primary_type").alias("name")))
    return dim.select(F.inline(both)).groupBy("kind", "name").agg(F.count("*").alias("n"))


def family_types(dim: DataFrame) -> DataFrame:
    """``(family, primary_type, n, rank)``; ties by the smallest entity. Rank 1 is dominant."""
    counts = dim.groupBy("family", "primary_type").agg(F.count("*").alias("n"), F.min("entity").alias("first"))
    return top_k(counts, ["family"], F.col("n"), F.col("first"), TOP).select("family", "primary_type", "n", "rank")


def family_examples(dim: DataFrame, k: int = 5) -> DataFrame:
    """The first entities of each family."""
    return dim.select("family", "entity", F.row_number().over(Window.partitionBy("family").orderBy("entity")).alias("rank")).where(F.col("rank") <= k)


def guidance_table(dim_or_session) -> DataFrame:
    spark = getattr(dim_or_session, "sparkSession", dim_or_session)
    return spark.createDataFrame(C.GUIDANCE, "name string, strategy string, prior string, alignment string")


def with_guidance(df: DataFrame, family: str = "family", primary: str = "primary_type") -> DataFrame:
    """``df`` with strategy, prior and alignment: by family, else by primary type, else the default."""
    table = guidance_table(df)
    names = ("strategy", "prior", "alignment")
    by_family = table.select(F.col("name").alias(family), F.struct(*names).alias("by_family"))
    by_type = table.select(F.col("name").alias(primary), F.struct(*names).alias("by_type"))
    joined = df.join(F.broadcast(by_family), family, "left").join(F.broadcast(by_type), primary, "left")
    best = F.coalesce("by_family", "by_type", F.struct(*[F.lit(v).alias(k) for k, v in zip(names, C.DEFAULT_GUIDANCE, strict=True)]))
    return joined.select(*df.columns, *[best[n].alias(n) for n in names])


def relation_profile(triples: DataFrame, dim: DataFrame, k: int = TOP) -> DataFrame:
    """``(relation, side, category, n, rank)``: the most frequent categories of heads and tails."""
    ends = F.array(*[F.struct(F.lit(s).alias("side"), F.col(s).alias("entity")) for s in ("head", "tail")])
    # an entity with many triples is one row for each relation and side before it meets its category
    each = triples.select("relation", "pos", F.inline(ends)).groupBy("relation", "side", "entity").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    each = each.join(dim.select("entity", F.col("coarse_category").alias("category")), "entity")
    counts = each.groupBy("relation", "side", "category").agg(F.sum("n").alias("n"), F.min("first").alias("first"))
    return top_k(counts, ["relation", "side"], F.col("n"), F.col("first"), k).select("relation", "side", "category", "n", "rank")


def relation_catalog(triples: DataFrame, dim: DataFrame, rows: DataFrame) -> DataFrame:
    """One row per relation: label, kind, count, and the categories of both ends as ``name:count`` joined by ``|``."""
    counts = triples.groupBy("relation").agg(F.count("*").alias("count"))
    kinds = latest(rows.where("is_relation"), "type").select(F.col("subject").alias("relation"), T.after_colon(F.col("value")).alias("kind"))
    labels = latest(rows.where("is_relation"), "label").select(F.col("subject").alias("relation"), F.col("value").alias("label"))
    listed = relation_profile(triples, dim).groupBy("relation", "side").agg(F.array_sort(F.collect_list(F.struct("rank", "category", "n"))).alias("list"))
    text = F.array_join(F.transform("list", lambda x: F.concat(x["category"], F.lit(":"), x["n"].cast("string"))), "|")
    sides = listed.groupBy("relation").agg(F.max(F.when(F.col("side") == "head", text)).alias("head_categories"), F.max(F.when(F.col("side") == "tail", text)).alias("tail_categories"))
    out = counts.join(kinds, "relation", "left").join(labels, "relation", "left").join(sides, "relation")
    return out.select("relation", F.coalesce("label", T.local_name(F.col("relation"))).alias("label"), F.coalesce("kind", F.lit("Unknown")).alias("kind"), "count", "head_categories", "tail_categories")


def shown_types(dim: DataFrame, labels: DataFrame) -> DataFrame:
    """``(entity, shown)``: labels of an entity's types, sorted, repeats included."""
    each = dim.select("entity", F.explode("types").alias("type")).join(labels.select(F.col("subject").alias("type"), F.col("value").alias("label")), "type", "left")
    return each.groupBy("entity").agg(F.array_sort(F.collect_list(F.coalesce("label", T.local_name(F.col("type"))))).alias("shown"))


def entity_catalog(dim: DataFrame, rows: DataFrame) -> DataFrame:
    labels = latest(rows, "label")
    own = labels.select(F.col("subject").alias("entity"), F.col("value").alias("label"))
    out = with_guidance(dim).join(own, "entity", "left").join(shown_types(dim, labels), "entity", "left")
    explicit = F.coalesce(F.array_join("shown", "|"), F.lit(""))
    return out.select("entity", F.coalesce("label", T.local_name(F.col("entity"))).alias("label"), "family", "primary_type", "coarse_category", explicit.alias("explicit_types"), F.col("strategy").alias("embedding_strategy"))


def family_members(dim: DataFrame, rows: DataFrame, family: str) -> DataFrame:
    """``(entity, primary_type, types, label)`` of one family; types joined by ``|``."""
    out = entity_catalog(dim.where(F.col("family") == family), rows)
    return out.select("entity", "primary_type", F.col("explicit_types").alias("types"), "label")


def report_rows(triples: DataFrame, dim: DataFrame, rows: DataFrame, members: str, k: int = TOP) -> DataFrame:
    """The whole report as ``(section, of, rank, name, n, text)``; ``members``: the family that is listed one by one.

    Sections: split (text: entities and relations), split_relation, global (typed entities among all), primary_type and
    family (2k each), family_type, relation (text: categories of both ends), relation_kind, member and prior.
    """
    nothing = F.lit(None).cast("string")
    line = lambda df, section, of, rank, name, n, text: df.select(F.lit(section).alias("section"), of.alias("of"), rank.cast("int").alias("rank"), name.alias("name"), n.cast("long").alias("n"), text.alias("text"))
    split, c = F.col("split"), F.col
    sizes = lambda what: dim.groupBy(F.col(what).alias("name")).agg(F.count("*").alias("n"), F.min("entity").alias("first"))
    types = family_types(dim)
    main = with_guidance(types.where("rank = 1").select("family", "primary_type")).select(c("family").alias("name"), F.concat_ws("|", "primary_type", "strategy").alias("text"))
    catalog = relation_catalog(triples, dim, rows).join(triples.groupBy("relation").agg(F.min("pos").alias("first")), "relation")
    catalog = materialise(catalog.select("relation", "label", "kind", "count", F.concat_ws(" / ", "head_categories", "tail_categories").alias("ends"), "first"))
    stats = global_stats(triples, dim)
    own = family_members(dim, rows, members)
    prior = guidance_table(dim).where(c("name") == members)
    parts = [
        line(split_stats(triples), "split", nothing, F.lit(0), split, c("triples"), F.concat_ws("|", c("entities").cast("string"), c("relations").cast("string"))),
        line(relation_topk(triples, k), "split_relation", split, c("rank"), c("relation"), c("n"), nothing),
        line(stats, "global", nothing, F.lit(0), F.lit("typed"), c("typed_entities"), c("entities").cast("string")),
        line(top_k(sizes("primary_type"), [], c("n"), c("first"), 2 * k), "primary_type", nothing, c("rank"), c("name"), c("n"), nothing),
        line(top_k(sizes("family"), [], c("n"), c("first"), 2 * k).join(main, "name"), "family", nothing, c("rank"), c("name"), c("n"), c("text")),
        line(types, "family_type", c("family"), c("rank"), c("primary_type"), c("n"), nothing),
        line(top_k(catalog, [], c("count"), c("first"), k), "relation", nothing, c("rank"), c("relation"), c("count"), c("ends")),
        line(catalog, "relation_kind", nothing, F.lit(0), c("relation"), c("count"), F.concat_ws("|", "kind", "label")),
        line(own, "member", F.lit(members), F.lit(0), c("entity"), F.lit(1), F.concat_ws("|", "primary_type", "types", "label")),
        line(prior, "prior", F.lit(members), F.lit(0), c("strategy"), F.lit(0), F.concat_ws("|", "prior", "alignment")),
    ]
    return reduce(DataFrame.unionByName, parts)


#: Sections of the report in the order of its text, with their headings.
HEADINGS = {"split": "Splits", "global": "All splits", "family": "Leading families", "primary_type": "Leading primary types", "relation": "Leading relations", "member": "Members", "prior": "Prior"}


def report(report_of: DataFrame) -> DataFrame:
    """One row with the report as JSON: an array of rows under each section. ``report_of``: :func:`report_rows`."""
    listed = report_of.groupBy("section").agg(F.array_sort(F.collect_list(F.struct("of", "rank", "name", "n", "text"))).alias("rows"))
    return listed.agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("section", "rows"))))).alias("report"))


def text_report(report_of: DataFrame, k: int = TOP) -> DataFrame:
    """``(section, rank, line)`` of the same: headings have rank -1; of the leading ones ``k`` are told, members only counted."""
    order = list(HEADINGS)
    number = F.element_at(F.create_map(*[F.lit(x) for i, s in enumerate(order) for x in (s, i)]), F.col("section"))
    told = report_of.where(F.col("section").isin(*[s for s in order if s != "member"]) & (F.col("rank") <= k))
    lines = told.select(number.alias("section"), "rank", F.concat(F.lit("- "), "name", F.lit(": "), F.col("n").cast("string"), F.coalesce(F.concat(F.lit(" | "), "text"), F.lit(""))).alias("line"))
    members = report_of.where("section = 'member'").agg(F.count("*").alias("n")).select(F.lit(order.index("member")).alias("section"), F.lit(0).alias("rank"), F.concat(F.lit("- "), F.col("n").cast("string")).alias("line"))
    heads = report_of.sparkSession.createDataFrame([(i, -1, t) for i, t in enumerate(HEADINGS.values())], "section int, rank int, line string")
    return lines.unionByName(members).unionByName(heads)
