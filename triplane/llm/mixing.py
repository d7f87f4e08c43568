"""Mixing sources to target weights, by systematic sampling.

A source's target is its share by weight of the words to take; it stops at a multiple of the source's size, and what is
above is shared again by weight. All documents of a source have the same expected number of copies, target over size.
They stand in a line by size; the expected copies are summed along it, one random offset per source is added, and a
document is emitted once for each whole number that the sum crosses. So a document gets the whole number below or above
its expected copies, and neighbours of like size make up for each other, which keeps the words taken near the target.

The sums are exact, in 2**-24 of a copy. They come from a range partitioning by source and size, sums of each part, and
windows within the parts, so that one source with most of the documents is spread like any other. Reruns agree.

Sizes count words; a null text has none. A null source is a source of its own, the last. Sources are few: windows over one
row for each of them are small. Rows that repeat a doc_id, or have none, are mixed one by one. An empty table gives no rows; where no source has words, all targets are zero.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from triplane.shared import fresh, materialise

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_COPIES = 2
UNIT = 1 << 24
WORD = "[^\\x20\\x09-\\x0D]+"


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST_COPIES) -> DataFrame:
    """``(source, source_size, target)``. Sources are few: windows over them are small.

    In the order of limit over weight, a source is at its limit if its part of what those before it leave is above it.
    """
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = sources.withColumn("weight", weight.cast("double")).withColumn("limit", F.col("source_size") * F.lit(float(most)))
    ranked = ranked.withColumn("ratio", F.col("limit") / F.col("weight"))
    order = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    total = F.sum("source_size").over(everything) * F.lit(share)
    taken = F.sum("limit").over(order) - F.col("limit")
    left = F.sum("weight").over(everything) - F.sum("weight").over(order) + F.col("weight")
    ranked = ranked.withColumn("level", (total - taken) / left).withColumn("place", F.row_number().over(order))
    open_level = F.min_by(F.when(F.col("ratio") > F.col("level"), F.col("level")), F.when(F.col("ratio") > F.col("level"), F.col("place"))).over(everything)
    goal = F.least(F.col("limit"), F.coalesce(open_level * F.col("weight"), F.col("limit")))
    return ranked.select("source", "source_size", goal.alias("target"))


def _before(df: DataFrame, by: str, order: list[str], value: str) -> DataFrame:
    """``df`` with ``before``: the sum of ``value`` over the rows of the same ``by`` that come earlier in ``order``."""
    parts = materialise(df.repartitionByRange(F.col(by).asc_nulls_last(), *order).withColumn("part", F.spark_partition_id()))
    sums = parts.groupBy(by, "part").agg(F.sum(value).alias("part_sum"))
    so_far = F.sum("part_sum").over(Window.partitionBy(by).orderBy("part")) - F.col("part_sum")
    sums = sums.select(F.col(by).alias("of"), F.col("part").alias("in_part"), so_far.alias("earlier"))
    here = F.sum(value).over(Window.partitionBy(by, "part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)) - F.col(value)
    placed = parts.withColumn("here", here).join(sums, F.col(by).eqNullSafe(F.col("of")) & (F.col("part") == F.col("in_part")))
    return placed.withColumn("before", F.col("earlier") + F.col("here")).drop("of", "in_part", "part", "earlier", "here")


def plan(docs: DataFrame, seed: str = "mix", **kinds) -> DataFrame:
    """``(doc_id, source, hash, size, source_size, target, copies)`` of each document; hash: of its text; kinds: see :func:`targets`."""
    sized = materialise(docs.select("doc_id", "source", F.xxhash64("text").alias("hash"), size_of(F.col("text")).alias("size")))
    goal = materialise(targets(sized, **kinds))
    goal = goal.select(F.col("source").alias("of"), "source_size", "target")
    per_doc = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") * UNIT)).otherwise(0).cast("long")
    both = sized.join(goal, F.col("source").eqNullSafe(F.col("of"))).drop("of").withColumn("expected", per_doc)
    lined = _before(both, "source", ["size", "doc_id", "hash"], "expected")
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce("source", F.lit("")))), 1, 6), 16, 10).cast("long")
    crossed = F.floor((F.col("before") + F.col("expected") + draw) / UNIT) - F.floor((F.col("before") + draw) / UNIT)
    return lined.select("doc_id", "source", "hash", "size", "source_size", "target", crossed.cast("long").alias("copies"))


def mix(docs: DataFrame, **kinds) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken, with all columns as they are.

    Rows are told apart by id, source and text; those that repeat all three are taken in any order.
    """
    same_row = ["doc_id", "source", "hash"]
    lined = plan(docs, **kinds).select(*same_row, "copies")
    lined = materialise(lined.withColumn("nth", F.row_number().over(Window.partitionBy(*same_row).orderBy("copies"))))
    key, of, text, own, at, times, copy = (fresh(docs, f"mix_{c}") for c in ("key", "of", "text", "own", "at", "times", "copy"))
    names = [F.col(c).alias(n) for c, n in zip(same_row, (key, of, text), strict=True)]
    same = F.col("doc_id").eqNullSafe(F.col(key)) & F.col("source").eqNullSafe(F.col(of)) & (F.xxhash64("text") == F.col(text))
    again = lined.where("nth = 2").select(*names)
    numbered = docs.withColumn(own, F.lit(1))
    if again.limit(1).count():
        count = F.row_number().over(Window.partitionBy("doc_id", "source", F.xxhash64("text")).orderBy(F.lit(1)))
        once = docs.join(again, same, "left_anti").withColumn(own, F.lit(1))
        numbered = once.unionByName(docs.join(again, same, "left_semi").withColumn(own, count))
    taken = lined.where("copies > 0").select(*names, F.col("nth").alias(at), F.col("copies").alias(times))
    # as many rows as documents: never small enough to broadcast for long
    met = numbered.join(taken.hint("merge"), same & (F.col(own) == F.col(at)))
    every = met.withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), F.col(times))))
    return every.select(*docs.columns)


def digest(docs: DataFrame) -> DataFrame:
    """One row per document: its size, its source's size and target, and the words taken of it."""
    taken = (F.col("copies") * F.col("size")).alias("taken")
    return plan(docs).select("doc_id", "size", "source_size", "target", taken)


#: For DuckDB; returns what :func:`digest` does.
SQL = f"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT *, [{", ".join(map(str, WEIGHTS))}][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} + 1)]::DOUBLE AS weight,
    source_size * {MOST_COPIES}::DOUBLE AS lim FROM sources
), levels AS (
  SELECT *, lim / weight AS ratio,
    (sum(source_size) OVER ()::DOUBLE * {SHARE}::DOUBLE - (sum(lim) OVER o - lim)) / (sum(weight) OVER () - sum(weight) OVER o + weight) AS level,
    row_number() OVER o AS place
  FROM weighed WINDOW o AS (ORDER BY lim / weight, source NULLS LAST)
), goal AS (
  SELECT source, source_size, least(lim, coalesce((SELECT level FROM levels WHERE ratio > level ORDER BY place LIMIT 1) * weight, lim)) AS target FROM levels
), lined AS (
  SELECT doc_id, s.source, size, source_size, target,
    CASE WHEN source_size > 0 THEN floor(target / source_size * {UNIT})::BIGINT ELSE 0 END AS expected,
    row_number() OVER (PARTITION BY s.source ORDER BY size, doc_id NULLS FIRST) - 1 AS earlier,
    ('0x' || substr(md5('mix:' || coalesce(s.source, '')), 1, 6))::BIGINT AS draw
  FROM sized s JOIN goal g ON s.source IS NOT DISTINCT FROM g.source
)
SELECT doc_id, size, source_size, target,
  (((earlier + 1) * expected + draw) // {UNIT} - (earlier * expected + draw) // {UNIT})::BIGINT * size AS taken
FROM lined
"""
