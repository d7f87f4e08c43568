"""Readers. Their triples are ``head, relation, tail, pos``, as all operators take them.

``pos`` numbers the rows from 0 in file order: files by path, then blocks by their start, then rows. It comes from range
partitions by these, so no task sees all rows, and the numbered rows are written once to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from triplane.functions import terms as T
from triplane.operators.ordinal import dense_numbers
from triplane.shared import materialise

SPLITS = ("train", "valid", "test")


def _with_place(df: DataFrame) -> DataFrame:
    """``place``: sorts as the rows of the file do."""
    return df.withColumn("place", F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id().alias("row")))


_PLACE = {"place_file": "place.file_path", "place_start": "place.file_block_start", "place_row": "place.row"}


def _flat(df: DataFrame) -> DataFrame:
    """``place`` laid out in columns, written once: row ids hold only for the reading that gave them."""
    return materialise(df.withColumns({k: F.col(v) for k, v in _PLACE.items()}).drop("place"))


def _counted_blocks(flat: DataFrame, *sums: Column) -> DataFrame:
    """One row per block with these sums."""
    return flat.groupBy("place_file", "place_start").agg(*sums)


def _numbered(df: DataFrame) -> DataFrame:
    """``pos`` in place of ``place``: the rows of all earlier blocks, and the number within the block. Blocks are one row each.

    A task gives the rows of its block ids that follow one another, so where none is left out the id tells the number, and rows
    stay where they are; only those of other blocks are sorted by block.
    """
    flat = df if "place" not in df.columns else _flat(df)
    blocks = _counted_blocks(flat, F.count("*").alias("rows"), F.min("place_row").alias("first"), F.max("place_row").alias("last"))
    earlier = F.sum("rows").over(Window.orderBy("place_file", "place_start")) - F.col("rows")
    blocks = materialise(blocks.select("place_file", "place_start", earlier.alias("earlier"), "first", (F.col("last") - F.col("first") + 1 == F.col("rows")).alias("unbroken")))
    met = flat.join(F.broadcast(blocks), ["place_file", "place_start"])
    sorted_ = F.row_number().over(Window.partitionBy("place_file", "place_start").orderBy("place_row")) - 1
    parts = [met.where("unbroken").withColumn("within", F.col("place_row") - F.col("first")), met.where("NOT unbroken").withColumn("within", sorted_.cast("long"))]
    return parts[0].unionByName(parts[1]).withColumn("pos", F.col("earlier") + F.col("within")).drop(*_PLACE, "earlier", "first", "unbroken", "within")


def quoted_records(spark: SparkSession, path: str) -> DataFrame:
    """``(record, place_file, place_start, place_row)`` of CSV files whose quoted cells may hold line breaks, read in blocks.

    Spark cuts the files at line ends, wherever these are. A line begins within quotes if all lines before it in its file have an odd
    number of quotes: the numbers of each block are summed, then those of the blocks of a file (a doubled quote counts twice,
    and changes nothing). Lines that begin outside and have an even number are records; only those of longer records are
    shuffled, to the place of their first line, which may lie in an earlier block. Quotes stand around cells or are doubled
    within quoted ones, as writers of CSV put them. An odd number in a file leaves one record open, and raises.
    """
    text = spark.read.text(path, lineSep="\n").select("value", "_metadata")
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    lines = _flat(_with_place(text).drop("_metadata").withColumn("quotes", quotes))
    block, file = Window.partitionBy("place_file", "place_start").orderBy("place_row"), Window.partitionBy("place_file").orderBy("place_start")
    before = block.rowsBetween(Window.unboundedPreceding, -1)
    blocks = _counted_blocks(lines, F.sum("quotes").alias("own"))
    opened = (F.pmod(F.sum("own").over(file) - F.col("own"), F.lit(2)) == 1).alias("opened")
    opened = F.broadcast(materialise(blocks.select("place_file", "place_start", opened, "own")))  # one row per block
    met = lines.join(opened, ["place_file", "place_start"])
    # outside of quotes from the start, and none in the block: each line is a record
    plain = ~F.col("opened") & (F.col("own") == 0)
    inside = F.pmod(F.coalesce(F.sum("quotes").over(before), F.lit(0)) + F.col("opened").cast("int"), F.lit(2)) == 1
    known = materialise(met.where(~plain).withColumn("inside", inside))
    odd = F.pmod("quotes", F.lit(2)) == 1
    record = lambda df: df.select(F.col("value").alias("record"), *_PLACE)
    single = record(met.where(plain)).unionByName(record(known.where(~F.col("inside") & ~odd)))
    # the first line of a longer record, in this block or the last one before that has any
    first = F.when(~F.col("inside") & odd, F.struct("place_start", "place_row"))
    last = _counted_blocks(known.withColumn("first", first), F.max("first").alias("last"))
    carried = last.select("place_file", "place_start", F.max("last").over(file.rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    pieces = known.where(F.col("inside") | odd).join(carried, ["place_file", "place_start"]).withColumn("first", first)
    pieces = pieces.withColumn("of", F.coalesce(F.max("first").over(block.rowsBetween(Window.unboundedPreceding, 0)), F.col("carried")))
    joined = pieces.groupBy("place_file", "of").agg(F.array_sort(F.collect_list(F.struct("place_start", "place_row", "value", "quotes"))).alias("lines"))
    even = F.pmod(F.aggregate("lines", F.lit(0), lambda n, x: n + x["quotes"]), F.lit(2)) == 0
    whole = F.when(even, F.array_join(F.transform("lines", lambda x: x["value"]), "\n")).otherwise(F.raise_error(F.concat(F.lit("a quote stays open in "), F.col("place_file"))))
    return single.unionByName(joined.select(whole.alias("record"), "place_file", F.col("of.place_start").alias("place_start"), F.col("of.place_row").alias("place_row")))


def _need(df: DataFrame, columns: set[str], what: str) -> None:
    if set(df.columns) != columns:
        raise ValueError(f"{what}: expected columns {sorted(columns)}, got {df.columns}")


def read_statements_csv(spark: SparkSession, path: str, whole: bool = False) -> DataFrame:
    """``(sub, pred, obj, pos)`` of a CSV whose header is those names in any order; empty cells are empty strings.

    Quoted cells may hold line breaks; a file of any size is read in blocks by many tasks (:func:`quoted_records`). ``whole``
    leaves this to Spark's own reader, for which each file is one task.
    """
    names = ("sub", "pred", "obj")
    header = spark.read.csv(path, header=True, escape='"')
    columns = [c.strip("\ufeff\r") for c in header.columns]
    if set(columns) != set(names):
        raise ValueError(f"{path}: expected columns {sorted(names)}, got {columns}")
    if whole:
        raw = spark.read.csv(path, header=True, multiLine=True, escape='"')
        return _numbered(_with_place(raw.select(*[F.coalesce(c, F.lit("")).alias(c) for c in names], "_metadata")).drop("_metadata"))
    records = quoted_records(spark, path)
    first = records.groupBy("place_file").agg(F.min(F.struct("place_start", "place_row")).alias("top"))
    body = records.join(F.broadcast(first), "place_file").where(F.struct("place_start", "place_row") != F.col("top")).where(F.rtrim("record") != "")
    cells = F.from_csv(F.regexp_replace("record", "\r$", ""), ", ".join(f"`{c}` string" for c in columns), {"escape": '"'})
    rows = body.select(cells.alias("cells"), *_PLACE).select(*[F.coalesce(F.col("cells")[c], F.lit("")).alias(c) for c in names], *_PLACE)
    return _numbered(rows)


def read_triples_csv(spark: SparkSession, path: str, whole: bool = False) -> DataFrame:
    """``(head, relation, tail, pos)`` of the same kind of file."""
    names = {"sub": "head", "pred": "relation", "obj": "tail"}
    return read_statements_csv(spark, path, whole).withColumnsRenamed(names)


def split_fields(lines: DataFrame, strict: bool = True) -> DataFrame:
    """Tab-separated ``value`` as head, relation, tail. Blank lines go; others must have three fields.

    strict: a wrong line raises; else it stays with ``bad`` set, for a quarantine.
    """
    parts = F.split("value", "\t", -1)
    rows = lines.where(T.strip(F.col("value")) != "").withColumn("parts", parts)
    bad = F.size("parts") != 3
    if strict:
        line = F.concat(F.lit("line "), F.col("pos") + 1, F.lit(": ")) if "pos" in rows.columns else F.lit("")
        rows = rows.withColumn("parts", F.when(bad, F.raise_error(F.concat(line, F.lit("not three fields: "), F.col("value")))).otherwise(F.col("parts")))
    rows = rows.withColumn("bad", bad)
    return rows.select(*[F.get("parts", F.lit(i)).alias(c) for i, c in enumerate(("head", "relation", "tail"))], *[c for c in rows.columns if c not in ("value", "parts")])


def read_triples_tsv(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """``(head, relation, tail, pos)``; ``pos`` counts lines, blank ones too, so an error can name its line."""
    lines = _numbered(_with_place(spark.read.text(path).select("value", "_metadata")).drop("_metadata"))
    out = split_fields(lines, strict)
    return out.drop("bad") if strict else out


def read_splits(spark: SparkSession, folder: str, names: tuple[str, ...] = SPLITS) -> DataFrame:
    """``(head, relation, tail, pos, split, split_rank)`` of one TSV file per split; all of train come before all of valid.

    Without blank lines, which have a number of their own in their file, rows stay where they are: a split's numbers follow those
    of the splits before it.
    """
    parts = union_splits({n: read_triples_tsv(spark, f"{folder}/{n}.tsv") for n in names}).withColumnRenamed("pos", "own")
    sizes = {r["split_rank"]: r for r in parts.groupBy("split_rank").agg(F.count("*").alias("rows"), F.max("own").alias("last")).collect()}  # one row per split
    if any(r["last"] + 1 != r["rows"] for r in sizes.values()):
        return dense_numbers(parts, ["split_rank", "own"], "pos").drop("own")
    before = [sum(sizes[j]["rows"] for j in range(i) if j in sizes) for i in range(len(names))]
    return parts.withColumn("pos", F.col("own") + F.element_at(F.array(*[F.lit(n).cast("long") for n in before]), F.col("split_rank") + 1)).drop("own")


def union_splits(parts: dict[str, DataFrame]) -> DataFrame:
    """All splits with ``split`` and ``split_rank``, in the order given."""
    tagged = [df.withColumns({"split": F.lit(name), "split_rank": F.lit(i)}) for i, (name, df) in enumerate(parts.items())]
    out = tagged[0]
    for df in tagged[1:]:
        out = out.unionByName(df)
    return out


_URI, _BLANK = "<([^>]*)>", "_:([^\\s]+)"
_LITERAL = '"([^"\\\\]*+(?:\\\\.[^"\\\\]*+)*+)"(?:@([A-Za-z0-9-]+)|\\^\\^<([^>]*)>)?'
_LINE = f"^\\s*(?:{_URI}|{_BLANK})\\s+{_URI}\\s+(?:{_URI}|{_BLANK}|{_LITERAL})\\s*\\.\\s*$"


# The escapes of N-Triples.
_ESCAPES = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f", '"': '"', "'": "'", "\\": "\\"}


def _unescape(value: Column) -> Column:
    """All escapes in one pass, so that an escaped backslash begins none."""

    def plain(x: Column) -> Column:
        code = F.decode(F.unhex(F.lpad(F.substring(x, 3, 8), 8, "0")), "UTF-32")
        out = F.when(x.rlike("^\\\\[uU]"), code)
        for c, to in _ESCAPES.items():
            out = out.when(x == "\\" + c, to)
        return out.otherwise(x)

    pieces = F.regexp_extract_all(value, F.lit("(?s)\\\\u[0-9A-Fa-f]{4}|\\\\U[0-9A-Fa-f]{8}|\\\\.|[^\\\\]++"), 0)
    return F.when(F.contains(value, F.lit("\\")), F.array_join(F.transform(pieces, plain), "")).otherwise(value)


def parse_ntriples(lines: DataFrame, dedupe: bool = True) -> DataFrame:
    """``subj, pred, obj`` as structs of kind, lexical, lang and datatype, from ``line``; ``pos`` is kept.

    Blank lines and comments go, any other line must parse. RDF is a set: of equal triples the first stays.
    """
    rows = lines.where(~F.col("line").rlike("^\\s*(#.*)?$"))
    part = lambda i: F.regexp_extract("line", _LINE, i)
    term = lambda kind, lexical, lang="", datatype="": F.struct(F.lit(kind).alias("kind"), lexical.alias("lexical"), (part(lang) if lang else F.lit("")).alias("lang"), (part(datatype) if datatype else F.lit("")).alias("datatype"))
    good = F.when(F.col("line").rlike(_LINE), F.col("line")).otherwise(F.raise_error(F.concat(F.lit("not a triple: "), F.col("line"))))
    rows = rows.withColumn("line", good)
    subject = F.when(part(2) != "", term("BlankNode", part(2))).otherwise(term("URI", part(1)))
    quoted = F.col("line").rlike('"(?:@[A-Za-z0-9-]+|\\^\\^<[^>]*>)?\\s*\\.\\s*$')
    obj = F.when(quoted, term("Literal", _unescape(part(6)), 7, 8)).when(part(5) != "", term("BlankNode", part(5))).otherwise(term("URI", part(4)))
    out = rows.select("pos", subject.alias("subj"), term("URI", part(3)).alias("pred"), obj.alias("obj"))
    if dedupe:
        out = out.groupBy("subj", "pred", "obj").agg(F.min("pos").alias("pos"))
    return out


def read_ntriples(spark: SparkSession, path: str, dedupe: bool = True) -> DataFrame:
    """``(subj, pred, obj, pos)``: see :func:`parse_ntriples`; ``pos`` counts lines."""
    lines = _with_place(spark.read.text(path).select(F.col("value").alias("line"), "_metadata")).drop("_metadata")
    return parse_ntriples(_numbered(lines), dedupe)


def rdf_triples(rdf: DataFrame) -> DataFrame:
    """``(head, relation, tail, pos)``: parsed terms as strings."""
    text = lambda c: T.term_to_string(*[F.col(f"{c}.{x}") for x in ("kind", "lexical", "lang", "datatype")])
    return rdf.select(text("subj").alias("head"), text("pred").alias("relation"), text("obj").alias("tail"), "pos")


def read_indexed(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    raw = spark.read.csv(path, header=True) if fmt == "csv" else spark.read.format(fmt).load(path)
    names = ("head_id", "relation_id", "tail_id")
    _need(raw, set(names), path)
    return raw.select(*[F.col(c).cast("long") for c in names])


def read_dictionary(spark: SparkSession, path: str, key: str = "relation", fmt: str = "csv") -> DataFrame:
    raw = spark.read.csv(path, header=True, multiLine=True, escape='"') if fmt == "csv" else spark.read.format(fmt).load(path)
    _need(raw, {key, "id"}, path)
    return raw.select(F.coalesce(key, F.lit("")).alias(key), F.col("id").cast("long"))


def clean_sequences(raw: DataFrame, order: str) -> DataFrame:
    """Keys without quotes and white space, upper-case chains; the last row of a key wins."""
    names = [c.lstrip("﻿") for c in raw.columns]
    raw = raw.toDF(*names)
    key = T.strip(F.regexp_replace(T.strip(F.coalesce("inn_number", F.lit(""))), '^"+|"+$', ""))
    chains = {c: T.clean_sequence(F.col(f"{c}_chain_sequence")) for c in ("heavy", "light")}
    rows = raw.select(key.alias("inn_number"), *[v.alias(k) for k, v in chains.items()], F.col(order).alias("place"))
    last = rows.groupBy("inn_number").agg(F.max_by(F.struct("heavy", "light"), "place").alias("last"))
    return last.select("inn_number", "last.heavy", "last.light")


def read_sequences(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.csv(path, header=True, multiLine=True, escape='"')
    _need(raw.toDF(*[c.lstrip("﻿") for c in raw.columns]), {"inn_number", "heavy_chain_sequence", "light_chain_sequence"}, path)
    return clean_sequences(_numbered(_with_place(raw.select(*raw.columns, "_metadata")).drop("_metadata")), "pos")


def check_vectors(vectors: DataFrame, rows: int, dim: int | None = None) -> DataFrame:
    """One row: count, distinct ids, least and most sizes, and whether the table fits ``rows`` (and ``dim``)."""
    size = F.size("vec")
    out = vectors.agg(F.count("*").alias("n_rows"), F.count_distinct("id").alias("n_ids"), F.min(size).alias("least_dim"), F.max(size).alias("most_dim"))
    good = (F.col("n_rows") == rows) & (F.col("n_ids") == rows) & (F.col("least_dim") == F.col("most_dim"))
    return out.withColumn("fits", good & (F.col("most_dim") == dim) if dim is not None else good)


def read_vectors(spark: SparkSession, path: str, rows: int, dim: int | None = None) -> DataFrame:
    vectors = spark.read.parquet(path).select("id", F.col("vec").cast("array<float>"))
    if not check_vectors(vectors, rows, dim).first()["fits"]:
        raise ValueError(f"{path}: not {rows} vectors of one dimension" + (f", {dim}" if dim else ""))
    return vectors
