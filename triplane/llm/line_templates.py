"""Line dedup by a tree of log templates, in DataFrame functions only.

A line is cut at white space into tokens. Tokens with a digit are variable fields and become ``<*>``: that gives the
line's form. The tree has a fixed depth: a leaf is the number of tokens and the first :data:`LEADING` tokens of the form.

Forms of one leaf may share a template. A token behind the leading ones is constant if at least half of the leaf's
documents have it at that place; all others become ``<*>``. This template holds if at least half of the tokens behind the
leading ones are constant and at least half of all its tokens are words; else the form itself is the line's template.

A template with a ``<*>`` recurs if it stands in :data:`MIN_DOCS` documents or more and at least half of its tokens are
words. A line without any field recurs if it stands, up to white space, in :data:`EXACT_DOCS` documents or more, however
short it is. A document counts once for a template, leaf or token, in whatever number of lines or forms it has it.

The first line of each recurring template, that of the smallest doc_id and position, stays; all others are dropped. Blank
lines stay.

Lines travel as hashes of 64 bits; only the forms of leaves that can hold a template are fetched as text, once each. All
counts are sums that combine before the shuffle. The lines of a document in one leaf count as one set of forms, and equal
sets are one row with their number, so that a crowded leaf is as many rows as it has different sets.

A null text stays null and has no lines; an empty one has one blank line. Every row is a document: rows that repeat a
doc_id count by themselves, and those that repeat the text as well keep or lose the same lines. Rows without a doc_id are
documents too, the last in order. An empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triplane.shared import fresh, materialise

LEADING = 3
MIN_DOCS = 10
EXACT_DOCS = 3
WILD = "<*>"
#: Leaves are looked up by so many hash values at most before the exact join: the bound of the only broadcast here.
SLOTS = 1 << 20


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def forms_of(text: Column) -> Column:
    """Of each line, the tokens joined by one space, those with a digit as ``<*>``.

    Most lines need neither replacement. Each step binds its line, so nothing is computed twice.
    """
    spaced = F.transform(lines_of(text), lambda x: F.trim(F.when(x.rlike("[\\t\\r\\f\\x0B]|  "), F.regexp_replace(x, "[ \\t\\r\\f\\x0B]+", " ")).otherwise(x)))
    return F.transform(spaced, lambda x: F.when(x.rlike("[0-9]"), F.regexp_replace(x, "[^ ]*[0-9][^ ]*", WILD)).otherwise(x))


def times(of_form: Column, part: str) -> Column:
    """How often ``part`` stands in the form."""
    return ((F.length(of_form) - F.length(F.replace(of_form, F.lit(part), F.lit("")))) / len(part)).cast("int")


def n_tokens(of_form: Column) -> Column:
    return times(of_form, " ") + 1


def leaf(of_form: Column) -> Column:
    """The tree's path: token count and leading tokens."""
    return F.xxhash64(n_tokens(of_form), F.substring_index(of_form, " ", LEADING))


def _lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, hash, row, at, leaf, form, n, wilds)`` of all lines that aren't blank; hash: of the text, form: a hash too."""
    rows = docs.select(F.col(key).alias("key"), F.xxhash64(text).alias("hash"), F.monotonically_increasing_id().alias("row"), F.col(text).alias("text"))
    each = rows.select("key", "hash", "row", F.posexplode(forms_of(F.col("text"))).alias("at", "form")).where("form != ''")
    return each.select("key", "hash", "row", "at", leaf(F.col("form")).alias("leaf"), F.xxhash64("form").alias("form"), n_tokens(F.col("form")).alias("n"), times(F.col("form"), WILD).alias("wilds"))


def _forms(docs: DataFrame, text: str, leaves: DataFrame) -> DataFrame:
    """``(leaf, form, tokens)`` of each form of the ``leaves``."""
    slot = lambda x: F.pmod(x, F.lit(SLOTS))
    slots = leaves.select(slot(F.col("leaf")).alias("slot")).distinct()
    text_forms = docs.select(F.explode(F.array_distinct(forms_of(F.col(text)))).alias("words")).where("words != ''").withColumn("leaf", leaf(F.col("words")))
    # a slot is one of SLOTS numbers, however many leaves there are
    near = text_forms.join(F.broadcast(slots), slot(F.col("leaf")) == F.col("slot"), "left_semi")
    # written first: Spark deals a crowded side of a join anew only where no sum shares its stage
    distinct = materialise(near.groupBy("leaf", F.xxhash64("words").alias("form")).agg(F.first("words").alias("words")))
    return distinct.join(leaves.hint("merge"), "leaf", "left_semi").select("leaf", "form", F.split("words", " ").alias("tokens"))


def _general(forms: DataFrame, sets: DataFrame) -> DataFrame:
    """``(form, template)``: hashes of the forms whose template holds, recurs, and differs from some form of its leaf.

    ``sets``: ``(leaf, set, docs)``, the forms that a document has in a leaf, and how many documents have those.
    """
    sets = sets.withColumn("id", F.xxhash64("set"))
    leaf_docs = materialise(sets.groupBy("leaf").agg(F.sum("docs").alias("leaf_docs")))
    members = materialise(sets.select("leaf", "id", "docs", F.explode("set").alias("form")))
    tokens = materialise(forms.select("leaf", "form", F.posexplode("tokens").alias("at", "token")).where(F.col("at") >= LEADING))
    seen = members.join(tokens, ["leaf", "form"]).groupBy("leaf", "at", "token", "id").agg(F.first("docs").alias("docs"))
    seen = seen.groupBy("leaf", "at", "token").agg(F.sum("docs").alias("seen")).join(leaf_docs.hint("merge"), "leaf").where((F.col("seen") * 2 >= F.col("leaf_docs")) & (F.col("token") != WILD))
    shown = tokens.join(seen.select("leaf", "at", "token"), ["leaf", "at", "token"]).groupBy("leaf", "form").agg(F.collect_set(F.struct("at", "token")).alias("constant"))
    n, lead = F.size("tokens"), F.slice("tokens", 1, LEADING)
    words = F.size("constant") + F.size(F.filter(lead, lambda x: x != WILD))
    held = forms.join(shown, ["leaf", "form"]).where((F.size("constant") * 2 >= n - LEADING) & (words * 2 >= n))
    template = F.xxhash64("leaf", F.array_sort("constant")).alias("template")
    named = materialise(held.select("leaf", "form", template, (words < n).alias("field")))
    counted = members.join(named, ["leaf", "form"]).groupBy("template", "leaf", "id").agg(F.first("docs").alias("docs"), F.first("field").alias("field"))
    counted = counted.groupBy("template").agg(F.sum("docs").alias("docs"), F.first("field").alias("field"))
    recurs = counted.where(F.col("docs") >= F.when(F.col("field"), MIN_DOCS).otherwise(EXACT_DOCS)).select("template")
    return named.join(recurs, "template").select("form", "template")


def dropped(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, hash, drop)``: positions of the lines that go, for documents that lose any."""
    lines = materialise(_lines(docs, key, text))
    counted = materialise(lines.groupBy("leaf", "form", "n", "wilds").agg(F.count_distinct("row").alias("docs")))
    alone = counted.where(F.when(F.col("wilds") > 0, (F.col("docs") >= MIN_DOCS) & ((F.col("n") - F.col("wilds")) * 2 >= F.col("n"))).otherwise(F.col("docs") >= EXACT_DOCS))
    # a leaf's documents are at most the sum over its forms; with one form there is nothing to generalise
    crowded = counted.where(F.col("n") > LEADING).groupBy("leaf").agg(F.sum("docs").alias("docs"), F.count("*").alias("forms")).where((F.col("docs") >= MIN_DOCS) & (F.col("forms") > 1))
    crowded = materialise(crowded.select("leaf"))
    inside = materialise(lines.join(crowded.hint("merge"), "leaf", "left_semi").select("leaf", "row", "form"))
    sets = inside.groupBy("leaf", "row").agg(F.array_sort(F.collect_set("form")).alias("set")).groupBy("leaf", "set").agg(F.count("*").alias("docs"))
    general = _general(materialise(_forms(docs, text, crowded)), materialise(sets))
    known = alone.select("form", F.col("form").alias("own")).join(general, "form", "full").select("form", F.coalesce("template", "own").alias("template"))
    # as many rows as recurring forms: never small enough to broadcast for long
    hits = materialise(lines.join(materialise(known).hint("merge"), "form").select("key", "hash", "at", "template"))
    place = F.struct(F.col("key").isNull().alias("last"), "key", "at", "hash")
    first = materialise(hits.groupBy("template").agg(F.min(place).alias("first")))
    gone = hits.join(first.hint("merge"), "template").where(place != F.col("first"))
    return gone.groupBy("key", "hash").agg(F.collect_set("at").alias("drop"))


def without_recurring(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the lines of recurring templates; all rows and columns stay."""
    k, h, d = (fresh(docs, f"line_{c}") for c in ("key", "hash", "drop"))
    gone = materialise(dropped(docs, key, text).select(F.col("key").alias(k), F.col("hash").alias(h), F.col("drop").alias(d)))
    # as many rows as documents: never small enough to broadcast for long
    both = docs.join(gone.hint("merge"), F.col(key).eqNullSafe(F.col(k)) & (F.xxhash64(text) == F.col(h)), "left")
    # the lines are bound to a variable: cut once, and each read once
    rest = F.transform(F.array(lines_of(F.col(text))), lambda own: F.transform(F.array_except(F.sequence(F.lit(0), F.size(own) - 1), F.col(d)), lambda at: F.get(own, at)))
    clean = F.when(F.col(d).isNull(), F.col(text)).otherwise(F.array_join(F.get(rest, 0), "\n"))
    return both.withColumn(text, clean).select(*docs.columns)


def digest(docs: DataFrame) -> DataFrame:
    """One row per document: its lines, those that stay, and MD5 of the text they make."""
    before = docs.select("doc_id", "text", F.coalesce(F.size(lines_of(F.col("text"))), F.lit(0)).alias("n"))
    before = before.withColumn("n_lines", F.when(F.col("text").isNull(), 0).otherwise(F.col("n")).cast("long"))
    after = without_recurring(before)
    return after.select("doc_id", "n_lines", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("text_md5"))


#: For DuckDB; returns what :func:`digest` does, doc_id being unique.
SQL = f"""
WITH docs AS (
  SELECT row_number() OVER () AS doc, doc_id, text FROM documents
), lines AS (
  SELECT doc, doc_id, i - 1 AS pos, trim(regexp_replace(l[i], '[ \\t\\r\\f\\x0B]+', ' ', 'g'), ' ') AS line
  FROM (SELECT doc, doc_id, string_split(text, chr(10)) AS l FROM docs WHERE text IS NOT NULL), unnest(range(1, len(l) + 1)) AS u(i)
), forms AS (
  SELECT doc, doc_id, pos, regexp_replace(line, '[^ ]*[0-9][^ ]*', '{WILD}', 'g') AS form FROM lines WHERE line <> ''
), leafed AS (
  SELECT *, string_split(form, ' ') AS tokens, len(string_split(form, ' ')) AS n, (length(form) - length(replace(form, '{WILD}', ''))) // {len(WILD)} AS wilds FROM forms
), alone AS (
  SELECT form FROM leafed GROUP BY form, n, wilds
  HAVING CASE WHEN wilds > 0 THEN count(DISTINCT doc) >= {MIN_DOCS} AND (n - wilds) * 2 >= n ELSE count(DISTINCT doc) >= {EXACT_DOCS} END
), placed AS (
  SELECT doc, form, tokens, n, list_slice(tokens, 1, {LEADING}) AS lead FROM leafed WHERE n > {LEADING}
), leaves AS (
  SELECT n, lead, count(DISTINCT doc) AS leaf_docs FROM placed GROUP BY ALL HAVING count(DISTINCT doc) >= {MIN_DOCS} AND count(DISTINCT form) > 1
), inner_lines AS (
  SELECT DISTINCT p.n, p.lead, doc, form, tokens, leaf_docs FROM placed p JOIN leaves l ON p.n = l.n AND p.lead = l.lead
), constant AS (
  SELECT n, lead, p, tokens[p] AS token FROM inner_lines, unnest(range({LEADING + 1}, n + 1)) AS u(p)
  WHERE tokens[p] <> '{WILD}' GROUP BY ALL HAVING count(DISTINCT doc) * 2 >= any_value(leaf_docs)
), shown AS (
  SELECT f.n, f.lead, form, count(c.p) AS constants,
    string_agg(CASE WHEN c.p IS NULL THEN '{WILD}' ELSE f.token END, ' ' ORDER BY f.p) AS tail
  FROM (SELECT DISTINCT n, lead, form, p, tokens[p] AS token FROM inner_lines, unnest(range({LEADING + 1}, n + 1)) AS u(p)) f
  LEFT JOIN constant c ON f.n = c.n AND f.lead = c.lead AND f.p = c.p AND f.token = c.token
  GROUP BY f.n, f.lead, form
), held AS (
  SELECT form, n, constants + len(list_filter(lead, lambda x: x <> '{WILD}')) AS words, array_to_string(lead, ' ') || ' ' || tail AS template FROM shown
  WHERE constants * 2 >= n - {LEADING} AND (constants + len(list_filter(lead, lambda x: x <> '{WILD}'))) * 2 >= n
), recurs AS (
  SELECT template FROM held h JOIN inner_lines l USING (form) GROUP BY template
  HAVING count(DISTINCT doc) >= CASE WHEN any_value(h.words < h.n) THEN {MIN_DOCS} ELSE {EXACT_DOCS} END
), general AS (
  SELECT form, template FROM held JOIN recurs USING (template)
), known AS (
  SELECT form, coalesce(template, form) AS template FROM alone FULL JOIN general USING (form)
), hits AS (
  SELECT doc, doc_id, pos, template FROM forms JOIN known USING (form)
), gone AS (
  SELECT doc, pos FROM (SELECT *, row_number() OVER (PARTITION BY template ORDER BY doc_id NULLS LAST, pos, doc) AS k FROM hits) WHERE k > 1
), lost AS (
  SELECT doc, list(pos) AS drop FROM gone GROUP BY doc
), after AS (
  SELECT doc_id, coalesce(len(l), 0)::BIGINT AS n_lines, CASE WHEN drop IS NULL THEN text ELSE array_to_string(list_filter(l, lambda x, i: NOT list_contains(drop, i - 1)), chr(10)) END AS text
  FROM (SELECT doc, doc_id, text, string_split(text, chr(10)) AS l FROM docs) LEFT JOIN lost USING (doc)
)
SELECT doc_id, n_lines, length(text)::BIGINT AS n_chars, md5(text) AS text_md5 FROM after
"""
