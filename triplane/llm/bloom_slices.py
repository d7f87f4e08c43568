"""Ranked lexical search over bit-sliced Bloom signatures.

**Index.** A document sets a few bits of its signature for each of its terms, and again for each level of :data:`LEVELS` that
the term's occurrences reach. Signatures have a width by the number of these keys, and up to so many documents of one width
make a block, which holds them turned: one bitmap over the documents for each bit (a slice). Blocks are made within
tasks, without a shuffle. A block also holds each document's id, number of terms and hash of its text.

**Bounds.** The slices of a term's bits, anded, are a bitmap of documents that may have the term: all that do and few
others. So a matrix product of the weights of an item's terms with their bitmaps, level by level, times what the next level
can add to a score at the document's length, is never below the document's score.

**Search.** The documents of the highest bounds are scored exactly, from their texts; the tenth best of these scores is a
limit that ten documents reach. All documents whose bound reaches it are then scored exactly too. The others are provably
not among the ten. Of copies of a text, those that follow ten others in the order of ids can't be, either. Document
frequencies and sums are exact, over all documents.

Items come in blocks of a bounded number of terms; the terms of a block, and only they, are sent to the tasks.

A null or empty text has no terms and is in no result. Rows that repeat an id are documents of their own, each
with a rank; a document without an id comes last among equal scores. Items that repeat both id and text are one; one id with
unlike texts gets a list for each; items without known terms have no rows. Empty tables give no rows. Texts of any length are
read whole; a bitmap's width grows with them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from triplane.shared import materialise

TERM = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TOP = 10
#: A term that occurs so often has one more key.
LEVELS = (1, 2, 3, 4, 6, 9, 17, 65)
#: Bits set for a key, and bits of a signature for each key at least; widths are powers of two.
HASHES, BITS = 4, 12
#: Documents of a block, and bits of its slices at most (8 documents in any case).
DOCUMENTS, BLOCK_BITS = 1024, 1 << 20
#: Terms of the items that are searched together.
TERMS = 20_000
#: Bytes of text that are cut into terms at once.
SLICE = 1 << 21
NO_ID = (1 << 63) - 1
#: Documents scored first, for each item.
FIRST = 30


def terms_of(text: Column) -> Column:
    """``array<string>``: the terms in order, repeats included; none of null."""
    return F.coalesce(F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(TERM), F.lit(0)), F.array().cast("array<string>"))


def _byte_classes() -> tuple[np.ndarray, np.ndarray]:
    """Which bytes of UTF-8 belong to terms (letters, digits, all beyond ASCII), and bytes in lower case."""
    byte = np.arange(256)
    upper, lower, digit = (byte >= 65) & (byte <= 90), (byte >= 97) & (byte <= 122), (byte >= 48) & (byte <= 57)
    return upper | lower | digit | (byte >= 128), np.where(upper, byte + 32, byte).astype(np.uint64)


IN_TERM, LOWERED = _byte_classes()


def mixed(h: np.ndarray) -> np.ndarray:
    """A full spread of the bits of 64-bit numbers (the finish of a common hash)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def hashed_terms(data: np.ndarray) -> np.ndarray:
    """A hash of each term of UTF-8 bytes, in order: a polynomial in its bytes, spread."""
    inside = np.concatenate([[False], IN_TERM[data], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    powers = np.full(int((ends - starts).max()), 0x9E3779B97F4A7C15, dtype=np.uint64)
    powers[0] = 1
    powers = np.multiply.accumulate(powers)
    data, starts = data[starts[0] :], starts - starts[0]
    place = np.arange(len(data)) - np.repeat(starts, np.diff(np.append(starts, len(data))))
    worth = np.where(IN_TERM[data], LOWERED[data] + np.uint64(1), np.uint64(0)) * powers[np.minimum(place, len(powers) - 1)]
    return mixed(np.add.reduceat(worth, starts))


def text_terms(text: bytes) -> np.ndarray:
    """Hashes of all terms of one text, in slices that end outside of terms."""
    data = np.frombuffer(text, dtype=np.uint8)
    out, at = [], 0
    while at < len(data):
        end = min(len(data), at + SLICE)
        while end < len(data) and IN_TERM[data[end]]:
            end += 1
        out.append(hashed_terms(data[at:end]))
        at = end
    return np.concatenate(out) if out else np.zeros(0, dtype=np.uint64)


def positions(terms: np.ndarray, level: int | np.ndarray, width: int) -> np.ndarray:
    """Bits of a key, by row: two halves of a hash, combined."""
    h = mixed(terms + np.asarray(level, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))
    step = (h >> np.uint64(32)) | np.uint64(1)
    return ((h[:, None] + np.arange(HASHES, dtype=np.uint64)[None] * step[:, None]) % np.uint64(width)).astype(np.int64)


class _Block:
    """Documents of one width that wait for enough others."""

    def __init__(self, width: int):
        self.width = width
        self.most = max(8, min(DOCUMENTS, BLOCK_BITS // width))
        self.clear()

    def clear(self) -> None:
        self.slices = np.zeros((self.width, self.most // 8), dtype=np.uint8)
        self.docs: list[tuple] = []

    def add(self, doc: tuple, terms: np.ndarray, levels: np.ndarray) -> bool:
        at = len(self.docs)
        self.slices[np.unique(positions(terms, levels, self.width)), at >> 3] |= np.uint8(1 << (at & 7))
        self.docs.append(doc)
        return len(self.docs) == self.most

    def row(self) -> dict:
        ids, first, second, sizes = zip(*self.docs, strict=True)
        used = -(-len(self.docs) // 8)
        return {"width": self.width, "ids": list(ids), "key1": list(first), "key2": list(second), "n": list(sizes), "slices": self.slices[:, :used].tobytes()}


INDEX = "width long, ids array<long>, key1 array<long>, key2 array<long>, n array<long>, slices binary"
KEYS = (F.xxhash64, lambda c: F.xxhash64(F.lit(7), c))


def index(docs: DataFrame) -> DataFrame:
    """Blocks of documents that have a term; see above. Ids that are missing are :data:`NO_ID`."""

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting: dict[int, _Block] = {}
        for pdf in batches:
            for of, key1, key2, text in zip(pdf["id"], pdf["key1"], pdf["key2"], pdf["text"], strict=True):
                hashes = text_terms(text.encode())
                if not len(hashes):
                    continue
                terms, count = np.unique(hashes, return_counts=True)
                reached = [np.flatnonzero(count >= level) for level in LEVELS]
                keys = np.concatenate([terms[own] for own in reached])
                levels = np.concatenate([np.full(len(own), level, dtype=np.uint64) for own, level in zip(reached, LEVELS, strict=True)])
                width = 1 << max(6, int(BITS * len(keys) - 1).bit_length())
                block = waiting.setdefault(width, _Block(width))
                if block.add((of, key1, key2, len(hashes)), keys, levels):
                    yield pd.DataFrame([block.row()])
                    block.clear()
        for block in waiting.values():
            if block.docs:
                yield pd.DataFrame([block.row()])

    known = docs.where("text IS NOT NULL").select(F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), *[k(F.col("text")).alias(f"key{i + 1}") for i, k in enumerate(KEYS)], "text")
    return known.mapInPandas(build, INDEX)


class Items:
    """Terms and weights of a block of items, as the tasks need them."""

    def __init__(self, rows: list, n: int, total: int, least: dict[int, int] | None = None):
        self.n, self.total = n, total
        names = sorted({row["term"] for row in rows})
        self.items = sorted({row["item"] for row in rows})
        self.hashes = np.array([text_terms(name.encode())[0] for name in names], dtype=np.uint64)
        at, of = {name: i for i, name in enumerate(names)}, {item: i for i, item in enumerate(self.items)}
        self.weights = np.zeros((len(self.items), len(names)))
        for row in rows:
            self.weights[of[row["item"]], at[row["term"]]] = row["w"]
        if self.weights.sum(axis=1).max() < 1 << 24:  # sums are exact in single precision
            self.weights = self.weights.astype(np.float32)
        self.bits: dict[tuple[int, int], np.ndarray] = {}
        self.least = np.array([max(1, (least or {}).get(item, 1)) for item in self.items])

    def worth(self, n: np.ndarray, tf: np.ndarray) -> np.ndarray:
        """What so many occurrences of a term of weight 1 add to a score in documents of so many terms."""
        m = 100 - 90 + (90 * n * self.n) // self.total
        return (1_000_000_000 * tf) // (1000 * tf + 8 * m)

    def bounds(self, block) -> np.ndarray:
        """[item, document]: never below the scores."""
        docs, width = len(block.ids), block.width
        slices = np.frombuffer(block.slices, dtype=np.uint8).reshape(width, -1)
        n = np.asarray(block.n, dtype=np.int64)
        out, before, live = np.zeros((len(self.items), docs)), np.zeros(docs, dtype=np.int64), np.arange(len(self.hashes))
        for level, after in zip(LEVELS, [*LEVELS[1:], None], strict=True):
            if (level, width) not in self.bits:
                self.bits[level, width] = positions(self.hashes, level, width)
            maps = np.bitwise_and.reduce(slices[self.bits[level, width][live]], axis=1)
            some = maps.any(axis=1)
            live, maps = live[some], maps[some]
            if not len(live):
                break
            present = np.unpackbits(maps, axis=1, count=docs, bitorder="little").astype(self.weights.dtype)
            worth = self.worth(n, np.minimum(n, after - 1) if after else n)
            out += (self.weights[:, live] @ present).astype(np.float64) * (worth - before)
            before = worth
        return out


def _rows(items: Items, item: np.ndarray, doc: np.ndarray, block, bound: np.ndarray) -> pd.DataFrame:
    found = pd.DataFrame({"item": np.array(items.items, dtype=np.int64)[item], "doc_id": np.asarray(block.ids)[doc], "key1": np.asarray(block.key1)[doc], "key2": np.asarray(block.key2)[doc], "bound": bound[item, doc].astype(np.int64)})
    # ten copies of a text that come before a document keep it out
    found = found.sort_values(["item", "key1", "key2", "doc_id"])
    return found[found.groupby(["item", "key1", "key2"]).cumcount() < TOP]


CANDIDATES = "item long, doc_id long, key1 long, key2 long, bound long"


def highest(blocks: DataFrame, items: Items, k: int = FIRST) -> DataFrame:
    """The ``k`` documents of the highest bounds for each item."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = None
        for pdf in batches:
            for block in pdf.itertuples():
                bound = items.bounds(block)
                few = min(k, bound.shape[1])
                at = np.argpartition(bound, -few, axis=1)[:, -few:]
                item = np.repeat(np.arange(len(bound)), few)
                positive = bound[item, at.ravel()] >= 1
                new = _rows(items, item[positive], at.ravel()[positive], block, bound)
                kept = new if kept is None else pd.concat([kept, new])
                kept = kept.sort_values(["bound", "doc_id"], ascending=[False, True]).groupby("item").head(k)
        if kept is not None:
            yield kept

    order = Window.partitionBy("item").orderBy(F.col("bound").desc(), "doc_id", "key1", "key2")
    found = blocks.mapInPandas(run, CANDIDATES)
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).drop("place")


def possible(blocks: DataFrame, items: Items) -> DataFrame:
    """All documents whose bound reaches the item's limit, ``items.least``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for block in pdf.itertuples():
                bound = items.bounds(block)
                item, doc = np.nonzero(bound >= items.least[:, None])
                if len(item):
                    yield _rows(items, item, doc, block, bound)

    return blocks.mapInPandas(run, CANDIDATES)


#: Distinct texts to score whose keys may be broadcast; more are joined by a shuffle.
BROADCAST = 1_000_000


def exact(candidates: DataFrame, docs: DataFrame, terms: DataFrame, n: int, total: int) -> DataFrame:
    """``candidates`` with ``score``, from the whole texts. ``terms``: item, term, w."""
    wanted = materialise(candidates.groupBy("key1", "key2").agg(F.min("doc_id").alias("of")))
    wanted_rows = F.broadcast(wanted) if wanted.count() <= BROADCAST else wanted.hint("merge")
    keyed = docs.where("text IS NOT NULL").select(F.coalesce("doc_id", F.lit(NO_ID)).alias("of"), *[k(F.col("text")).alias(f"key{i + 1}") for i, k in enumerate(KEYS)], "text")
    texts = keyed.join(wanted_rows, ["key1", "key2", "of"], "left_semi").dropDuplicates(["key1", "key2"])
    cut = texts.select("key1", "key2", terms_of(F.col("text")).alias("terms")).withColumn("n", F.size("terms").cast("long"))
    counted = cut.select("key1", "key2", "n", F.explode("terms").alias("term")).groupBy("key1", "key2", "n", "term").agg(F.count("*").alias("tf"))
    counted = materialise(counted.join(terms.select("term").distinct(), "term", "left_semi"))
    m = F.expr(f"10 + (90 * n * {n}L) div {total}L").alias("m")
    pairs = candidates.select("item", "key1", "key2").distinct()
    met = pairs.join(counted.select("key1", "key2", "term", "tf", m), ["key1", "key2"]).join(terms, ["item", "term"])
    scores = met.groupBy("item", "key1", "key2").agg(F.sum(F.expr("w * ((1000000000 * tf) div (1000 * tf + 8 * m))")).alias("score"))
    return candidates.join(scores, ["item", "key1", "key2"])


def _leading(scored: DataFrame) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), "doc_id")
    return scored.where("score > 0").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= TOP)


def search(docs: DataFrame, items: DataFrame, blocks: DataFrame | None = None) -> DataFrame:
    """Per item and rank: item_id, rank, doc_id, score. ``blocks``: an :func:`index` of ``docs``, if there is one."""
    spark, docs = docs.sparkSession, docs.select("doc_id", "text")
    asked = items.select("item_id", F.xxhash64("item_id", "text").alias("item"), F.explode(F.array_distinct(terms_of(F.col("text")))).alias("term")).distinct()
    asked = materialise(asked)
    blocks = materialise(index(docs)) if blocks is None else blocks
    n, total = blocks.agg(F.sum(F.size("ids")), F.sum(F.aggregate("n", F.lit(0).cast("long"), lambda s, x: s + x))).first()
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    if not n:
        return out
    each = docs.select(F.explode(F.array_distinct(terms_of(F.col("text")))).alias("term"))
    df = each.groupBy("term").agg(F.count("*").alias("df"))
    weight = F.floor(1000 * F.log((2 * F.lit(n) + 2) / (2 * F.col("df") + 1))).cast("long")
    known = asked.join(df, "term").select("item_id", "item", "term", weight.alias("w"))
    parts = max(1, -(-asked.count() // TERMS))
    known = materialise(known.withColumn("part", F.pmod(F.xxhash64(F.lit(3), "item"), F.lit(parts))))
    for part in range(parts):
        terms = known.where(F.col("part") == part).select("item", "term", "w")
        rows = terms.collect()  # TERMS of them, about
        if not rows:
            continue
        first = materialise(highest(blocks, Items(rows, n, total)))
        tenth = _leading(exact(first, docs, terms, n, total)).where(F.col("rank") == TOP)
        least = {row["item"]: row["score"] for row in tenth.select("item", "score").collect()}
        candidates = materialise(possible(blocks, Items(rows, n, total, least)))
        best = _leading(exact(candidates, docs, terms, n, total))
        out = out.unionByName(best.join(known.select("item", "item_id").distinct(), "item").select("item_id", "rank", F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).alias("doc_id"), "score"))
    return out


#: For DuckDB; returns what :func:`search` does for documents and benchmark.
SQL = f"""
WITH cut AS (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}') AS terms FROM documents WHERE text IS NOT NULL
), sums AS (
  SELECT count(*) FILTER (WHERE len(terms) > 0)::BIGINT AS n, sum(len(terms))::BIGINT AS total FROM cut
), counted AS (
  SELECT row, any_value(doc_id) AS doc_id, any_value(len(terms))::BIGINT AS size, term, count(*)::BIGINT AS tf
  FROM (SELECT row, doc_id, terms, unnest(terms) AS term FROM cut) GROUP BY row, term
), items AS (
  SELECT DISTINCT item_id, text FROM benchmark
), asked AS (
  SELECT DISTINCT item_id, text, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}')) AS term FROM items
), weighed AS (
  SELECT term, floor(1000::DOUBLE * ln((2 * (SELECT n FROM sums) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM counted GROUP BY term
), scored AS (
  SELECT item_id, text, row, any_value(doc_id) AS doc_id,
    sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * size * n) // total))))::BIGINT AS score
  FROM asked JOIN weighed USING (term) JOIN counted USING (term), sums GROUP BY item_id, text, row
), ranked AS (
  SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id NULLS LAST)::INT AS rank FROM scored WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= {TOP}
"""
