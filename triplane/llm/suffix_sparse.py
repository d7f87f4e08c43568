"""Suffix-array dedup over sparse suffixes: passages of :data:`LENGTH` words or more that repeat across documents.

Suffixes are kept only where a position's :data:`GRAM`-word hash is the least of :data:`WINDOW` neighbouring ones. Such a
choice depends on nothing but the words themselves, and every passage of 50 words has one among its first 26, which
therefore goes on equally for 25 words at least in each copy. So:

1. each kept suffix gets the hash of its first 25 words, and hashes of one document alone go;
2. the suffixes that are left are told apart by their contexts, the 25 words before and 50 from them on; each distinct
   context stands for all its places, with the first and last document it is found in;
3. the contexts are dealt and sorted by that hash and, within it, by the words that follow. Neighbours in this order are
   compared word by word, which gives how far each goes on like the next; the same order of the words before them, read
   backwards, gives how far each goes back. Contexts that are alike for b words back and 50 - b words on, for any b from 0 to
   25, share a run of 50 words (:func:`matches`);
4. the words of runs that two documents have are marked at all places of the context; the marks of one document that
   overlap are one passage.

A hash with more than :data:`CROWD` contexts would make a range of its own that no further machine shortens. Its contexts
list their runs instead, which are sorted by hashes of their own, in one sum per run.

So each run meets every other one like it, however many there are and whatever stands around them. Words and hot runs are
compared by 64-bit hashes.

:func:`without_repeats` keeps a run in the first document that has it, and cuts its words from all others: the smallest doc_id
first, those without one last, by the hash of their text.

Words are runs without ASCII white space, and case counts. Documents are told apart by doc_id; rows that repeat one are one
document, but their texts have passages of their own. Each row without a doc_id is a document: it has partners and
passages like others, and its rows in the result have a null doc_id, one for each distinct text. Null texts have no words.
An empty table has no passages.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from triplane.shared import fresh, materialise

LENGTH = 50
GRAM, WINDOW = 10, 26
#: Words that a match goes on for from its first kept suffix: LENGTH - WINDOW + 1.
AHEAD = LENGTH - WINDOW + 1

_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int, known: dict[int, np.ndarray] = {}) -> np.ndarray:  # noqa: B006
    """1, base, base², ... modulo 2**64."""
    if len(known.get(base, ())) < n:
        step = np.full(max(n, 1 << 12), base, dtype=np.uint64)
        step[0] = 1
        known[base] = np.multiply.accumulate(step)
    return known[base][:n]


def word_hashes(text: str | None) -> np.ndarray:
    words = (text or "").encode("utf-8", "surrogatepass").split()
    return np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))


def _runs(h: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of so many words."""
    n = len(h)
    if n < width:
        return np.zeros(0, dtype=np.uint64)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * _powers(_BASE, n), dtype=np.uint64)])
    z = (sums[width:] - sums[:-width]) * _powers(_INVERSE, n - width + 1)
    z = (z ^ z >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return z ^ z >> np.uint64(32)


def chosen(h: np.ndarray) -> np.ndarray:
    """For each place, that of the least run of the window that begins there."""
    grams = _runs(h, GRAM)
    if len(grams) < WINDOW:
        return np.zeros(0, dtype=np.int64)
    out = []
    for at in range(0, len(grams) - WINDOW + 1, 1 << 16):
        windows = np.lib.stride_tricks.sliding_window_view(grams[at : at + (1 << 16) + WINDOW - 1], WINDOW)
        out.append(windows.argmin(axis=1) + np.arange(at, at + len(windows)))
    return np.concatenate(out)


def kept_suffixes(h: np.ndarray) -> np.ndarray:
    """Positions of the least run of each window."""
    return np.unique(chosen(h))


def anchors(text: Column) -> Column:
    """Kept suffixes: position in words, hash of the first :data:`AHEAD` words, hash of the context."""
    kind = pa.list_(pa.struct([("pos", pa.int32()), ("key", pa.int64()), ("context", pa.int64())]))

    @F.arrow_udf("array<struct<pos:int,key:bigint,context:bigint>>")
    def suffixes(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            places, hashes, around, ends = [], [], [], [0]
            for t in batch:
                h = word_hashes(t.as_py())
                key = _runs(h, AHEAD)
                pos = kept_suffixes(h)
                pos = pos[pos < len(key)]
                places.append(pos.astype(np.int32))
                hashes.append(key[pos].view(np.int64))
                whole = memoryview(h.view(np.uint8))
                cuts = ((max(0, at - WINDOW + 1), at) for at in pos.tolist())
                own = (xxhash.xxh64_intdigest(whole[8 * lo : 8 * (at + LENGTH)], at - lo) for lo, at in cuts)
                around.append(np.fromiter(own, dtype=np.uint64, count=len(pos)).view(np.int64))
                ends.append(ends[-1] + len(pos))
            columns = [np.concatenate([*x, np.zeros(0, d)]).astype(d) for x, d in ((places, np.int32), (hashes, np.int64), (around, np.int64))]
            rows = pa.StructArray.from_arrays([pa.array(x) for x in columns], fields=list(kind.value_type))
            yield pa.ListArray.from_arrays(pa.array(np.array(ends, dtype=np.int32)), rows)

    return suffixes(text)


def contexts_of(text: Column, places: Column) -> Column:
    """Words around each of the places: its index, how many stand before it, and the hashes of these and of what follows its first :data:`AHEAD` words, which its key stands for."""
    kind = pa.list_(pa.struct([("i", pa.int32()), ("back", pa.int32()), ("words", pa.list_(pa.int64()))]))

    @F.arrow_udf("array<struct<i:int,back:int,words:array<bigint>>>")
    def around(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, all_places in batches:
            out = []
            for t, p in zip(texts, all_places, strict=True):
                h = word_hashes(t.as_py()).view(np.int64)
                own = []
                for i, at in enumerate(p.values.to_pylist()):
                    first = max(0, at - WINDOW + 1)
                    own.append({"i": i, "back": at - first, "words": np.concatenate([h[first:at], h[at + AHEAD : at + LENGTH]])})
                out.append(own)
            yield pa.array(out, type=kind)

    return around(text, places)


def _neighbours(words: np.ndarray, key: np.ndarray, wide: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of rows of words within their keys, and how many first words each has in common with the one before it.

    ``wide``: how many words of a row there are; what lies beyond is like nothing.
    """
    order = np.lexsort((*words.T[::-1], key))
    same = words[order[1:]] == words[order[:-1]]
    same &= np.arange(words.shape[1]) < np.minimum(wide[order[1:]], wide[order[:-1]])[:, None]
    common = np.where(same.all(axis=1), words.shape[1], same.argmin(axis=1))
    common[key[order[1:]] != key[order[:-1]]] = -1
    return order, np.concatenate([[-1], common])


def _alike(order: np.ndarray, common: np.ndarray, depth: int) -> np.ndarray:
    """By row: numbers of the classes of rows that have so many first words in common."""
    out = np.empty(len(order), dtype=np.int64)
    out[order] = np.cumsum(common < depth)
    return out


def shared_runs(key: np.ndarray, back: np.ndarray, words: list[np.ndarray], least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(context, back, least)`` of each run of :data:`LENGTH` words that two documents have: sort, compare neighbours, extend both ways.

    Rows of one key have their first :data:`AHEAD` words in common; ``words`` are those before and those after them.
    """
    n, behind, ahead = len(key), WINDOW - 1, LENGTH - AHEAD
    left, right = np.zeros((n, behind), dtype=np.int64), np.zeros((n, ahead), dtype=np.int64)
    long = np.array([len(w) for w in words]) - back
    for i, (w, b) in enumerate(zip(words, back, strict=True)):
        left[i, :b] = w[:b][::-1]
        right[i, : long[i]] = w[b:]
    forward, backward = _neighbours(right, key, long), _neighbours(left, key, back)
    rows, shifts, firsts = [], [], []
    for b in range(WINDOW):
        whole = np.flatnonzero((back >= b) & (long >= ahead - b))
        if not len(whole):
            continue
        both = np.stack([_alike(*forward, ahead - b)[whole], _alike(*backward, b)[whole]], axis=1)
        run = np.unique(both, axis=0, return_inverse=True)[1].ravel()
        first, last = np.full(run.max() + 1, np.iinfo(np.int64).max), np.full(run.max() + 1, -1)
        np.minimum.at(first, run, least[whole])
        np.maximum.at(last, run, most[whole])
        hit = first[run] != last[run]
        rows.append(whole[hit])
        shifts.append(np.full(hit.sum(), b))
        firsts.append(first[run][hit])
    return tuple(np.concatenate([*x, np.zeros(0, np.int64)]).astype(np.int64) for x in (rows, shifts, firsts))


def matches(contexts: DataFrame) -> DataFrame:
    """``(context, kept_in, behind, inside)``: runs that two documents have, by the first document that has them: from how far before the context's suffix they begin, at most and at least.

    ``contexts``: key, context, least, most, back, words.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = None  # the last key of a batch may go on in the next
        for pdf in parts:
            pdf = pdf if kept is None else pd.concat([kept, pdf])
            open_ = (pdf["key"] == pdf["key"].iloc[-1]).to_numpy()
            kept = pdf[open_]
            if not open_.all():
                yield whole(pdf[~open_])
        if kept is not None:
            yield whole(kept)

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        docs = [(x["last"], x["id"]) for c in ("least", "most") for x in pdf[c]]
        known = sorted(set(docs))
        number = {d: i for i, d in enumerate(known)}
        place = np.array([number[d] for d in docs], dtype=np.int64).reshape(2, -1)
        row, shift, first = shared_runs(pdf["key"].to_numpy(), pdf["back"].to_numpy(), pdf["words"].tolist(), *place)
        found = pd.DataFrame({"row": row, "first": first, "shift": shift}).groupby(["row", "first"])["shift"].agg(["max", "min"]).reset_index()
        last, own = np.array([d[0] for d in known], dtype=bool), np.array([d[1] for d in known], dtype=np.int64)
        row, first = found["row"].to_numpy(), found["first"].to_numpy()
        return pd.DataFrame({"context": pdf["context"].to_numpy()[row], "last": last[first], "id": own[first], "behind": found["max"], "inside": found["min"]})

    # keys are hashes: dealt by another hash, they need no sample for the bounds of ranges, and the texts are read once
    ordered = contexts.select("key", "context", "least", "most", "back", "words").repartition("key").sortWithinPartitions("key")
    found = ordered.mapInPandas(run, "context long, last boolean, id long, behind int, inside int")
    return found.select("context", F.struct("last", "id").alias("kept_in"), "behind", "inside")


def crowded_matches(contexts: DataFrame) -> DataFrame:
    """The same for contexts of hashes that very many share: each run is found by a hash of its own."""
    around = LENGTH - AHEAD  # words of a run besides those of the key
    shift = F.explode(F.sequence(F.greatest(F.lit(0), around - (F.size("words") - F.col("back"))), F.least("back", F.lit(WINDOW - 1)))).alias("shift")
    fit = contexts.where(F.size("words") >= around).select("key", "context", "least", "most", "back", "words", shift)
    runs = materialise(fit.select("context", "least", "most", "shift", F.xxhash64("key", "shift", F.slice("words", F.col("back") - F.col("shift") + 1, around)).alias("run")))
    common = runs.groupBy("run").agg(F.min("least").alias("kept_in"), F.max("most").alias("to")).where("kept_in != to").select("run", "kept_in")
    hits = runs.join(materialise(common).hint("merge"), "run").groupBy("context", "kept_in").agg(F.max("shift").alias("behind"), F.min("shift").alias("inside"))
    return hits.select("context", "kept_in", "behind", "inside")


#: Contexts of one hash that are sorted together.
CROWD = 5000


def _contexts(docs: DataFrame, places: DataFrame) -> DataFrame:
    """``(key, context, least, most, back, words)`` of each place, from one text that has it."""
    wanted = materialise(places.groupBy("one.doc", "one.hash").agg(F.collect_list(F.struct("one.pos", "context", "key", "least", "most")).alias("places")))
    # texts that share no slot with one that has places stay out of the shuffle; the join tells the others apart
    slot = F.pmod("hash", F.lit(SLOTS)).alias("slot")
    texts = docs.select("*", slot).join(F.broadcast(wanted.select(slot).distinct()), "slot", "left_semi").drop("slot")
    # rows that repeat an id and a text list the same places
    texts = texts.dropDuplicates(["doc", "hash"]) if _repeats(docs) else texts
    met = texts.join(wanted.hint("merge"), ["doc", "hash"])
    place = F.get("places", F.col("i"))
    listed = met.select("places", F.inline(contexts_of(F.col("text"), F.col("places.pos"))))
    return listed.select(*[place[c].alias(c) for c in ("key", "context", "least", "most")], "back", "words")


def _stretches(docs: DataFrame) -> DataFrame:
    """``(doc_id, doc, hash, kept_in, first, last)``: stretches of words in a match, which may overlap, by the first document that has it."""
    hash_ = F.xxhash64("text")
    doc = F.struct(F.col("doc_id").isNull().alias("last"), F.coalesce("doc_id", hash_).alias("id"))
    docs = docs.where("text IS NOT NULL").select("doc_id", hash_.alias("hash"), doc.alias("doc"), "text")
    kept = docs.select("doc", "hash", F.inline(anchors(F.col("text"))))
    # rows without an id that repeat a text are documents too: the second stands next to the first
    twice = docs.where("doc_id IS NULL").groupBy("hash").count().where("count > 1").select(F.col("hash").alias("again"))
    kept = kept.join(F.broadcast(twice) if twice.limit(SLOTS + 1).count() <= SLOTS else twice, F.col("doc.last") & (F.col("hash") == F.col("again")), "left")
    kept = materialise(kept.select("doc", F.col("again").isNotNull().alias("twin"), "hash", "pos", "key", "context"))
    other = F.struct(F.col("doc.last").alias("last"), (F.col("doc.id") + F.col("twin").cast("int")).alias("id"))
    keys = kept.groupBy("key").agg(F.min("doc").alias("least"), F.max(other).alias("most"))
    # written first: Spark deals a crowded side of a join anew only where no sum shares its stage
    shared = materialise(keys.where("least != most").select("key"))
    near = materialise(kept.join(shared.hint("merge"), "key"))
    places = near.groupBy("context").agg(F.min("doc").alias("least"), F.max(other).alias("most"), F.min(F.struct("doc", "hash", "pos")).alias("one"), F.first("key").alias("key"))
    places = materialise(places)
    crowds = materialise(places.groupBy("key").count().where(F.col("count") > CROWD).select("key"))
    crowded = crowds.limit(1).count() > 0
    hits = matches(_contexts(docs, places.join(crowds, "key", "left_anti") if crowded else places))
    if crowded:
        hits = hits.unionByName(crowded_matches(_contexts(docs, places.join(crowds, "key", "left_semi"))))
    found = near.join(materialise(hits).hint("merge"), "context")
    first, last = (F.col("pos") - F.col("behind")).cast("long"), (F.col("pos") - F.col("inside") + LENGTH).cast("long")
    return found.select(F.when(~F.col("doc.last"), F.col("doc.id")).alias("doc_id"), "doc", other.alias("other"), "hash", "kept_in", first.alias("first"), last.alias("last"))


#: Hashes of texts, or slots of these, that are broadcast at most.
SLOTS = 1 << 20


def _repeats(docs: DataFrame) -> bool:
    return docs.groupBy("doc", "hash").count().where("count > 1").limit(1).count() > 0


def _merged(stretches: DataFrame, by: list[str]) -> DataFrame:
    """Stretches that overlap or touch as one: ``first_word, n_words``."""
    order = Window.partitionBy(*by).orderBy("first", "last")
    reached = F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opened = stretches.distinct().withColumn("opens", F.coalesce(F.col("first") > reached, F.lit(True)).cast("int"))
    numbered = opened.withColumn("passage", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    merged = numbered.groupBy(*by, "passage").agg(F.min("first").alias("first_word"), F.max("last").alias("last"))
    return merged.select(*by, "first_word", (F.col("last") - F.col("first_word")).alias("n_words"))


def passages(docs: DataFrame) -> DataFrame:
    """``(doc_id, first_word, n_words)``: one row for each repeated passage of a text, overlapping matches as one."""
    return _merged(_stretches(docs).select("doc_id", "hash", "first", "last"), ["doc_id", "hash"]).drop("hash")


def cut(text: str, stretches: list[tuple[int, int]]) -> str:
    """``text`` without these stretches of words (first, number); what separates a stretch from the word before goes too."""
    raw = text.encode("utf-8", "surrogatepass")
    ends = [m.span() for m in _WORD.finditer(raw)]
    out, at = [], 0
    for first, n in sorted(stretches):
        out.append(raw[at : ends[first - 1][1] if first else 0])
        at = ends[first + n - 1][1]
    return b"".join([*out, raw[at:]]).decode("utf-8", "surrogatepass")


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with each repeated passage cut from all documents but the first that has it; all rows and columns stay.

    Of rows without an id that repeat a text, the one with the smallest hash of all columns counts as first.
    """
    stretches = materialise(_stretches(docs).select("doc", "other", "hash", "kept_in", "first", "last"))
    flag, id_, hash_, own, cuts = (fresh(docs, f"repeats_{c}") for c in ("last", "id", "hash", "own", "cuts"))

    def listed(of: DataFrame, copies: bool) -> DataFrame:
        each = _merged(of.select("doc", "hash", "first", "last"), ["doc", "hash"]).groupBy("doc", "hash").agg(F.collect_list(F.struct("first_word", "n_words")).alias(cuts))
        return each.select(F.col("doc.last").alias(flag), F.col("doc.id").alias(id_), F.col("hash").alias(hash_), F.lit(copies).alias(own), cuts)

    # a second copy without an id loses what the first keeps, too
    wanted = listed(stretches.where("doc != kept_in"), False).unionByName(listed(stretches.where("doc.last AND doc != other"), True))

    @F.arrow_udf("string")
    def shorter(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, places in batches:
            rows = zip(texts.to_pylist(), places.to_pylist(), strict=True)
            yield pa.array([t if not s or t is None else cut(t, [(x["first_word"], x["n_words"]) for x in s]) for t, s in rows], type=pa.string())

    nameless = docs.where("doc_id IS NULL")
    nth = F.row_number().over(Window.partitionBy(F.xxhash64("text")).orderBy(F.xxhash64(*docs.columns)))
    placed = docs.where("doc_id IS NOT NULL").withColumn(own, F.lit(False)).unionByName(nameless.withColumn(own, nth > 1))
    hash_of = F.xxhash64("text")
    wanted = materialise(wanted).withColumnRenamed(own, fresh(docs, "repeats_copies"))
    copies = wanted.columns[3]
    same = (F.col("doc_id").isNull() == F.col(flag)) & (F.coalesce("doc_id", hash_of) == F.col(id_)) & (hash_of == F.col(hash_)) & (F.col(own) == F.col(copies))
    both = placed.join(wanted.hint("merge"), same, "left")
    return both.withColumn("text", shorter(F.col("text"), F.col(cuts))).select(*docs.columns)
