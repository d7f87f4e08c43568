"""SimHash near-dedup by a self-join of binary tries.

``fingerprint`` gives each text one or more 64-bit SimHash words of its word shingles. The distinct words form a binary
trie. The join walks it in pairs of nodes, from the pair (root, root) down: it adds the bits in which two nodes differ
and prunes a pair once they exceed the error budget. So it finds every pair of words within the budget, and a node meets
at most 1 + d + d(d-1)/2 others at depth d under a budget of two, however the words lie.

Spark deals the walk out. Of budget + 1 segments of a word, two words within the budget agree in one. So each segment in
turn comes first in the trie, and the subtries below its first bits are tasks of about :data:`LIMIT` words: each word is
copied budget + 1 times, at whatever size. A subtrie that is crowded still is cut into parts, each pair of which is a task.
Within a task the walk runs over sorted arrays, with a bounded frontier, and returns a spanning forest of the links it has
found, never all pairs. Components over the forests of all tasks are those over all links.

``similar`` links texts by the exact Jaccard similarity of their distinct shingles. Its candidates come from the same join:
the SimHash of a set is cut into tries (:func:`tries`), as many as let no more than one pair in 10,000 of the asked
similarity go by, and pairs that meet in one have their first 256 bits compared, with a bound five standard errors above
what such pairs differ in. Its tries are dealt out otherwise: the subtries below their first bits are tasks, which the words
of a pair have to share; each doubling of the texts takes one bit more, and a tenth to a fifth more tries make up for it,
at any size alike. Within each component of candidates all pairs that no chain of links connects yet are compared
exactly, in blocks. (Of texts of eight words against nine, whose few shingles make SimHash coarse, 1 pair in 100 is lost.)

Nulls count as empty texts; a text without words has the fingerprint zero, and an empty set of shingles. Copies share a
fingerprint and are one word of the trie. Repeated and null ids keep their rows; a component of null ids alone has a null
id.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from triplane.llm.components import components
from triplane.shared import fresh, materialise

#: Words of a task; one with more is cut into parts.
LIMIT = 50_000
#: Node pairs that a task's walk holds at once; more wait on a stack.
FRONTIER = 1 << 17

_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.float64)


def _more_words(h: np.ndarray, words: int) -> np.ndarray:
    """[n, words]: the hashes themselves, then mixes of them (the finaliser of SplitMix64)."""
    out = np.empty((len(h), words), dtype=np.uint64)
    out[:, 0] = h
    for j in range(1, words):
        z = h + np.uint64(0x9E3779B97F4A7C15 * j & (1 << 64) - 1)
        z = (z ^ z >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ z >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
        out[:, j] = z ^ z >> np.uint64(31)
    return out


def majority(h: np.ndarray, words: int) -> np.ndarray:
    """Words of hashes, as signed 64-bit numbers; a bit is 1 if it is set in over half of them."""
    counts = np.zeros((8 * words, 256), dtype=np.int64)
    for at in range(0, len(h), 1 << 12):
        octets = _more_words(h[at : at + (1 << 12)], words).view(np.uint8).reshape(-1, 8 * words)
        counts += np.bincount((octets + np.arange(8 * words) * 256).ravel(), minlength=2048 * words).reshape(-1, 256)
    set_in = counts @ _BYTE_BITS
    return np.packbits((2 * set_in > len(h)).ravel(), bitorder="little").view(np.int64)


def simhash(text: str | None, shingle: int, words: int = 1) -> np.ndarray:
    """Words of one text, of all its shingles with their repeats."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z and ASCII white space only
    if not tokens:
        return np.zeros(words, dtype=np.int64)
    digest = xxhash.xxh64_intdigest
    if len(tokens) <= shingle:
        h = np.array([digest(b" ".join(tokens), 42)], dtype=np.uint64)
    else:
        runs = zip(*(tokens[i:] for i in range(shingle)), strict=False)
        h = np.fromiter((digest(b" ".join(run), 42) for run in runs), dtype=np.uint64, count=len(tokens) - shingle + 1)
    return majority(h, words)


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """The distinct hashes of a text's shingles, sorted; a text with no more words than a shingle is one shingle."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return np.zeros(0, dtype=np.uint64)
    if len(tokens) <= shingle:
        return np.array([xxhash.xxh64_intdigest(b" ".join(tokens), 42)], dtype=np.uint64)
    words = np.fromiter(map(xxhash.xxh64_intdigest, tokens), dtype=np.uint64, count=len(tokens))
    n = len(tokens) - shingle + 1
    h = np.zeros(n, dtype=np.uint64)
    for j in range(shingle):
        h = (h ^ h >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9) + words[j : j + n]
    return np.unique((h ^ h >> np.uint64(32)) * np.uint64(0x94D049BB133111EB))


def fingerprint(text: Column, shingle: int = 3, words: int = 1) -> Column:
    """``array<bigint>`` of SimHash words; never null."""

    @F.arrow_udf("array<bigint>")
    def simhash_words(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            rows = [simhash(t.as_py(), shingle, words) for t in batch]
            ends = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * words)
            yield pa.ListArray.from_arrays(ends, pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int64)))

    return simhash_words(text)


def _below(label: np.ndarray, a: np.ndarray, b: np.ndarray, c: np.ndarray, e: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of the places below pairs of nodes [a, b) and [c, e), less those that ``label`` joins in time."""
    same, sizes = a == c, (b - a).astype(np.int64) * (e - c)
    for lo, hi in zip(a[same].tolist(), b[same].tolist(), strict=True):
        for apart in range(1, hi - lo):
            if (label[lo:hi] == label[lo]).all():
                break
            yield np.arange(lo, hi - apart), np.arange(lo + apart, hi)
    large = ~same & (sizes > FRONTIER)
    for lo, hi, lo2, hi2 in zip(*(x[large].tolist() for x in (a, b, c, e)), strict=True):
        for i in range(lo, hi):
            if (label[lo:hi] == label[lo]).all() and (label[lo2:hi2] == label[lo]).all():
                break
            yield np.full(hi2 - lo2, i), np.arange(lo2, hi2)
    small = ~same & ~large
    a, c, e, sizes = a[small], c[small], e[small], sizes[small]
    ends = np.cumsum(sizes)
    for part in np.split(np.arange(len(a)), np.flatnonzero(np.diff(ends // FRONTIER)) + 1):
        own = sizes[part]
        left = np.repeat(part, own)
        inside = np.arange(len(left)) - np.repeat(np.cumsum(own) - own, own)
        wide = (e - c)[left]
        yield a[left] + inside // wide, c[left] + inside % wide


def _walk(word: np.ndarray, roots: np.ndarray, width: int, budget: int, label: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of places in ``word`` that differ in at most ``budget`` of their first ``width`` bits.

    ``word``: unsigned, distinct and sorted within each root's ranges. ``roots``: rows of (depth, low, high of one node,
    low, high of the other, errors so far); both ranges are equal for a node with itself. Pairs of words with equal
    first bits may be left out once ``label``, which the caller updates, is the same for both.
    """
    ones = {}

    def before(d: int) -> np.ndarray:
        if d not in ones:
            ones[d] = np.concatenate([np.zeros(1, np.int32), np.cumsum(word >> np.uint64(63 - d) & np.uint64(1), dtype=np.int32)])
        return ones[d]

    stack = [(int(d), roots[roots[:, 0] == d, 1:].T.astype(np.int32)) for d in np.unique(roots[:, 0])]
    while stack:
        d, (a, b, c, e, err) = stack.pop()
        if len(a) > FRONTIER:
            half = len(a) // 2
            stack += [(d, np.stack([x[half:] for x in (a, b, c, e, err)])), (d, np.stack([x[:half] for x in (a, b, c, e, err)]))]
            continue
        if d == width:
            yield from _below(label, a, b, c, e)
            continue
        count = before(d)
        m, n = b - (count[b] - count[a]), e - (count[e] - count[c])  # zeros come first
        same = a == c
        kids = [(a, m, c, n, err), (m, b, n, e, err), (a, m, n, e, err + 1)]
        parts = [np.stack(x)[:, (x[1] > x[0]) & (x[3] > x[2]) & (x[4] <= budget)] for x in kids]
        other = (~same) & (b > m) & (n > c) & (err < budget)
        parts.append(np.stack([m, b, c, n, err + 1])[:, other])
        kept = np.concatenate(parts, axis=1)
        lone = (kept[0] == kept[2]) & (kept[1] - kept[0] == 1)  # one word with itself
        kept = kept[:, ~lone]
        if kept.shape[1]:
            stack.append((d + 1, kept))


def _union(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the pairs in ``label``, which holds the root of each place, the smallest of its set."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label[:] = up


def links(entries: DataFrame, width: int, budget: int, nodes: int, most: int | None = None, limit: int = LIMIT, exact: int | None = None) -> DataFrame:
    """A spanning forest ``(a, b)`` of the nodes whose words are within the budget, and equal in their first ``exact`` bits if these are given.

    ``entries``: ``tbl`` (int, one trie each), ``node`` (long), ``word`` (long, its first ``width`` bits from the top
    count), and, if ``most`` is given, ``s0`` to ``s3`` (long): pairs that differ in more than ``most`` bits of these are
    not linked. ``nodes``: about how many each trie has; it decides how the work is dealt out, never what is found.
    """
    sketch = [f"s{i}" for i in range(SKETCH)] if most is not None else []
    segment = width // (budget + 1)
    first = min(segment, max(0, math.ceil(math.log2(max(1, nodes) / limit)) + 1 if nodes > limit else 0)) if exact is None else exact
    turned = []
    for turn in range(budget + 1 if first and exact is None else 1):
        shift = turn * segment
        word = F.col("word")
        if shift:
            word = F.shiftleft(word, shift).bitwiseOR(F.shiftleft(F.shiftrightunsigned(word, 64 - shift), 64 - width))
        at = F.shiftrightunsigned(word, 64 - first) if first else F.lit(0).cast("long")
        turned.append(F.struct(word.alias("word"), F.shiftleft(F.col("tbl").cast("long") * (budget + 1) + turn, first).bitwiseOR(at).alias("task")))
    tasks = entries.select("node", *sketch, F.inline(F.array(*turned)))
    tasks = tasks.withColumns({"i": F.lit(0), "j": F.lit(0)})
    crowded = materialise(tasks.groupBy("task").agg(F.count("*").alias("n")).where(F.col("n") > limit))
    if crowded.limit(1).count():
        cut = tasks.join(crowded, "task", "left").withColumn("parts", F.coalesce(F.ceil(2 * F.col("n") / limit), F.lit(1)).cast("int"))
        own = F.pmod(F.xxhash64(F.lit(3), "node"), F.col("parts")).cast("int")
        pairs = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda p: F.struct(F.least(own, p).alias("i"), F.greatest(own, p).alias("j")))
        tasks = cut.drop("i", "j").select("node", *sketch, "word", "task", F.inline(pairs))

    def forest(pdf: pd.DataFrame) -> pd.DataFrame:
        """The links of one task."""
        order = np.argsort(pdf["word"].to_numpy().view(np.uint64))
        word, node = pdf["word"].to_numpy().view(np.uint64)[order], pdf["node"].to_numpy()[order]
        bits = np.stack([pdf[c].to_numpy().view(np.uint64)[order] for c in sketch], axis=1) if sketch else None
        n = len(word)
        label = np.arange(n)
        for a, b in _walk(word, np.array([[0, 0, n, 0, n, 0]], dtype=np.int64), width, budget, label):
            for at in range(0, len(a), FRONTIER):
                p, q = a[at : at + FRONTIER], b[at : at + FRONTIER]
                apart = label[p] != label[q]
                p, q = p[apart], q[apart]
                if bits is not None and len(p):
                    near = np.bitwise_count(bits[p] ^ bits[q]).sum(axis=1, dtype=np.int64) <= most
                    p, q = p[near], q[near]
                _union(label, p, q)
        hung = np.flatnonzero(label != np.arange(n))
        return pd.DataFrame({"a": node[hung], "b": node[label[hung]]})

    return tasks.groupBy("task", "i", "j").applyInPandas(forest, "a long, b long").where("a != b")


def groups(docs: DataFrame, shingle: int = 3, budget: int = 2) -> DataFrame:
    """``(doc_id, word, component_id)`` of each document: fingerprints within ``budget`` bits link.

    ``component_id`` is the smallest doc_id that is reachable, itself included.
    """
    words = materialise(docs.select(F.col("doc_id"), fingerprint(F.col("text"), shingle)[0].alias("word")))
    nodes = materialise(words.groupBy("word").agg(F.min("doc_id").alias("least")))
    found = links(nodes.select(F.lit(0).alias("tbl"), F.col("word").alias("node"), "word"), 64, budget, nodes.count())
    reach = components(materialise(found), "a", "b").withColumnRenamed("node", "word")
    named = nodes.join(reach, "word", "left").withColumn("root", F.coalesce("root", "word"))
    smallest = named.groupBy("root").agg(F.min("least").alias("component_id"))
    each = named.join(smallest, "root").select("word", "component_id")
    return words.join(each, "word").select("doc_id", "word", "component_id")


def digest(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, fingerprint in hexadecimal, component_id."""
    word = F.lower(F.lpad(F.hex("word"), 16, "0"))
    return groups(docs).select("doc_id", word.alias("fingerprint"), "component_id")


#: Words of a sketch that candidates are compared by.
SKETCH = 4
#: Share of pairs of just the asked similarity that meet in none of the tries.
MISSED = 1e-4
#: Texts of a block of exact comparisons.
PART = 500
#: Rows are looked up by so many hash values at most before an exact join: the bound of the only broadcasts here.
SLOTS = 1 << 20


def bit_share(similarity: float) -> float:
    """Share of bits that differ between sets of such a Jaccard similarity, by the angle between sets of like size."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def tries(nodes: int, similarity: float, budget: int = 2, exact: int = 0) -> tuple[int, int]:
    """Bits of a trie's words, of which ``exact`` have to be equal, and how many tries: the words grow with the logarithm of the number of texts."""
    width = 24 + max(0, math.ceil(math.log2(max(1, nodes)) - 20))
    p = bit_share(similarity)
    rest = width - exact
    met = (1 - p) ** exact * sum(math.comb(rest, k) * p**k * (1 - p) ** (rest - k) for k in range(budget + 1))
    return width, math.ceil(math.log(MISSED) / math.log(1 - met))


def exact_bits(nodes: int, limit: int) -> int:
    """First bits of a trie that leave about half of ``limit`` of its words to a task, or a quarter."""
    return max(0, math.ceil(math.log2(2 * max(1, nodes) / limit)))


def most_bits(similarity: float) -> int:
    """Differing bits of a sketch, five standard errors above what sets of that similarity differ in."""
    p, n = bit_share(similarity), 64 * SKETCH
    return math.ceil(n * p + 5 * math.sqrt(n * p * (1 - p)))


def _sets(text: Column, shingle: int, words: int) -> Column:
    """``struct<node:bigint,words:array<bigint>>``: a hash of the text's set of shingles, and its SimHash."""

    @F.arrow_udf("struct<node:bigint,words:array<bigint>>")
    def sketched(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            nodes, rows = np.zeros(len(batch), dtype=np.uint64), np.zeros((len(batch), words), dtype=np.int64)
            for i, t in enumerate(batch):
                own = shingle_set(t.as_py(), shingle)
                nodes[i] = xxhash.xxh64_intdigest(own.tobytes())
                if len(own):
                    rows[i] = majority(own, words)
            ends = pa.array(np.arange(len(batch) + 1, dtype=np.int32) * words)
            yield pa.StructArray.from_arrays([pa.array(nodes.view(np.int64)), pa.ListArray.from_arrays(ends, pa.array(rows.ravel()))], names=["node", "words"])

    return sketched(text)


def _least(of: list[Column]) -> Column:
    """The order of rows: by id, those without one last, then by the hash of the text."""
    return F.struct(of[0].isNull().alias("last"), of[0].alias("key"), of[1].alias("hash"))


def _shared(sets: list[np.ndarray]) -> tuple[Callable[[int], np.ndarray], np.ndarray]:
    """A function of i: how many elements set i has in common with each; and the sizes."""
    sizes = np.array([len(x) for x in sets], dtype=np.int64)
    element = np.unique(np.concatenate([*sets, np.zeros(0, np.uint64)]), return_inverse=True)[1]
    owner = np.repeat(np.arange(len(sets)), sizes)[np.argsort(element, kind="stable")]  # of each element in turn
    times = np.bincount(element)
    first, ends = np.cumsum(times) - times, np.cumsum(sizes)

    def common_with(i: int) -> np.ndarray:
        own = element[ends[i] - sizes[i] : ends[i]]
        n = times[own]
        at = np.repeat(first[own] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return np.bincount(owner[at], minlength=len(sets))

    return common_with, sizes


def _comparisons(shingle: int, similarity: float, most: int):
    """A task of exact comparisons: rows of ``root, node, c, side``, sketch and text; side 2 meets side 1 only.

    Rows of one ``c`` are connected already. Returns links that connect all that links in the task connect.
    """

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple[int, int]] = []
        for _, own in pdf.groupby("root", sort=False):
            own = own.sort_values(["side", "node"])
            node, side = own["node"].to_numpy(), own["side"].to_numpy()
            bits = np.stack([own[f"s{i}"].to_numpy().view(np.uint64) for i in range(SKETCH)], axis=1)
            common_with, sizes = _shared([shingle_set(t, shingle) for t in own["text"]])
            label = np.unique(own["c"].to_numpy(), return_inverse=True)[1]
            for i in range(1, len(own)):
                near = (np.bitwise_count(bits[:i] ^ bits[i]).sum(axis=1, dtype=np.int64) <= most) & (label[:i] != label[i])
                if side[i] == 2:
                    near &= side[:i] == 1
                if near.any():
                    common = common_with(i)[:i]
                    near &= common >= similarity * (sizes[:i] + sizes[i] - common) - 1e-9
                for j in np.flatnonzero(near).tolist():
                    if label[i] != label[j]:
                        found.append((node[i], node[j]))
                        label[label == label[i]] = label[j]
        return pd.DataFrame(found, columns=["a", "b"], dtype=np.int64)

    return compare


def _exact_links(members: DataFrame, shingle: int, similarity: float, part: int) -> DataFrame:
    """``(a, b)``: links that connect all that links between members of one root connect.

    ``members``: ``root, node``, sketch and text. A root with many members is cut into parts, and two of them come into
    each. What these do not connect to the root's largest group meets all the others of the root, part by part.
    """
    compare = _comparisons(shingle, similarity, most_bits(similarity))
    sizes = materialise(members.groupBy("root").agg(F.count("*").alias("m"), F.array_distinct(F.array(F.min("node"), F.max("node"))).alias("centres")))
    tasks = max(1, members.count() // (4 * part))
    own = F.pmod(F.xxhash64(F.lit(7), "node"), F.col("parts")).cast("int")
    cut = members.join(sizes.hint("merge"), "root").withColumn("parts", F.ceil(F.col("m") / part).cast("int"))
    cut = materialise(cut.withColumn("part", own))
    everywhere = (F.col("parts") > 1) & F.array_contains("centres", F.col("node"))
    dealt = cut.withColumn("to", F.explode(F.when(everywhere, F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array("part"))))
    task = F.when(F.col("parts") == 1, F.pmod(F.xxhash64("root"), F.lit(tasks))).otherwise(F.col("root"))
    dealt = dealt.withColumns({"task": task, "alone": F.col("parts") > 1, "c": F.col("node"), "side": F.lit(1)})
    sketch = [f"s{i}" for i in range(SKETCH)]
    columns = ["root", "node", "c", "side", *sketch, "text"]
    found = materialise(dealt.select("task", "alone", "to", *columns).groupBy("task", "alone", "to").applyInPandas(compare, "a long, b long"))
    large = cut.where("parts > 1")
    if not large.limit(1).count():
        return found
    reach = components(found, "a", "b").select(F.col("node").alias("of"), F.col("root").alias("joined"))
    named = materialise(large.join(reach.hint("merge"), F.col("node") == F.col("of"), "left").withColumn("c", F.coalesce("joined", "node")))
    main = named.groupBy("root", "c").agg(F.count("*").alias("n")).groupBy("root").agg(F.max_by("c", F.struct("n", "c")).alias("main"), F.sum("n").alias("all"), F.max("n").alias("most"))
    main = materialise(main.where(F.col("all") > F.col("most")).withColumn("others", F.ceil((F.col("all") - F.col("most")) / part).cast("int")))
    rest = named.join(main.select("root", "main", "others").hint("merge"), "root")
    block = F.pmod(F.xxhash64(F.lit(8), "node"), F.col("others")).cast("int")
    all_blocks, all_parts = F.sequence(F.lit(0), F.col("others") - 1), F.sequence(F.lit(0), F.col("parts") - 1)
    ends = rest.withColumns({"side": F.lit(1), "i": F.explode(all_blocks)}).withColumn("j", F.col("part"))
    others = rest.where("c != main").withColumns({"side": F.lit(2), "j": F.explode(all_parts)}).withColumn("i", block)
    met = ends.select("i", "j", *columns).unionByName(others.select("i", "j", *columns))
    return found.unionByName(materialise(met.groupBy("root", "i", "j").applyInPandas(compare, "a long, b long")))


def similar(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 5, similarity: float = 0.8, part: int = PART, limit: int = 8 * LIMIT) -> DataFrame:
    """``(key, hash, first)`` of each row: the hash of its text, and the (last, key, hash) of the first row of its group.

    Texts link whose distinct shingles have that Jaccard similarity or more; all texts without words are equal. Rows are
    told apart by id and text: equal ids with different texts, and rows without an id, are documents of their own.
    """
    number = docs.count()
    exact = exact_bits(number, limit)
    width, count = tries(number, similarity, exact=exact)
    words = max(SKETCH, -(-width * count // 64))
    rows = docs.select(F.col(key).alias("key"), F.xxhash64(text).alias("hash"), _sets(F.col(text), shingle, words).alias("f")).select("key", "hash", "f.*")
    rows = materialise(rows)
    sketch = [F.get("words", F.lit(i)).alias(f"s{i}") for i in range(SKETCH)]
    nodes = materialise(rows.groupBy("node").agg(F.min(_least([F.col("key"), F.col("hash")])).alias("first"), F.first("words").alias("words")))
    cut = []
    for t in range(count):
        word, shift = divmod(t * width, 64)
        piece = F.shiftleft(F.get("words", F.lit(word)), shift)
        if shift + width > 64:
            piece = piece.bitwiseOR(F.shiftrightunsigned(F.get("words", F.lit(word + 1)), 64 - shift))
        cut.append(F.shiftleft(F.shiftrightunsigned(piece, 64 - width), 64 - width))
    entries = nodes.select("node", *sketch, F.posexplode(F.array(*cut)).alias("tbl", "word"))
    reach = components(materialise(links(entries, width, 2, number, most_bits(similarity), limit, exact)), "a", "b")
    # one text of each node that has a candidate; they are found by a slot of their row first, one of SLOTS
    wanted = materialise(nodes.select("node", "first", *sketch).join(reach.hint("merge"), "node"))
    slot = lambda k, h: F.pmod(F.xxhash64(k, h), F.lit(SLOTS))
    slots = wanted.select(slot(F.col("first.key"), F.col("first.hash")).alias("slot")).distinct()
    hashed = docs.select(F.col(key).alias("key"), F.xxhash64(text).alias("hash"), F.col(text).alias("text"))
    near = hashed.join(F.broadcast(slots), slot(F.col("key"), F.col("hash")) == F.col("slot"), "left_semi")
    members = near.join(wanted.hint("merge"), near["key"].eqNullSafe(wanted["first.key"]) & (near["hash"] == wanted["first.hash"]))
    members = materialise(members.select("root", "node", *[f"s{i}" for i in range(SKETCH)], "text").dropDuplicates(["node"]))
    found = components(_exact_links(members, shingle, similarity, part), "a", "b")
    named = materialise(nodes.select("node", "first").join(found.hint("merge"), "node", "left").withColumn("root", F.coalesce("root", "node")))
    least = named.groupBy("root").agg(F.min("first").alias("first"))
    each = named.select("node", "root").join(least.hint("merge"), "root").select("node", "first")
    return rows.select("key", "hash", "node").join(each.hint("merge"), "node").select("key", "hash", "first")


def drop_similar(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, **kinds) -> DataFrame:
    """The first document of each group of similar ones, with all columns as they are; kinds: see :func:`similar`.

    First is the smallest doc_id, none last, then the smallest hash of the text. Of rows that repeat both, the one with
    the smallest hash of all columns stays, so that reruns agree.
    """
    found = materialise(similar(docs, "doc_id", "text", shingle, similarity, **kinds))
    name, of, slot = (fresh(docs, f"similar_{c}") for c in ("key", "hash", "slot"))
    place = F.struct(F.col("key").isNull().alias("last"), "key", "hash")
    again = found.groupBy("key", "hash", "first").agg(F.count("*").alias("times"))
    again = materialise(again.where((place != F.col("first")) | (F.col("times") > 1)).select(F.col("key").alias(name), F.col("hash").alias(of), (place != F.col("first")).alias("goes")))
    in_slot = F.pmod(F.xxhash64(F.col("doc_id"), F.xxhash64("text")), F.lit(SLOTS))
    slots = F.broadcast(again.select(F.pmod(F.xxhash64(name, of), F.lit(SLOTS)).alias(slot)).distinct())
    sure = docs.join(slots, in_slot == F.col(slot), "left_anti")
    asked = docs.join(slots, in_slot == F.col(slot), "left_semi")
    same = F.col("doc_id").eqNullSafe(F.col(name)) & (F.xxhash64("text") == F.col(of))
    stays = asked.join(again.where("goes").hint("merge"), same, "left_anti")
    twice = again.where("NOT goes")
    if not twice.limit(1).count():
        return sure.unionByName(stays)
    order = F.row_number().over(Window.partitionBy("doc_id", F.xxhash64("text")).orderBy(F.xxhash64(*[c for c in docs.columns])))
    one = stays.join(twice.hint("merge"), same, "left_semi").withColumn(slot, order).where(F.col(slot) == 1).drop(slot)
    return reduce(DataFrame.unionByName, [sure, stays.join(twice.hint("merge"), same, "left_anti"), one])
