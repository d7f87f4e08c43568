"""Byte-level BPE in two tiers.

Tier one is a minimal perfect hash over the vocabulary: a pre-token that is a vocabulary entry is resolved by one
probe and one comparison. Tier two, for misses, merges linked bytes with a heap of candidate pairs, lowest rank and
leftmost first, so a pre-token of n bytes costs O(n log n) however long it is.

Texts are encoded in slices of about :data:`SLICE` characters, so that memory is bounded: the distinct pre-tokens of a
slice are resolved once, the ids are gathered as flat arrays. What tier two has merged is remembered, up to
:data:`MEMO_BYTES`. A longer text is a slice of its own, and its pre-tokens are taken in windows.

Encoding and decoding are Arrow functions of one column, so they keep every other column of the DataFrame, whatever its
name, and any number of rows. Nulls encode like empty texts, to no ids; null id lists decode to no bytes. Repeated
rows get repeated results.
"""

from __future__ import annotations

import base64
import heapq
import re
from collections.abc import Iterator
from itertools import chain, islice
from operator import eq

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from triplane.shared import fresh

#: Bytes that a worker remembers of merged pre-tokens; beyond it they are forgotten.
MEMO_BYTES = 24 << 20
#: Characters of texts that are encoded at once, and pre-tokens of a longer text or ids of a decoded one.
SLICE, WINDOW = 500_000, 100_000

# The letters of the Latin blocks below U+0250, all of whose characters this module's fast pattern
# treats as the general pattern does.
_LATIN = r"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ"
_OUTSIDE_LATIN = re.compile(r"[^\t-\r -~\x85\xa0-\xb1\xb4-\xb8\xba\xbb\xbf-ɏ]")
_FAST = re.compile(rf" ?[{_LATIN}]+|'(?:[stmd]|re|ve|ll)| ?[0-9]+| ?[^\s{_LATIN}0-9]+|\s+(?!\S)|\s+")


class PerfectHash:
    """Minimal perfect hash of byte strings: n keys in n slots, by hash and displace.

    Keys fall into buckets by one half of their hash; large buckets first, each takes the smallest displacement that
    sends all its keys to free slots, and buckets of one key name their slot outright.
    """

    def __init__(self, keys: list[bytes]):
        n = self.size = len(keys)
        self.buckets = max(1, n // 4)
        members: list[list[int]] = [[] for _ in range(self.buckets)]
        known = hashes(keys).tolist()
        for i, h in enumerate(known):
            members[h % self.buckets].append(i)
        self.shift = [0] * self.buckets
        slots = np.full(n, -1, dtype=np.int64)
        base, step = (np.array([f(h) % max(n, 1) for h in known], dtype=np.int64) for f in (lambda h: h >> 20, lambda h: h >> 40 | 1))
        order = sorted((b for b in range(self.buckets) if members[b]), key=lambda b: -len(members[b]))
        free = None
        for b in order:
            own = members[b]
            if len(own) == 1:
                free = iter(np.flatnonzero(slots < 0).tolist()) if free is None else free
                s = next(free)
                self.shift[b] = -s - 1
                slots[s] = own[0]
                continue
            first = 0
            while first < n:
                tried = np.arange(first, min(n, first + 512))
                at = (base[own][:, None] + step[own][:, None] * tried) % n
                fits = (slots[at] < 0).all(axis=0)
                if fits.any():
                    ordered = np.sort(at[:, fits], axis=0)
                    apart = (np.diff(ordered, axis=0) > 0).all(axis=0)
                    if apart.any():
                        d = tried[fits][apart.argmax()]
                        self.shift[b] = int(d)
                        slots[(base[own] + step[own] * d) % n] = own
                        break
                first += 512
            else:
                raise ValueError("no displacement separates these keys")
        self.slots = slots.astype(np.int32)
        self.shift = np.array(self.shift, dtype=np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """For each key's hash the number of the only key that it can be; the caller compares."""
        d = self.shift[(h % np.uint64(self.buckets)).astype(np.int64)]
        base, step = (h >> np.uint64(20)).astype(np.int64), (h >> np.uint64(40)).astype(np.int64) | 1
        return self.slots[np.where(d < 0, -d - 1, (base + d * step) % self.size)]


def hashes(keys: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, keys), dtype=np.uint64, count=len(keys))


def runs(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places of runs of so many entries, one after another."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


class Memory:
    """Ids of byte strings by their 64-bit hashes, in flat arrays; the caller compares what the ids stand for."""

    def __init__(self):
        self.keys, self.starts, self.lengths, self.ids = (np.zeros(0, dtype=t) for t in (np.uint64, np.int64, np.int32, np.int32))

    def nbytes(self) -> int:
        return sum(x.nbytes for x in (self.keys, self.starts, self.lengths, self.ids))

    def find(self, h: np.ndarray) -> np.ndarray:
        """The entry of each hash, or -1."""
        at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        return np.where(self.keys[at] == h, at, -1) if len(self.keys) else np.full(len(h), -1)

    def add(self, h: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> None:
        """All in one, sorted; beyond :data:`MEMO_BYTES` only what is new."""
        if self.nbytes() > MEMO_BYTES:
            self.__init__()
        starts = len(self.ids) + np.cumsum(lengths) - lengths
        keys = np.concatenate([self.keys, h])
        order = np.argsort(keys, kind="stable")
        self.keys = keys[order]
        self.starts, self.lengths = np.concatenate([self.starts, starts])[order], np.concatenate([self.lengths, lengths.astype(np.int32)])[order]
        self.ids = np.concatenate([self.ids, ids])


class Vocabulary:
    """Ranks of a tiktoken file, the perfect hash over them, and the flat bytes for decoding."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            pairs = [line.split() for line in lines if line.strip()]
        self.rank = {base64.b64decode(a): int(b) for a, b in pairs}
        self.keys = list(self.rank)
        self.ids = np.array(list(self.rank.values()), dtype=np.int32)
        self.hash = PerfectHash(self.keys)
        self.pattern = pattern
        self.general = regex.compile(pattern)
        by_id = [b""] * (max(self.rank.values(), default=-1) + 1)
        for k, i in self.rank.items():
            by_id[i] = k
        self.lengths = np.array([len(k) for k in by_id], dtype=np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])[:-1].astype(np.int64)
        self.flat = np.frombuffer(b"".join(by_id), dtype=np.uint8)
        self.memory = Memory()

    def split(self, text: str) -> Iterator[list[str]]:
        """Pre-tokens, in lists. Texts of Latin letters take a pattern without Unicode properties, which is equal there."""
        pattern = self.general if _OUTSIDE_LATIN.search(text) else _FAST
        if len(text) <= SLICE:
            yield pattern.findall(text)
            return
        matches = (m[0] for m in pattern.finditer(text))
        while part := list(islice(matches, WINDOW)):
            yield part

    def pieces(self, tokens: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Flat ids, and where those of each pre-token start and how many: one probe of the perfect hash, else merges."""
        raws = [t.encode() for t in tokens]
        h = hashes(raws)
        number = self.hash.find(h) if self.keys else np.zeros(len(h), dtype=np.int64)
        known = np.fromiter(map(eq, map(self.keys.__getitem__, number.tolist()), raws), dtype=bool, count=len(raws)) if self.keys else np.zeros(len(h), dtype=bool)
        starts, lengths = np.zeros(len(h), dtype=np.int64), np.ones(len(h), dtype=np.int64)
        starts[known] = np.arange(known.sum())
        parts = [self.ids[number[known]]]

        missed = np.flatnonzero(~known)
        entry = self.memory.find(h[missed])
        met, at = missed[entry >= 0], entry[entry >= 0]
        own = self.memory.lengths[at].astype(np.int64)
        ids = self.memory.ids[runs(self.memory.starts[at], own)]
        said = [raws[i] for i in met.tolist()]
        ends = np.cumsum(own)
        sizes = np.diff(np.concatenate([[0], np.cumsum(self.lengths[ids])])[np.concatenate([[0], ends])])
        if (sizes == np.fromiter(map(len, said), dtype=np.int64, count=len(said))).all() and b"".join(self.bytes_of(ids)) == b"".join(said):
            starts[met], lengths[met] = len(parts[0]) + ends - own, own
            parts.append(ids)
            missed = missed[entry < 0]
        # else two strings share a hash, and all are merged anew
        if len(missed):
            new = [merged(raws[i], self.rank) for i in missed.tolist()]
            own = np.fromiter(map(len, new), dtype=np.int64, count=len(new))
            ids = np.fromiter(chain.from_iterable(new), dtype=np.int32, count=int(own.sum()))
            starts[missed], lengths[missed] = sum(map(len, parts)) + np.cumsum(own) - own, own
            parts.append(ids)
            short = own < WINDOW // 100
            self.memory.add(h[missed][short], own[short], ids[np.repeat(short, own)])
        return np.concatenate(parts), starts, lengths

    def _ids(self, tokens: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all lists of pre-tokens, flat, and where each list's end."""
        distinct = dict.fromkeys(chain.from_iterable(tokens))
        flat, starts, lengths = self.pieces(list(distinct))
        place = dict(zip(distinct, range(len(distinct)), strict=True))
        counts = np.fromiter(map(len, tokens), dtype=np.int64, count=len(tokens))
        at = np.fromiter(map(place.__getitem__, chain.from_iterable(tokens)), dtype=np.int64, count=int(counts.sum()))
        own = lengths[at]
        ends = np.concatenate([[0], np.cumsum(own)])
        return flat[runs(starts[at], own)], ends[np.cumsum(counts)]

    def encode(self, text: str) -> np.ndarray:
        return np.concatenate([np.zeros(0, dtype=np.int32), *(self._ids([part])[0] for part in self.split(text))])

    def slices(self, texts: Iterator[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Flat ids and the ends of each text's, for some texts at a time."""
        short, size = [], 0
        for text in texts:
            text = text or ""
            if short and size + len(text) > SLICE:
                yield self._ids(short)
                short, size = [], 0
            if len(text) > SLICE:
                ids = self.encode(text)
                yield ids, np.array([len(ids)])
            else:
                short.extend(self.split(text))
                size += len(text) + 50
        if short:
            yield self._ids(short)

    def bytes_of(self, ids: np.ndarray) -> Iterator[bytes]:
        """The bytes that ids stand for, some at a time."""
        for at in range(0, len(ids), WINDOW):
            part = ids[at : at + WINDOW]
            yield self.flat[runs(self.starts[part], self.lengths[part])].tobytes()

    def decoded(self, ids: np.ndarray, ends: np.ndarray) -> pa.Array:
        """``binary`` of each list of flat ids."""
        sizes = np.concatenate([[0], np.cumsum(self.lengths[ids])])[np.concatenate([[0], ends])].astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(sizes), pa.py_buffer(b"".join(self.bytes_of(ids)))])


def _lists(ids: np.ndarray, ends: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(ids.astype(np.int32, copy=False)))


def merged(raw: bytes, rank: dict[bytes, int]) -> tuple[int, ...]:
    """Merge linked bytes, always the pair of lowest rank and of those the leftmost."""
    n = len(raw)
    if n == 1:
        return (rank[raw],)
    end = list(range(1, n + 1))  # of the token that starts here
    before = list(range(-1, n))  # start of the token before
    due = [-1] * (n + 1)  # rank of the pair that starts here, -1: none
    heap = []
    for i in range(n - 1):
        r = rank.get(raw[i : i + 2], -1)
        if r >= 0:
            due[i] = r
            heap.append(r * n + i)
    heapq.heapify(heap)
    while heap:
        r, i = divmod(heapq.heappop(heap), n)
        if due[i] != r:
            continue  # the pair has changed meanwhile
        j = end[i]
        k = end[i] = end[j]
        due[j] = due[i] = -1
        if k < n:
            before[k] = i
            r = rank.get(raw[i : end[k]], -1)
            if r >= 0:
                due[i] = r
                heapq.heappush(heap, r * n + i)
        p = before[i]
        if p >= 0:
            r = due[p] = rank.get(raw[p:k], -1)
            if r >= 0:
                heapq.heappush(heap, r * n + p)
    out, i = [], 0
    while i < n:
        out.append(rank[raw[i : end[i]]])
        i = end[i]
    return tuple(out)


class Tokenizer:
    """Column functions over one vocabulary, built on the driver and broadcast; its file bounds its size.

    An application broadcasts a vocabulary once, so workers that live on hold one copy and one memory of it.
    """

    _shared: dict[tuple[str, str, str], Broadcast] = {}

    def __init__(self, spark: SparkSession, path: str, pattern: str):
        key = (spark.sparkContext.applicationId, path, pattern)
        if key not in self._shared:
            self._shared[key] = spark.sparkContext.broadcast(Vocabulary(path, pattern))
        self.vocabulary = self._shared[key]

    def encode(self, text: Column) -> Column:
        """``array<int>`` of ids; empty for null and empty texts."""
        shared = self.vocabulary

        @F.arrow_udf("array<int>")
        def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for batch in batches:
                parts = [_lists(*found) for found in shared.value.slices(t.as_py() for t in batch)]
                yield pa.concat_arrays(parts or [pa.array([], type=pa.list_(pa.int32()))])

        return ids(text)

    def decode(self, ids: Column) -> Column:
        """``binary`` of the bytes that the ids stand for."""
        shared = self.vocabulary

        @F.arrow_udf("binary")
        def raw(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for batch in batches:
                yield pa.array([b"".join(shared.value.bytes_of(row.values.to_numpy(zero_copy_only=False) if row.is_valid else np.zeros(0, np.int32))) for row in batch], type=pa.binary())

        return raw(ids)

    def round_trip(self, text: Column) -> Column:
        """``struct<ids:array<int>,decoded:binary>``: both at once, in one worker."""
        shared = self.vocabulary

        @F.arrow_udf("struct<ids:array<int>,decoded:binary>")
        def both(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for batch in batches:
                if not len(batch):
                    yield pa.array([], type=pa.struct([("ids", pa.list_(pa.int32())), ("decoded", pa.binary())]))
                for ids, ends in shared.value.slices(t.as_py() for t in batch):
                    yield pa.StructArray.from_arrays([_lists(ids, ends), shared.value.decoded(ids, ends)], names=["ids", "decoded"])

        return both(text)


def round_trip(docs: DataFrame, tokenizer: Tokenizer, text: str = "text") -> DataFrame:
    """``docs`` with the columns ``ids`` (array<int>) and ``decoded`` (binary), which replace any of those names."""
    name = fresh(docs, "both")
    both = docs.withColumn(name, tokenizer.round_trip(F.col(text)))
    return both.withColumns({c: F.col(name)[c] for c in ("ids", "decoded")}).drop(name)


def digest(docs: DataFrame, tokenizer: Tokenizer, text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_tokens, and SHA-256 of the ids as decimals and of the decoded bytes."""
    ids = F.col("ids")
    return round_trip(docs.select("doc_id", F.col(text).alias("text")), tokenizer).select(
        "doc_id",
        F.size(ids).cast("long").alias("n_tokens"),
        F.sha2(F.array_join(ids.cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
