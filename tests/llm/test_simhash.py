import random

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from triplane.llm import simhash_trie as S
from triplane.llm.components import components


def plain_fingerprint(text, k=3):
    import re

    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall("[^\x20\x09-\x0d]+", low)
    if not w:
        return 0
    sh = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def plain_components(words, budget):
    """Root of each index, by all pairs."""
    root = list(range(len(words)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(words)):
        for j in range(i):
            if (words[i] ^ words[j]).bit_count() <= budget:
                a, b = sorted((top(i), top(j)))
                root[b] = a
    return [top(i) for i in range(len(words))]


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="ab Ä\x1c\x85\n\tZ ", max_size=60))
def test_fingerprint(text):
    assert int(S.simhash(text, 3)[0]) % (1 << 64) == plain_fingerprint(text)


def test_fingerprint_of_a_long_text():
    text = " ".join(random.Random(1).choices(["one", "Two", "three", "four"], k=70_000))
    assert int(S.simhash(text, 3)[0]) % (1 << 64) == plain_fingerprint(text)


def near_words(seed, n):
    r = random.Random(seed)
    centres = [r.getrandbits(64) for _ in range(max(1, n // 12))]
    out = {0, 1, (1 << 64) - 1}
    while len(out) < n:
        w = r.choice(centres)
        for _ in range(r.randrange(5)):
            w ^= 1 << r.randrange(64)
        out.add(w)
    return list(out)


@pytest.mark.parametrize("seed,limit,frontier", [(1, 10**6, 1 << 19), (2, 10**6, 16), (3, 100, 1 << 19), (4, 6, 1 << 19)])
def test_links_against_all_pairs(spark, monkeypatch, seed, limit, frontier):
    monkeypatch.setattr(S, "FRONTIER", frontier)
    words = near_words(seed, 220)
    signed = [w - (1 << 64) if w >> 63 else w for w in words]
    entries = spark.createDataFrame([(0, w, w) for w in signed], "tbl int, node long, word long")
    found = S.links(entries, 64, 2, len(signed), limit=limit)
    pairs = [(a % (1 << 64), b % (1 << 64)) for a, b in found.collect()]
    assert all((a ^ b).bit_count() <= 64 for a, b in pairs)
    index = {w: i for i, w in enumerate(words)}
    root = {index[r.node % (1 << 64)]: r.root for r in components(found, "a", "b").collect()}
    want = plain_components(words, 2)
    for i in range(len(words)):
        for j in range(i):
            together = i in root and j in root and root[i] == root[j]
            assert together == (want[i] == want[j])


def test_walk_finds_every_pair():
    words = np.array(sorted(near_words(5, 150)), dtype=np.uint64)
    got = set()
    for a, b in S._walk(words, np.array([[0, 0, 150, 0, 150, 0]]), 64, 2, np.arange(150)):
        got |= {(min(p), max(p)) for p in zip(a.tolist(), b.tolist(), strict=True)}
    want = {(i, j) for j in range(150) for i in range(j) if (int(words[i]) ^ int(words[j])).bit_count() <= 2}
    assert got == want


def test_digest(spark):
    r = random.Random(3)
    base = [" ".join(r.choices(["alpha", "beta", "gamma", "delta", "eps"], k=r.randrange(0, 9))) for _ in range(60)]
    rows = [(i, t, "x") for i, t in enumerate(base)] + [(100, None, "y"), (101, "", None), (101, "", None), (None, "lone words here now", "z"), (102, " \t", "x")]
    got = {(x.doc_id, x.fingerprint, x.component_id) for x in S.digest(spark.createDataFrame(rows, "doc_id long, text string, word string")).collect()}
    fps = [plain_fingerprint(t) for _, t, _ in rows]
    root = plain_components(fps, 2)
    least = {}
    for (i, _, _), c in zip(rows, root, strict=True):
        least[c] = min((x for x in (least.get(c), i) if x is not None), default=None)
    assert got == {(i, f"{f:016x}", least[c]) for (i, _, _), f, c in zip(rows, fps, root, strict=True)}
    assert S.digest(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def shingles(text, k=5):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))}


def plain_groups(texts):
    """For each text the index of its group's first, by pairs of a similarity of exactly 0.8 or more."""
    sets = [shingles(t) for t in texts]
    root = list(range(len(texts)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]):
                x, y = sorted((top(i), top(j)))
                root[y] = x
    return [top(i) for i in range(len(texts))]


@pytest.mark.parametrize("part,limit", [(S.PART, 8 * S.LIMIT), (8, 40)])
def test_exactly_the_similar_texts_link(spark, part, limit):
    r = random.Random(11)
    word = lambda: "".join(r.choices("abcdefghijklmnop", k=5))
    rows = []
    for _ in range(12):  # four shingles and five: 0.8 exactly
        t = [word() for _ in range(8)]
        rows += [" ".join(t), " ".join([*t, word()])]
    for n in (60, 200, 400):
        for changed in range(1, 20):  # on both sides of 0.8
            t = [word() for _ in range(n)]
            u = list(t)
            for at in r.sample(range(n), min(changed * n // 200 + 1, n)):
                u[at] = word()
            rows += [" ".join(t), " ".join(u)]
    for _ in range(8):  # a repeated line counts once
        a, b, line = ([word() for _ in range(n)] for n in (40, 40, 12))
        rows += [" ".join(a + line * 40), " ".join(b + line * 40)]
    crowd = [word() for _ in range(80)]
    for _ in range(60):
        u = list(crowd)
        for at in r.sample(range(80), r.randrange(1, 4)):
            u[at] = word()
        rows.append(" ".join(u))
    chain = [word() for _ in range(100)]
    for _ in range(30):  # each is like the one before, few like the first
        chain = chain[4:] + [word() for _ in range(4)]
        rows.append(" ".join(chain))
    rows += ["", None, "  ", "one", "one two", "One  two"]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    want = plain_groups(rows)
    assert {x.key: x.first.key for x in S.similar(docs, part=part, limit=limit).select("key", "first").collect()} == dict(enumerate(want))
    assert sorted(x.doc_id for x in S.drop_similar(docs, part=part, limit=limit).collect()) == sorted(set(want))


def test_rows_are_told_apart_by_id_and_text(spark):
    """Unlike texts with equal ids or none are documents of their own; copies are not."""
    r = random.Random(4)
    long = " ".join("".join(r.choices("abcdefgh", k=5)) for _ in range(200))
    rows = [(None, "first without an id", "a", 1), (None, "second without an id", "b", 2), (7, "one text of seven", "c", 3), (7, "quite another one", "d", 4)]
    rows += [(8, long, "e", 5), (8, long, "e", 5), (8, long, "f", 6), (None, long, "g", 7), (9, long + " more", "h", 8), (3, "", None, None), (None, None, "i", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, similar_key string, first long")
    kept = S.drop_similar(docs)
    assert kept.columns == docs.columns
    got = kept.collect()
    assert sorted((x.text or "") for x in got) == sorted(["", *(t for _, t, _, _ in rows[:4]), long])
    assert {x.doc_id for x in got if x.text == long} == {8} and {x.doc_id for x in got if not x.text} == {3}
    assert sorted(map(str, S.drop_similar(docs).collect())) == sorted(map(str, got))
    assert S.drop_similar(docs.limit(0)).count() == 0


def test_tries_follow_the_number_of_texts():
    for n in (0, 1, 10**5, 10**7, 10**10):
        width, count = S.tries(n, 0.8)
        p = S.bit_share(0.8)
        met = (1 - p) ** width + width * p * (1 - p) ** (width - 1) + width * (width - 1) / 2 * p**2 * (1 - p) ** (width - 2)
        assert (1 - met) ** count <= S.MISSED and 2**width >= n


def test_entries_grow_evenly_with_the_number_of_texts():
    """No size at which the work of an entry's trie jumps; pairs of just 0.8 meet at any."""
    p, before = S.bit_share(0.8), None
    for k in range(10, 34):
        n = 2**k + 1
        exact = S.exact_bits(n, 8 * S.LIMIT)
        width, count = S.tries(n, 0.8, exact=exact)
        rest = width - exact
        met = (1 - p) ** exact * ((1 - p) ** rest + rest * p * (1 - p) ** (rest - 1) + rest * (rest - 1) / 2 * p**2 * (1 - p) ** (rest - 2))
        assert (1 - met) ** count <= S.MISSED and n >> exact <= 4 * S.LIMIT
        assert before is None or count <= 1.25 * before
        before = count


@pytest.mark.parametrize("exact", [0, 1, 5])
def test_links_with_equal_first_bits(spark, exact):
    words = near_words(9, 200)
    signed = [w - (1 << 64) if w >> 63 else w for w in words]
    entries = spark.createDataFrame([(t, w, w) for w in signed for t in (0, 1)], "tbl int, node long, word long")
    found = components(S.links(entries, 64, 2, len(signed), limit=30, exact=exact), "a", "b")
    root = {r.node % (1 << 64): r.root for r in found.collect()}
    label = np.arange(len(words))
    for i in range(len(words)):
        for j in range(i):
            if (words[i] ^ words[j]).bit_count() <= 2 and (words[i] ^ words[j]) >> (64 - exact) == 0:
                label[label == label[i]] = label[j]
    for i in range(len(words)):
        for j in range(i):
            a, b = root.get(words[i]), root.get(words[j])
            assert (a is not None and a == b) == (label[i] == label[j])


def test_components_of_a_long_path(spark):
    edges = [(i, i + 1) for i in range(0, 200)] + [(500, 600), (600, 700), (7000, 7000), (None, 3)]
    got = {(x.node, x.root) for x in components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {(i, 0) for i in range(201)} | {(500, 500), (600, 500), (700, 500)}
