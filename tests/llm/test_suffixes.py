import random
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from triplane.llm import suffix_sparse as S


def named(rows):
    """(document, id, text): rows without an id are documents of their own."""
    return [(("none", n) if i is None else i, i, t or "") for n, (i, t) in enumerate(rows)]


def brute(rows):
    """{(id, text): words within a 50-word run that another document has too}."""
    owners = defaultdict(set)
    words = [(doc, i, t, t.encode().split()) for doc, i, t in named(rows)]
    for doc, _, _, w in words:
        for at in range(len(w) - S.LENGTH + 1):
            owners[tuple(w[at : at + S.LENGTH])].add(doc)
    out = defaultdict(set)
    for _, i, t, w in words:
        for at in range(len(w) - S.LENGTH + 1):
            if len(owners[tuple(w[at : at + S.LENGTH])]) > 1:
                out[i, t] |= set(range(at, at + S.LENGTH))
    return out


def stretches(words):
    """Runs of consecutive numbers: (first, how many)."""
    out = []
    for w in sorted(words):
        if out and w == out[-1][0] + out[-1][1]:
            out[-1] = (out[-1][0], out[-1][1] + 1)
        else:
            out.append((w, 1))
    return out


def check(spark, rows):
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, key string")
    got = sorted(((r.doc_id, r.first_word, r.n_words) for r in S.passages(docs).collect()), key=str)
    # passages that touch are one
    assert got == sorted(((i, *x) for (i, _), own in brute(rows).items() for x in stretches(own)), key=str)


def test_windows_choose_alike():
    r = np.random.default_rng(1)
    h = r.integers(0, 1 << 63, 400).astype(np.uint64)
    kept = set(S.kept_suffixes(h).tolist())
    assert all(kept & set(range(at, at + S.WINDOW)) for at in range(len(h) - S.GRAM - S.WINDOW + 2))
    inner = S.kept_suffixes(h[100:200]) + 100
    assert set(inner.tolist()) <= kept


def test_against_all_runs(spark):
    r = random.Random(7)
    word = lambda: "".join(r.choices("abcdefghij", k=4))
    passages = [[word() for _ in range(n)] for n in (49, 50, 51, 60, 130, 400)]
    hot = [word() for _ in range(70)]
    rows = []
    for i in range(60):
        t = [word() for _ in range(r.randrange(0, 120))]
        for _ in range(r.randrange(0, 3)):
            t += r.choice(passages) + [word() for _ in range(r.randrange(0, 90))]
        if i % 2:
            t = hot + t
        rows.append((i, r.choice([" ", "\n", "  "]).join(t)))
    rows += [(100, "same " * 300), (101, "again " * 300), (102, "again " * 300), (103, None), (104, ""), (None, " ".join(hot))]
    rows += [(200, rows[3][1]), (201, rows[3][1])]
    rows += [(None, rows[5][1]), (None, "x " + rows[7][1]), (None, "x " + rows[7][1]), (None, None), (None, " ".join(f"u{i}" for i in range(90)))]
    rows += [(3, "another " + rows[4][1]), (3, rows[3][1]), (3, rows[3][1])]  # one id with two texts, and a row twice
    check(spark, rows)


def test_rows_without_an_id_are_partners(spark):
    t = " ".join(f"w{i}" for i in range(60))
    check(spark, [(1, t), (None, t)])
    check(spark, [(None, "a " + t), (None, "b " + t)])
    check(spark, [(None, t), (None, t), (5, "else")])


@pytest.mark.parametrize("crowd", [0, 30])
def test_crowds_are_found_by_their_runs(spark, monkeypatch, crowd):
    """The exact way for hashes that many contexts share finds the same."""
    monkeypatch.setattr(S, "CROWD", crowd)
    test_against_all_runs(spark)


def test_sorted_neighbours_give_every_run():
    """Against a comparison of all contexts, where matches go back and on by different lengths."""
    r = np.random.default_rng(4)
    n = 300
    back = r.integers(0, S.WINDOW, n)
    ahead = S.LENGTH - S.AHEAD
    long = r.integers(0, ahead + 1, n)
    key = r.integers(0, 4, n)
    base = r.integers(1, 1 << 40, (4, 200))
    words = []
    for k, b, m in zip(key, back, long):
        w = np.concatenate([base[k][100 - b : 100], base[k][100 : 100 + m]])
        if r.random() < 0.7:
            w[: r.integers(0, b + 1)] = r.integers(1, 3)
        if r.random() < 0.7:
            w[b + r.integers(0, m + 1) :] = r.integers(1, 3)
        words.append(w)
    least = r.integers(0, 6, n)
    most = np.maximum(least, r.integers(0, 6, n))
    got = set(zip(*(x.tolist() for x in S.shared_runs(key, back, words, least, most))))
    runs = defaultdict(list)
    for i in range(n):
        for b in range(S.WINDOW):
            at = back[i] - b
            if at >= 0 and len(words[i]) >= at + ahead:
                runs[b, key[i], tuple(words[i][at : at + ahead])].append(i)
    want = set()
    for (b, *_), own in runs.items():
        first, last = min(least[i] for i in own), max(most[i] for i in own)
        if first != last:
            want |= {(i, b, first) for i in own}
    assert got == want and len(want) > 100


def test_repeats_within_one_document_do_not_count(spark):
    t = " ".join(f"w{i}" for i in range(60))
    check(spark, [(1, t + " " + t), (2, "other words"), (1, t)])


def test_contexts_without_a_shared_run(spark):
    """Forty words in common are looked at, and are too few."""
    t = " ".join(f"w{i}" for i in range(40))
    check(spark, [(k, " ".join(f"{k}a{i}" for i in range(30)) + " " + t + " " + " ".join(f"{k}b{i}" for i in range(30))) for k in range(5)])


def test_given_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    check(spark, [(r.doc_id, r.text) for r in docs.collect()])
    assert S.passages(docs.limit(0)).count() == 0


def kept_words(rows):
    """Words of each document that stay: those in no 50-word run that an earlier document has too; those without an id come last, by the hash of the text."""
    first = {}
    words = [(doc, i, (t or "").split()) for doc, i, t in named(rows)]
    order = lambda x: (x[1] is None, x[1] if x[1] is not None else xxh(" ".join(x[2])), x[0][1] if x[1] is None else 0)
    for doc, _, w in sorted(words, key=order):
        for at in range(len(w) - S.LENGTH + 1):
            first.setdefault(tuple(w[at : at + S.LENGTH]), doc)
    out = []
    for doc, _, w in words:
        gone = set()
        for at in range(len(w) - S.LENGTH + 1):
            if first[tuple(w[at : at + S.LENGTH])] != doc:
                gone |= set(range(at, at + S.LENGTH))
        out.append([x for k, x in enumerate(w) if k not in gone])
    return out


def xxh(text):
    h = xxhash.xxh64_intdigest(text.encode(), seed=42)
    return h - (1 << 64) if h >= 1 << 63 else h


def test_all_copies_but_one_go(spark):
    r = random.Random(3)
    word = lambda: "".join(r.choices("abcdé", k=5))
    shared = [[word() for _ in range(n)] for n in (50, 70, 200)]
    rows = []
    for i in range(30):
        t = [word() for _ in range(r.randrange(0, 60))]
        for _ in range(r.randrange(0, 3)):
            t += r.choice(shared) + [word() for _ in range(r.randrange(0, 30))]
        rows.append((50 - i, r.choice([" ", "\n"]).join(t)))
    rows += [(None, " ".join(shared[0])), (None, "q " + " ".join(shared[1])), (None, None), (7, rows[2][1]), (90, rows[2][1]), (91, None), (92, "")]
    docs = spark.createDataFrame([(i, t, str(n)) for n, (i, t) in enumerate(rows)], "doc_id long, text string, repeats_id string")
    out = S.without_repeats(docs)
    assert out.columns == docs.columns
    got = {int(x.repeats_id): x.text for x in out.collect()}
    assert [(got[n] or "").split() for n in range(len(rows))] == kept_words(rows)
    assert got[0] == rows[0][1] or len(got[0]) < len(rows[0][1])
    assert S.without_repeats(docs.limit(0)).count() == 0


def test_families_with_longer_common_starts(spark):
    """Thirty families share 40 words; two documents of each also the 12 words before."""
    r = random.Random(9)
    word = lambda: "".join(r.choices("abcdefghij", k=6))
    rows = []
    for f in range(30):
        body, start = [word() for _ in range(40)], [word() for _ in range(12)]
        for k in range(20):
            rows.append((100 * f + k, " ".join([word() for _ in range(30)] + (start if k < 2 else []) + body + [word() for _ in range(30)])))
    check(spark, rows)


def test_of_nameless_copies_one_keeps_its_words(spark):
    t = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(None, t, "a"), (None, t, "b"), (None, t, "c"), (None, "short", "d")], "doc_id long, text string, row string")
    got = sorted(len((r.text or "").split()) for r in S.without_repeats(docs).collect())
    assert got == [0, 0, 1, 60]


@pytest.mark.parametrize("slots", [1, 1 << 20])
def test_only_texts_with_places_are_shuffled(spark, monkeypatch, slots):
    """Whatever share of the slots is taken, the result is the same; texts of other slots stay out of the join."""
    monkeypatch.setattr(S, "SLOTS", slots)
    rng = random.Random(5)
    words = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    shared = words(70)
    rows = [(i, words(80)) for i in range(20)] + [(50, f"{words(9)} {shared}"), (51, f"{shared} {words(9)}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    given, joined = S._contexts, []

    def seen(docs, places):
        out = given(docs, places)
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        joined.append("LeftSemi" in plan)
        return out

    monkeypatch.setattr(S, "_contexts", seen)
    got = {(r.doc_id, r.first_word, r.n_words) for r in S.passages(docs).collect()}
    assert got == {(50, 9, 70), (51, 0, 70)}
    assert joined == [True]
