import zlib

import numpy as np
import pytest

from triplane.llm import quality_mil as Q

SF = "/root/testdata/sf0.01"


def test_passages_are_the_whole_text():
    for text in ("", "a", "x" * 5000, "word " * 3000, "\n" * 2500):
        assert "".join(Q.passages(text)) == text


def test_gradient_against_differences():
    r = np.random.default_rng(1)
    sizes, label = np.array([1, 3, 2]), np.array([1.0, 0.0, 1.0])
    x = r.normal(size=(6, Q.FEATURES))
    w = {k: r.normal(0, 0.5, v) for k, v in {"W": (Q.FEATURES, 4), "b": 4, "V": (4, 3), "U": (4, 3), "a": 3, "c": 4, "d": ()}.items()}
    model = Q.Model(np.zeros(Q.FEATURES), np.ones(Q.FEATURES), {k: np.array(v) for k, v in w.items()})

    def loss():
        s = model.forward(x, sizes)["score"]
        return -np.mean(label * np.log(s) + (1 - label) * np.log(1 - s))

    for k, g in model.gradient(x, sizes, label).items():
        at = tuple(0 for _ in np.shape(model.weights[k]))
        keep = model.weights[k][at]
        model.weights[k][at] = keep + 1e-5
        up = loss()
        model.weights[k][at] = keep - 1e-5
        down = loss()
        model.weights[k][at] = keep
        assert (up - down) / 2e-5 == pytest.approx(np.asarray(g)[at], abs=1e-6)


def test_attention_finds_the_passage_that_decides():
    r = np.random.default_rng(2)
    sizes = np.full(400, 6)
    x = r.normal(size=(2400, Q.FEATURES))
    label = (np.arange(400) % 2).astype(float)
    x[np.arange(0, 2400, 6)[label == 0], 0] += 9  # one passage of six
    model = Q.fit(x, sizes, label)
    out = model.forward(x, sizes)
    assert ((out["score"] >= 0.5) == (label == 1)).mean() > 0.97


def test_attention_decides_on_a_table(spark):
    """One passage of nine makes a document bad: uniform weights can't tell, learned ones can."""
    r = np.random.default_rng(5)
    word = lambda letters: "".join(r.choice(list(letters), 5))
    part = lambda letters: " ".join(word(letters) for _ in range(180))[:1000].ljust(1000, "x") + " "
    docs, labels = [], []
    for i in range(600):
        parts = [part("abcdefgh" if r.random() < 0.5 else "efghijkl") for _ in range(9)]
        if i % 2:
            parts[r.integers(9)] = part("abcdijkl")
        docs.append((i, "".join(parts)))
        labels.append((i, 1 - i % 2))
    docs, labels = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")
    model = Q.train(docs, labels)
    rows = [x for x in docs.collect() if zlib.crc32(str(x.doc_id).encode()) % 3 == 1]
    truth = np.array([1 - x.doc_id % 2 for x in rows])
    texts = [x.text for x in rows]
    right = lambda m: ((m.score(texts) >= 0.5) == truth).mean()
    learned = right(model)
    weight = model.forward(*Q.encode_batch(texts))["attention"]
    model.weights["a"] = np.zeros_like(model.weights["a"])
    assert learned > 0.93 and right(model) < learned - 0.1 and weight.max() > 3 / 9


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    got = {r.doc_id: r for r in Q.digest(docs, labels).collect()}
    assert len(got) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items())
    truth = [(got[r.doc_id].predicted, r.quality) for r in labels.collect() if got[r.doc_id].held_out]
    assert np.mean([a == b for a, b in truth]) > 0.95
    kept = Q.accepted(docs, labels)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.predicted}


def test_repeated_ids_are_learned_once(spark):
    docs = spark.createDataFrame([(1, "good words here")] * 50 + [(1, "zz")] * 50 + [(3, "bad bad bad")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 1), (3, 0)], "doc_id long, quality int")
    once = spark.createDataFrame([(1, "good words here"), (3, "bad bad bad")], "doc_id long, text string")
    a, b = Q.train(docs, labels), Q.train(once, labels)
    assert a.score(["good words here", None]).tolist() == b.score(["good words here", None]).tolist()


def test_awkward_rows(spark):
    docs = spark.createDataFrame([(1, None, 0.1), (2, "", 0.2), (2, "", 0.2), (None, "some text", None), (3, "y " * 40_000, 0.3)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, None), (None, 1)], "doc_id long, quality int")
    assert Q.accepted(docs, labels).columns == docs.columns
    rows = Q.digest(docs, labels).collect()
    assert len(rows) == 5 and all(0 <= r.score <= 1 for r in rows)
    assert Q.digest(docs, labels.limit(0)).where("score = 0.5").count() == 5
    assert Q.digest(docs.limit(0), labels).count() == 0


def test_the_sample_is_bounded_by_passages(spark, monkeypatch):
    """Whole documents, in the order of their hashes; one that is too long is passed over and ends nothing."""
    monkeypatch.setattr(Q, "PASSAGES", 30)
    monkeypatch.setattr(Q, "LONGEST", 12)
    seen = []
    monkeypatch.setattr(Q, "fit", lambda x, sizes, label: seen.append(sizes.tolist()))
    ids = [i for i in range(60) if zlib.crc32(str(i).encode()) % 3 != 1]
    docs = spark.createDataFrame([(i, "word " * (200 * (1 + i % 5) if i % 7 else 20_000)) for i in ids] + [(ids[1], None)], "doc_id long, text string")
    Q.train(docs, spark.createDataFrame([(i, i % 2) for i in ids], "doc_id long, quality int"))
    assert 20 <= sum(seen[0]) <= 36 and max(seen[0]) <= 6 and len(seen[0]) > 5
