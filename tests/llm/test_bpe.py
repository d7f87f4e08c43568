import base64
import hashlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from triplane.llm import bpe_twotier as B

PATH = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def vocabulary():
    return B.Vocabulary(PATH, P.PATTERN)


def test_perfect_hash_is_minimal_and_perfect(vocabulary):
    h = vocabulary.hash
    assert sorted(h.slots) == list(range(len(vocabulary.keys)))
    assert h.find(B.hashes(vocabulary.keys)).tolist() == list(range(len(vocabulary.keys)))


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text_encodes_as_the_library_does(text):
    v, lib = _both()
    assert v.encode(text).tolist() == lib.encode_ordinary(text)


_BOTH = []


def _both():
    if not _BOTH:
        with open(PATH, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _BOTH.extend([B.Vocabulary(PATH, P.PATTERN), tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})])
    return _BOTH


@pytest.mark.parametrize(
    "text",
    ["", " ", "\n\n  \t x", "don't we'll I'M", "aaaa" * 3000, "é" * 500, "x²y ½ \x1c\x1d z", "日本語 テキスト 123", "a_b __c__", "   a", "<|endoftext|>", "🙂🙂 ok", "1234567 12.5%"],
)
def test_awkward_texts(vocabulary, library, text):
    assert vocabulary.encode(text).tolist() == library.encode_ordinary(text)


def test_memory_stays_bounded(vocabulary, library, monkeypatch):
    monkeypatch.setattr(B, "MEMO_BYTES", 3000)
    vocabulary.memory = B.Memory()
    text = " ".join(f"xqzv{chr(97 + i % 26)}{chr(97 + i // 26)}kjwv" for i in range(100))
    for n in range(300):
        own = text.replace("x", chr(97 + n % 26))
        assert vocabulary.encode(own).tolist() == library.encode_ordinary(own)
        assert vocabulary.memory.nbytes() <= 3000 + 100 * 60


def test_equal_hashes_are_told_apart(vocabulary, library):
    """What is remembered under a hash is compared with the pre-token."""
    vocabulary.memory = B.Memory()
    own = [" zqxjvk", " qqzzxx", " kzkzkz"]
    vocabulary.memory.add(B.hashes([t.encode() for t in own]), np.array([1, 1, 2]), np.array([5, 6, 7, 8], dtype=np.int32))
    assert vocabulary.encode("".join(own)).tolist() == library.encode_ordinary("".join(own))


def test_slices_and_windows_change_nothing(vocabulary, library, monkeypatch):
    monkeypatch.setattr(B, "SLICE", 60)
    monkeypatch.setattr(B, "WINDOW", 7)
    texts = ["", None, "some words here", "a" * 59, "long text of many words, " * 40, "日本語 テキスト " * 30, "x", ""]
    out = [(ids[a:b].tolist(), raw) for ids, ends in vocabulary.slices(iter(texts)) for a, b, raw in zip([0, *ends[:-1]], ends, vocabulary.decoded(ids, ends).to_pylist(), strict=True)]
    assert out == [(library.encode_ordinary(t or ""), (t or "").encode()) for t in texts]


def test_digest_on_spark(spark, library):
    rows = [(1, "Hello  world", "x"), (2, None, "x"), (3, "", None), (4, "Hello  world", "y"), (None, "é ü\n", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in B.digest(docs, B.Tokenizer(spark, PATH, P.PATTERN)).collect()}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = set()
    for i, t, _ in rows:
        ids = library.encode_ordinary(t or "")
        want.add((i, len(ids), sha(" ".join(map(str, ids)).encode()), sha((t or "").encode())))
    assert got == want


def test_no_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert B.digest(docs, B.Tokenizer(spark, PATH, P.PATTERN)).count() == 0


def test_encode_and_decode_columns(spark, library):
    docs = spark.createDataFrame([(1, "Hello  world"), (2, None), (3, "é" * 20)], "both long, text string")
    t = B.Tokenizer(spark, PATH, P.PATTERN)
    got = docs.withColumn("ids", t.encode(docs.text)).withColumn("raw", t.decode("ids")).collect()
    assert [(r.both, r.ids, bytes(r.raw)) for r in got] == [(i, library.encode_ordinary(x or ""), (x or "").encode()) for i, x in docs.collect()]
    assert {c: [getattr(r, c) for r in B.round_trip(docs, t).collect()] for c in ("both", "ids")} == {"both": [1, 2, 3], "ids": [r.ids for r in got]}
    assert [r.raw for r in docs.limit(1).select(t.decode(F.lit(None).cast("array<int>")).alias("raw")).collect()] == [b""]
