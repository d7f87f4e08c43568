import base64
import hashlib
import random
from collections import Counter

import pytest

import corpus_pipeline as C
from test_lines import brute as plain_lines
from test_simhash import plain_groups
from triplane.llm import quality_mil

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """Input and output rows of each stage."""
    base = tmp_path_factory.mktemp("pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs.collect()]
    for name, stage in C.STAGES:
        stage(spark, docs, SF).write.parquet(str(base / name))
        docs = spark.read.parquet(str(base / name))
        out.append(docs.collect())
    return out


def test_columns(steps):
    for rows in steps[:5]:
        assert list(rows[0].asDict()) == ["doc_id", "text", "lang", "source", "n_chars"]


def test_quality_keeps_rows_as_they_are(steps):
    before, after = set(steps[0]), set(steps[1])
    assert after < before and len(after) > 0.7 * len(before)


def test_lines_only_lose_lines(steps):
    before, after = ({r.doc_id: r.text for r in rows} for rows in steps[1:3])
    assert before.keys() == after.keys()
    for i, t in after.items():
        rest = iter(before[i].split("\n"))
        assert t == "" or all(line in rest for line in t.split("\n"))


def test_near_duplicates_against_all_pairs(steps):
    before = sorted(steps[2], key=lambda r: r.doc_id)
    root = plain_groups([r.text for r in before])
    assert {r.doc_id for r in steps[3]} == {before[i].doc_id for i in set(root)}


def test_mixing_repeats_whole_documents(steps):
    before, after = Counter(steps[3]), Counter(steps[4])
    assert after.keys() <= before.keys() and max(after.values()) <= 2


def library():
    import public_tokenizers as P
    import tiktoken

    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def check_tokens(before, after):
    lib, want = library(), Counter()
    for r in before:
        ids = lib.encode_ordinary(r.text or "")
        want[(r.doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256) for r in after) == want


def test_tokens_match_the_library(steps):
    check_tokens(steps[4], steps[5])


WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()


def odd_rows():
    """Nulls in each column, empty and long texts, ties, repeated rows."""
    r = random.Random(8)
    text = lambda n: " ".join(r.choice(WORDS) + r.choice(WORDS) for _ in range(n))
    same, long = text(60), text(12_000)
    rows = [(i, text(40 + i) + "\nThe same line in many documents\n" + text(3), r.choice(["en", None]), r.choice(["a", "b", "c", None]), 10) for i in range(40)]
    rows += [(100, same, "en", "a", 1), (101, same, "de", "b", None), (101, same, "de", "b", None), (102, same + " more", "en", None, 1)]
    rows += [(None, text(30), "en", "a", 1), (None, text(31), None, None, None), (103, text(20), "en", "c", 1), (103, text(21), "en", "c", 1)]
    rows += [(104, None, "en", "a", None), (105, "", "en", "b", 0), (106, " \n\t", None, "b", 3), (107, long, "en", "a", 1), (108, long + " end", "en", "b", 1)]
    return rows


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("odd")
    rows = odd_rows()
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, kind).write.parquet(str(base / "documents.parquet"))
    labels = [(i, int(i % 5 > 0), 0) for i in range(40)] + [(None, 1, 0), (104, None, None), (105, 1, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(base / "labels.parquet"))
    return str(base)


def test_odd_documents_through_all_stages(spark, odd):
    """Each stage against a brute-force version over its own input."""
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    model = quality_mil.train(docs, spark.read.parquet(f"{odd}/labels.parquet"))
    score = dict(zip(docs.collect(), model.score([r.text for r in docs.collect()]), strict=True))
    key = lambda r: tuple((v is None, v) for v in r)
    kept = C.quality(spark, docs, odd).collect()
    assert sorted(kept, key=key) == sorted((r for r in docs.collect() if score[r] >= 0.5), key=key) and kept

    whole = docs.collect()
    lines = C.lines(spark, docs, odd)
    want = plain_lines([(r.doc_id, r.text, n) for n, r in enumerate(whole)])
    assert Counter((r.doc_id, r.lang, r.source, r.n_chars, r.text) for r in lines.collect()) == Counter((r.doc_id, r.lang, r.source, r.n_chars, t) for r, t in zip(whole, want, strict=True))

    near = C.near_duplicates(spark, docs, odd)
    root = plain_groups([r.text for r in whole])
    assert Counter(root[whole.index(r)] for r in near.collect()) == Counter(set(root))
    assert sorted(map(str, near.collect())) == sorted(map(str, C.near_duplicates(spark, docs, odd).collect()))

    mixed = Counter(C.mixing_to_weights(spark, docs, odd).collect())
    assert set(mixed) <= set(whole) and all(n <= 2 * whole.count(r) for r, n in mixed.items())
    check_tokens(whole, C.tokens(spark, docs, odd).collect())
    assert C.run(spark, odd).count() > 0


def test_no_documents(spark, odd, tmp_path):
    spark.read.parquet(f"{odd}/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{odd}/labels.parquet").limit(0).write.parquet(str(tmp_path / "labels.parquet"))
    assert C.run(spark, str(tmp_path)).count() == 0


def test_stages_keep_other_columns(spark, odd):
    docs = spark.read.parquet(f"{odd}/documents.parquet").selectExpr("*", "doc_id AS score", "text AS hash", "lang AS key", "source AS line_drop", "n_chars AS mix_own", "lang AS similar_key", "text AS both")
    for name, stage in C.STAGES[:-1]:
        assert stage(spark, docs, odd).columns == docs.columns, name
        assert stage(spark, docs, odd).count() > 0
