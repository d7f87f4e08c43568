import gzip
import hashlib
from functools import reduce

import numpy as np
import pytest
from pyspark.sql import functions as F

from triplane import catalog
from triplane.functions import terms as T
from triplane.operators import ordinal, prior, profile, rgcn, sample, store, strata, train, vocab
from triplane.operators import rank as R
from triplane.operators.sums import summed_vectors
from triplane.plans import fixtures as X
from triplane.sources import readers, sinks
from triplane.streaming import ingest


def triples(spark, rows):
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "head string, relation string, tail string, pos long")


def test_ids_by_first_appearance(spark):
    t = triples(spark, [("a", "p", "b"), ("c", "q", "a"), ("a", "p", "b")])
    e, r = vocab.entity_vocab(t), vocab.relation_vocab(t)
    assert {x.entity: x.id for x in e.collect()} == {"a": 0, "b": 1, "c": 2}
    assert {x.relation: x.id for x in r.collect()} == {"p": 0, "q": 1}
    got = vocab.index_triples(t, e, r).orderBy("pos").select("head_id", "relation_id", "tail_id").collect()
    assert [tuple(x) for x in got] == [(0, 0, 1), (2, 1, 0), (0, 0, 1)]
    with pytest.raises(Exception, match="no id"):
        vocab.index_triples(t, e.where("id > 0"), r).collect()


@pytest.mark.parametrize("parts", [1, 4, 16])
def test_numbers_do_not_depend_on_partitions(spark, parts):
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        df = spark.range(1000).select(F.hash("id").alias("h"), "id").repartition(parts)
        got = ordinal.dense_numbers(df, ["h", "id"], "n").orderBy("n").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert [r.n for r in got] == list(range(1000)) and [(r.h, r.id) for r in got] == sorted((r.h, r.id) for r in got)


@pytest.mark.parametrize("n,want", [(3, (2, 1)), (295, (236, 59))])
def test_split_sizes(spark, n, want):
    got = {r.part: r["count"] for r in sample.split_exact(spark.range(n).withColumnRenamed("id", "pos"), (0.8,), ("train", "test")).groupBy("part").count().collect()}
    assert (got["train"], got["test"]) == want
    with pytest.raises(ValueError):
        sample.split_exact(spark.range(3).withColumnRenamed("id", "pos"), (0.9, 0.1), ("a", "b", "c"))


@pytest.mark.parametrize("bits", [0, 3, 16])
def test_split_orders_only_the_buckets_that_a_cut_goes_through(spark, monkeypatch, bits):
    monkeypatch.setattr(sample, "BUCKET_BITS", bits)
    rows = spark.range(200).select((F.col("id") % 190).alias("pos"), F.col("id").alias("draw"))  # places may be shared, and any name is free
    parts = sample.split_exact(rows, (0.5, 0.23), ("a", "b", "c"))
    got = sorted((int(hashlib.md5(f"split:42:{x.pos}".encode()).hexdigest()[:8], 16), x.pos, x.part) for x in parts.collect())
    assert [x[2] for x in got] == ["a"] * 100 + ["b"] * 46 + ["c"] * 54 and parts.columns == ["pos", "draw", "part"]
    assert sorted(x.draw for x in parts.collect()) == list(range(200))


def test_parts_of_sums_grow_with_the_rows(spark, monkeypatch):
    monkeypatch.setattr(ordinal, "PART_ROWS", 64)
    t = spark.range(300).select(F.concat(F.lit("h"), F.col("id") % 90).alias("head"), F.lit("p").alias("relation"), F.concat(F.lit("t"), F.col("id") % 7).alias("tail"), F.col("id").alias("pos"), F.when(F.col("id") < 200, "train").otherwise("test").alias("split"))
    found = profile.entity_mentions(t)
    assert found.rdd.getNumPartitions() == 10 and {(x.split, x.entity): x.n for x in found.collect() if x.entity in ("h0", "t6")} == {("train", "h0"): 3, ("test", "h0"): 1, ("train", "t6"): 28, ("test", "t6"): 14}
    assert {x.split: (x.triples, x.relations, x.entities) for x in profile.split_stats(t).collect()} == {"train": (200, 1, 97), "test": (100, 1, 97)}
    edges = spark.createDataFrame([(i % 9, i % 2, None if i == 3 else i % 5) for i in range(300)], "head_id long, relation_id long, tail_id long")
    got = {x.relation_id: (x.n, x.heads, x.tails) for x in sample.bernoulli_stats(edges).collect()}
    assert got == {0: (150, 9, 5), 1: (150, 9, 5)}


def test_negatives_never_keep_the_true_id(spark):
    t = spark.range(500).select(F.col("id").alias("pos"), (F.col("id") % 7).alias("head_id"), (F.col("id") % 3).alias("relation_id"), (F.col("id") % 5).alias("tail_id"))
    both = t.join(sample.uniform_negatives(t, 7, 3).toDF("pos", "h", "r", "t"), "pos").collect()
    for x in both:
        changed = [x.h != x.head_id, x.r != x.relation_id, x.t != x.tail_id]
        assert sum(changed) == 1 and 0 <= x.h < 7 and 0 <= x.r < 3 and 0 <= x.t < 7


def test_readers_and_writers(spark, tmp_path):
    (tmp_path / "t.csv").write_text('pred,sub,obj\np,"a ""x"", b","line\nbreak"\nq,,c\n')
    rows = readers.read_triples_csv(spark, str(tmp_path / "t.csv")).orderBy("pos").collect()
    assert [(r["head"], r.relation, r.tail, r.pos) for r in rows] == [('a "x", b', "p", "line\nbreak", 0), ("", "q", "c", 1)]
    assert readers.read_statements_csv(spark, str(tmp_path / "t.csv")).columns == ["sub", "pred", "obj", "pos"]
    (tmp_path / "bad.csv").write_text("a,b,c\n1,2,3\n")
    with pytest.raises(ValueError):
        readers.read_triples_csv(spark, str(tmp_path / "bad.csv"))
    (tmp_path / "t.tsv").write_text("a\tp\tb\n\n  \nc\tq\t\n")
    assert [(r["head"], r.relation, r.tail, r.pos) for r in readers.read_triples_tsv(spark, str(tmp_path / "t.tsv")).orderBy("pos").collect()] == [("a", "p", "b", 0), ("c", "q", "", 3)]
    (tmp_path / "w.tsv").write_text("\na\tp\n")
    with pytest.raises(Exception, match="line 2: not three fields"):
        readers.read_triples_tsv(spark, str(tmp_path / "w.tsv")).collect()
    assert readers.read_triples_tsv(spark, str(tmp_path / "w.tsv"), strict=False).first().bad
    (tmp_path / "s.csv").write_text('\ufeffinn_number,heavy_chain_sequence,light_chain_sequence\n"""7""", acd ,ef\n7,xyz,\n', encoding="utf-8")
    assert [tuple(r) for r in readers.read_sequences(spark, str(tmp_path / "s.csv")).collect()] == [("7", "XYZ", "")]
    (tmp_path / "d.csv").write_text("relation,id\np,0\nq,1\n")
    assert readers.read_dictionary(spark, str(tmp_path / "d.csv")).count() == 2
    (tmp_path / "i.csv").write_text("tail_id,head_id,relation_id\n3,1,2\n")
    assert tuple(readers.read_indexed(spark, str(tmp_path / "i.csv")).first()) == (1, 2, 3)
    vectors = spark.createDataFrame([(0, [1.0, 2.0]), (1, [3.0, 4.0])], "id long, vec array<double>")
    sinks.write_vectors(vectors, str(tmp_path / "v"))
    assert readers.read_vectors(spark, str(tmp_path / "v"), 2, 2).count() == 2
    with pytest.raises(ValueError):
        readers.read_vectors(spark, str(tmp_path / "v"), 3)
    sinks.write_json(spark.range(1), str(tmp_path / "j"))
    sinks.write_catalog(spark.range(3), str(tmp_path / "c"), "id")
    sinks.write_dictionary(spark.range(3), str(tmp_path / "k"))
    assert spark.read.csv(str(tmp_path / "c"), header=True).count() == 3


@pytest.mark.parametrize("kind", ["csv", "tsv", "nt"])
def test_from_a_file_to_split_ids(spark, tmp_path, kind):
    """File to dictionary, indexed triples and split, as a user does it."""
    rows = [(f"http://x/{'abc'[i % 3]}{i % 11}", f"http://x/p{i % 4}", f"http://x/t{i % 7}") for i in range(100)]
    path = str(tmp_path / f"g.{kind}")
    with open(path, "w") as f:
        if kind == "csv":
            f.write("sub,pred,obj\n")
        for r in rows:
            f.write({"csv": ",".join(r), "tsv": "\t".join(r), "nt": " ".join(f"<{x}>" for x in r) + " ."}[kind] + "\n")
    if kind == "nt":
        t = readers.rdf_triples(readers.read_ntriples(spark, path, dedupe=False))
    else:
        t = (readers.read_triples_csv if kind == "csv" else readers.read_triples_tsv)(spark, path)
    assert [(x["head"], x.relation, x.tail) for x in t.orderBy("pos").collect()] == rows
    e, r = vocab.entity_vocab(t), vocab.relation_vocab(t)
    names, ids = {}, {x.entity: x.id for x in e.collect()}
    for h, _, tail in rows:
        names.setdefault(h, len(names))
        names.setdefault(tail, len(names))
    assert ids == names
    indexed = vocab.check_ids(vocab.index_triples(t, e, r), len(names), 4)
    parts = sample.split_exact(indexed, (0.8,), ("train", "test"))
    assert {x.part: x["count"] for x in parts.groupBy("part").count().collect()} == {"train": 80, "test": 20}
    with pytest.raises(Exception, match="out of range"):
        vocab.check_ids(indexed, len(names) - 1, 4).collect()


def test_files_are_numbered_in_order(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"part-{i}.tsv").write_text("".join(f"h{i}\tp\tt{k}\n" for k in range(4)))
    got = readers.read_triples_tsv(spark, str(tmp_path)).orderBy("pos").collect()
    assert [(r["head"], r.tail, r.pos) for r in got] == [(f"h{i}", f"t{k}", 4 * i + k) for i in range(3) for k in range(4)]


@pytest.mark.parametrize("fmt", ["csv", "tsv"])
def test_compressed_files_are_bounded_and_read_in_order(spark, tmp_path, monkeypatch, fmt):
    """Plain files of triples took ten times the disk."""
    monkeypatch.setattr(sinks, "FILE_ROWS", 7)
    rows = spark.range(200).select(F.concat(F.lit("http://x/h"), F.col("id").cast("string")).alias("head"), F.lit("p").alias("relation"), F.lit('a "b", c').alias("tail"), (F.col("id") * 3).alias("pos"))
    sinks.write_triples(rows.repartition(5), str(tmp_path / "t"), fmt, "gzip")
    files = list((tmp_path / "t").glob("part-*.gz"))
    assert len(files) >= 200 / 7 and all(len(gzip.decompress(f.read_bytes()).splitlines()) <= 8 for f in files)
    read = {"csv": readers.read_triples_csv, "tsv": readers.read_triples_tsv}[fmt](spark, str(tmp_path / "t"))
    got = read.orderBy("pos").collect()
    assert [(r["head"], r.tail, r.pos) for r in got] == [(f"http://x/h{i}", 'a "b", c', i) for i in range(200)]


def test_splits_are_numbered_one_after_the_other(spark, tmp_path, monkeypatch):
    """All rows of the splits went through one more shuffle, in which only blank lines made a difference."""
    sorts, dense = [], readers.dense_numbers
    monkeypatch.setattr(readers, "dense_numbers", lambda *a: sorts.append(1) or dense(*a))
    for blank in ("", "\n"):
        folder = tmp_path / f"blank{len(blank)}"
        folder.mkdir()
        for split, n in (("train", 5), ("valid", 0), ("test", 3)):
            (folder / f"{split}.tsv").write_text(blank.join(f"{split}{k}\tp\tt\n" for k in range(n)))
        got = [(r["head"], r.split, r.split_rank, r.pos) for r in readers.read_splits(spark, str(folder)).orderBy("pos").collect()]
        assert got == [(f"{s}{k}", s, i, 5 * (i > 0) + k) for s, i, n in (("train", 0, 5), ("test", 2, 3)) for k in range(n)]
        assert len(sorts) == len(blank)


def test_literals_long_and_escaped(spark):
    cases = {
        r"tab\there": "tab\there", r"slash\\\\t": "slash\\\\t", r"\u00e9\U0001F600": "é😀", r"\b\f\r\n\'\"": "\b\f\r\n'\"", r"end\\": "end\\", "x" * 300_000: "x" * 300_000,
        r"\"a" * 100_000: '"a' * 100_000,
    }
    lines = [(f'<http://x/a> <http://x/p> "{raw}"@en .', i) for i, raw in enumerate(cases)]
    got = {r.pos: r.obj for r in readers.parse_ntriples(spark.createDataFrame(lines, "line string, pos long")).collect()}
    assert [got[i].lexical for i in range(len(cases))] == list(cases.values()) and got[0].lang == "en"


def test_metadata_with_terms_and_files(spark, tmp_path):
    lines = spark.createDataFrame([("<http://x/a> <http://x/p> _:b .", 0), ('<http://x/a> <http://x/p> "l" .', 1)], "line string, pos long")
    rdf = readers.parse_ntriples(lines)
    row = vocab.metadata(readers.rdf_triples(rdf).withColumn("split", F.lit("train")), 8, dropped=3, kinds=vocab.term_kinds(rdf), files={"entities": "e.csv"}).first()
    assert row.num_dropped == 3 and row.num_train == 2 and row.files == {"entities": "e.csv"}
    assert row.term_counts == {"subject:URI": 2, "predicate:URI": 2, "object:BlankNode": 1, "object:Literal": 1}


def test_metrics_and_tensors(spark, tmp_path):
    history = train.history_table(spark, [{"epoch": 0, "mean_loss": 0.5, "updates": 3}, {"epoch": 1, "mean_loss": 0.25, "updates": 2}])
    evaluation = spark.createDataFrame([(5, 1.5)], "n long, mean_rank double")
    sinks.write_metrics(str(tmp_path / "m"), history, {"dim": 16, "rate": 0.1}, basic=evaluation, subset=evaluation)
    row = spark.read.json(str(tmp_path / "m")).first()
    assert row.config.dim == 16 and [h.mean_loss for h in row.history] == [0.5, 0.25] and row.basic.mean_rank == row.subset.mean_rank == 1.5
    parameters = train.boxe_parameters(spark.range(3), train.BOXE_RELATION, 4)
    sinks.write_tensors(parameters, str(tmp_path / "t"))
    assert {n: readers.read_vectors(spark, str(tmp_path / "t" / n), 3).count() for n in train.BOXE_RELATION} == dict.fromkeys(train.BOXE_RELATION, 3)


def test_report_text_and_json(spark):
    import json

    t = triples(spark, [("imgt:a_1", "p", "imgt:b_1"), ("imgt:a_2", "q", "imgt:a_1")]).withColumn("split", F.lit("train"))
    notes = spark.createDataFrame([("imgt:a_1", "http://www.w3.org/2000/01/rdf-schema#label", "one", 0)], "sub string, pred string, obj string, pos long")
    rows = profile.routed(notes, t)
    of = profile.report_rows(t, profile.entity_dim(t, rows), rows, "a")
    told = json.loads(profile.report(of).first().report)
    assert [x["name"] for x in told["member"]] == ["imgt:a_1", "imgt:a_2"] and told["split"][0]["n"] == 2
    lines = [r.line for r in profile.text_report(of).orderBy("section", "rank", "line").collect()]
    assert lines[0] == "Splits" and "- a: 2 | a|" in "\n".join(lines)


def test_ntriples(spark):
    lines = ['<http://x/a> <http://x/p> "hi"@en .', '_:b0 <http://x/p> "5"^^<http://www.w3.org/2001/XMLSchema#integer> .', '<http://x/a> <http://x/p> "hi"@en .', "# comment", "", '<http://x/a> <http://x/q> "a \\"b\\" <c> ." .', "<http://x/a> <http://x/p> _:b1 ."]
    df = spark.createDataFrame([(x, i) for i, x in enumerate(lines)], "line string, pos long")
    got = {r.pos: r for r in readers.parse_ntriples(df).collect()}
    assert sorted(got) == [0, 1, 5, 6]
    assert (got[0].obj.lexical, got[0].obj.lang, got[1].subj.kind, got[1].obj.datatype[-7:]) == ("hi", "en", "BlankNode", "integer")
    assert got[5].obj.lexical == 'a "b" <c> .' and got[6].obj.kind == "BlankNode"
    with pytest.raises(Exception, match="not a triple"):
        readers.parse_ntriples(spark.createDataFrame([("nonsense", 0)], "line string, pos long")).collect()


@pytest.mark.parametrize("scores,want", [([9, 7, 5], (2, 2)), ([7, 7, 7], (1, 2)), ([9, 7, 7], (2, 2.5))])
def test_rank_ties(spark, scores, want):
    """The true tail is the one scored 7 at index 1."""
    vectors = spark.createDataFrame([(i, [float(s)]) for i, s in enumerate(scores)] + [(10, [1.0])], "id long, vec array<double>")
    tests = spark.createDataFrame([(10, 0, 1)], "head_id long, relation_id long, tail_id long")
    relations = spark.createDataFrame([(0, [1.0])], "id long, vec array<double>")
    r = R.ranks(tests, vectors, relations, scorer=R.dot_score).first()
    assert (r.optimistic, r.realistic) == want


def test_blocked_ranks_equal_the_join(spark):
    rng = np.random.default_rng(1)
    vectors = spark.createDataFrame([(i, rng.integers(-4, 5, 6).tolist()) for i in range(40)], "id long, vec array<bigint>")
    tests = spark.createDataFrame([(i, i % 3, (i * 7) % 40) for i in range(40)], "head_id long, relation_id long, tail_id long")
    relations = vectors.where("id < 3")
    names = ["head_id", "relation_id", "tail_id", "optimistic", "realistic"]
    a, b = R.ranks(tests, vectors, relations, block=7).select(*names), R.ranks_by_join(tests, vectors, relations).select(*names)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


@pytest.mark.parametrize("target", ["head", "relation"])
@pytest.mark.parametrize("scorer", [R.squared_distance, R.city_distance, R.dot_score])
def test_ranks_of_heads_and_relations_against_numpy(spark, target, scorer):
    rng = np.random.default_rng(4)
    x = rng.integers(-4, 5, (30, 5)).astype(float)
    tests = [(i, i % 6, (i * 7) % 30) for i in range(30)]
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")
    got = {(r.head_id, r.relation_id, r.tail_id): (r.better, r.equal) for r in R.ranks(spark.createDataFrame(tests, "head_id long, relation_id long, tail_id long"), vectors, vectors.where("id < 6"), scorer, target, block=7, candidates=11).collect()}
    for h, r, t in tests:
        pool, own = (x, h) if target == "head" else (x[:6], r)
        one = lambda v: scorer(*((v, x[r]) if target == "head" else (x[h], v)), x[t : t + 1])[0, 0]  # noqa: B023, E731
        s = np.array([one(v[None]) if target == "head" else scorer(x[h : h + 1], v[None], x[t : t + 1])[0, 0] for v in pool]) if target == "relation" else np.array([scorer(v[None], x[r : r + 1], x[t : t + 1])[0, 0] for v in pool])
        other = np.arange(len(pool)) != own
        assert got[(h, r, t)] == (int(((s > s[own]) & other).sum()), int(((s == s[own]) & other).sum()))


def test_city_distance_in_tiles(monkeypatch):
    rng = np.random.default_rng(6)
    a, b, c = rng.normal(size=(20, 7)), rng.normal(size=(20, 7)), rng.normal(size=(33, 7))
    want = -np.abs((a + b)[:, None] - c[None]).sum(axis=2)
    for tile in (256, 6):
        monkeypatch.setattr(R, "TILE", tile)
        assert np.allclose(R.city_distance(a, b, c), want)
    assert R.distance_scorer(1) is R.city_distance and R.distance_scorer(2) is R.squared_distance


@pytest.mark.parametrize("name", ["whole", "real", "long", "huge", "boxe"])
@pytest.mark.parametrize("reach,p,tanh", [(0.5, 1, True), (4.0, 2, True), (30.0, 1, False)])
def test_rough_scores_keep_their_bounds_and_counts_are_those_of_the_exact_ones(monkeypatch, name, reach, p, tanh):
    monkeypatch.setattr(R, "STRIPE", (7, 50))
    monkeypatch.setattr(R, "CHUNK", 40)
    rng, n, m, dim = np.random.default_rng(8), 60, 90, 9
    if name == "boxe":
        kernel = R.boxe_kernel(p, tanh)
        known = [rng.uniform(-reach, reach, (n, dim)) for _ in range(2)] + [rng.uniform(-0.5, 0.5, (n, k)) for k in (dim, dim, 1) * 2]
        offered = [rng.uniform(-reach, reach, (m, dim)) for _ in range(2)]
    else:
        kernel, scale = R.city_distance.kernel, {"whole": 100, "real": 1.0, "long": 30_000, "huge": 1e300}[name]
        known, offered = ([rng.normal(0, scale, (k, dim))] for k in (n, m))
        if name in ("whole", "long"):
            known, offered = [np.rint(known[0])], [np.rint(offered[0])]
    offered = [np.concatenate([x, x[:20]]) for x in offered]  # copies are equal, and not better
    ids, sought = np.arange(m + 20), rng.integers(0, m, n)
    s, (rough, off) = kernel.score(known, offered), kernel.rough(known, offered)
    own = kernel.rows(known, [x[sought] for x in offered])
    assert (own == s[np.arange(n), sought]).all()
    if name == "whole":
        assert off is None and rough.dtype == np.int32 and (rough == s).all()
    elif name == "huge":
        assert np.isinf(off).all()
    else:
        assert (np.abs(rough - s) <= off[:, None]).all() and (off < 1e-2 * np.abs(s).mean()).all()
    other = ids[None] != sought[:, None]
    better, equal = kernel.compared(known, own, sought, offered, ids)
    assert (better == ((s > own[:, None]) & other).sum(axis=1)).all() and (equal == ((s == own[:, None]) & other).sum(axis=1)).all() and equal.sum() > 0


def test_cells_are_many_and_bounded():
    assert R._sides(10_000, 10_000, None, None) == (10, 10)
    assert R._sides(600_000, 600_000, None, None) == (30, 30) and R._sides(100, 1000, 7, 11) == (15, 91)


@pytest.mark.parametrize("target,p,tanh", [("tail", 2, True), ("head", 1, True), ("tail", 1, False)])
def test_boxe_ranks_against_scores_of_all_pairs(spark, monkeypatch, target, p, tanh):
    monkeypatch.setattr(R, "TILE", 5)
    e = train.boxe_parameters(spark.range(17), train.BOXE_ENTITY, 4)
    r = train.boxe_parameters(spark.range(3), train.BOXE_RELATION, 4)
    e = e.unionByName(e.where("id < 3").withColumn("id", F.col("id") + 17))  # copies are equal, and not better
    tests = spark.createDataFrame([(i, i % 3, (i * 5 + 1) % 20) for i in range(20)] + [(0, 0, 1)], "head_id long, relation_id long, tail_id long")
    every = spark.range(20).select(F.col("id").alias("other"))
    tries = tests.distinct().crossJoin(every).select(*["head_id", "relation_id", "tail_id"], "other")
    swapped = tries.select(F.col("other").alias("head_id") if target == "head" else "head_id", "relation_id", F.col("other").alias("tail_id") if target == "tail" else "tail_id").distinct()
    score = {tuple(x)[:3]: x.score for x in R.boxe_scores(swapped, e, r, p, tanh).collect()}
    got = R.boxe_ranks(tests, e, r, p, tanh, target, block=6, candidates=8).collect()
    assert len(got) == 21
    for x in got:
        own = score[x.head_id, x.relation_id, x.tail_id]
        others = [score[(i, x.relation_id, x.tail_id) if target == "head" else (x.head_id, x.relation_id, i)] for i in range(20) if i != (x.head_id if target == "head" else x.tail_id)]
        assert x.better == sum(s > own + 1e-12 for s in others) and x.equal == sum(abs(s - own) <= 1e-12 for s in others)


def test_graph_layer_against_numpy(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(5, 4))
    edges = [(0, 0, 1), (2, 0, 1), (3, 1, 1), (1, 1, 4), (0, 1, 4)]
    w, own = rgcn.weights(2, 4, 4, "blocks"), rng.normal(size=(4, 4))
    want = x @ own
    for node in range(5):
        for r in range(2):
            inward = [x[h] for h, q, t in edges if t == node and q == r]
            if inward:
                want[node] += np.mean(inward, axis=0) @ w[r]
    features = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")
    got = {r.id: r.vec for r in rgcn.layer(spark.createDataFrame(edges, "head_id long, relation_id long, tail_id long"), features, w, own, "leaky_relu").collect()}
    want = np.where(want > 0, want, 0.01 * want)
    assert all(np.allclose(got[i], want[i]) for i in range(5))


@pytest.mark.slow
def test_training_lowers_the_loss(spark):
    t = spark.range(60).select(F.col("id").alias("pos"), F.col("id").alias("head_id"), F.lit(0).cast("long").alias("relation_id"), ((F.col("id") + 1) % 60).alias("tail_id"))
    ids = spark.range(60)
    relations = train.random_table(spark.range(2), "r", 8)
    _, _, history = train.train_transe(t, train.random_table(ids, "e", 8), relations, epochs=3, n_batches=1)
    assert len(history) == 3 and history[-1]["mean_loss"] * history[-1]["updates"] < history[0]["mean_loss"] * history[0]["updates"]
    entities, moved, history = train.train_transe(t, train.random_table(ids, "e", 8), relations, epochs=3, n_batches=1, rate=0.05, optimizer="adam", negatives="bernoulli", p=1)
    assert history[-1]["mean_loss"] * history[-1]["updates"] < history[0]["mean_loss"] * history[0]["updates"]
    assert entities.columns == moved.columns == ["id", "vec"] and entities.count() == 60
    e, r = train.boxe_parameters(ids, train.BOXE_ENTITY, 4), train.boxe_parameters(spark.range(2), train.BOXE_RELATION, 4)
    _, _, history = train.train_boxe(t, e, r, epochs=3)
    assert history[-1]["mean_loss"] < history[0]["mean_loss"]


def test_one_step_of_training_against_numpy(spark):
    """One batch of one epoch, from the same negatives."""
    t = spark.range(40).select(F.col("id").alias("pos"), F.col("id").alias("head_id"), (F.col("id") % 2).alias("relation_id"), ((F.col("id") + 1) % 40).alias("tail_id"))
    e, r = train.random_table(spark.range(40), "e", 6), train.random_table(spark.range(2), "r", 6)
    got_e, got_r, history = train.train_transe(t, e, r, epochs=1, n_batches=1, rate=0.1, margin=1.0)
    x = np.array([v.vec for v in e.orderBy("id").collect()], dtype=float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = np.array([v.vec for v in r.orderBy("id").collect()], dtype=float)
    dx, dy, losses = np.zeros_like(x), np.zeros_like(y), []
    wrong = {w.pos: w for w in sample.uniform_negatives(t, 40, 2, seed=0).collect()}
    for w in t.collect():
        n = wrong[w.pos]
        good, bad = x[w.head_id] + y[w.relation_id] - x[w.tail_id], x[n.head_id] + y[n.relation_id] - x[n.tail_id]
        loss = 1.0 + np.linalg.norm(good) - np.linalg.norm(bad)
        if loss > 0:
            losses.append(loss)
            for s, v, q in ((1, good, w), (-1, bad, n)):
                g = s * v / np.linalg.norm(v)
                dx[q.head_id] += g
                dy[q.relation_id] += g
                dx[q.tail_id] -= g
    x -= 0.1 * dx
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    assert np.allclose([v.vec for v in got_e.orderBy("id").collect()], x) and np.allclose([v.vec for v in got_r.orderBy("id").collect()], y - 0.1 * dy)
    assert history[0]["updates"] == len(losses) and history[0]["mean_loss"] == pytest.approx(np.mean(losses))


@pytest.mark.parametrize("parts", [1, 2, 3, 5])
def test_strata_hold_every_task_once_and_share_nothing(parts):
    plan = strata.strata(parts)
    tasks = [t for s in plan for t in s]
    assert sorted(tasks) == sorted((a, b, q) for a in range(2 * parts) for b in range(a, 2 * parts) for q in range(parts))
    for s in plan:
        blocks = [x for a, b, _ in s for x in {a, b}]
        assert len(blocks) == len(set(blocks)) and len({q for *_, q in s}) == len(s)


@pytest.mark.slow
def test_strata_equal_a_plain_loop(spark):
    """The same updates, one after the other: strata in order, tasks in any, triples by their turn."""
    n, parts = 24, 2
    t = ring(spark, n, 3)
    e, r = train.random_table(spark.range(n), "e", 6), train.random_table(spark.range(3), "r", 6)
    got_e, got_r, history = strata.train_in_strata(t, e, r, parts, epochs=2, rate=0.1)
    x = {("e", v.id): np.array(v.vec, dtype=float) for v in e.collect()} | {("r", v.id): np.array(v.vec, dtype=float) for v in r.collect()}
    normal = lambda: x.update({k: v / np.linalg.norm(v) for k, v in x.items() if k[0] == "e"})
    normal()
    for epoch in range(2):
        rows = strata.corrupted(t, n, 3, parts, 0, epoch).collect()
        lost = []
        for s in strata.strata(parts):
            for a, b, q in reversed(s):
                own = [w for w in rows if {w.head_id % (2 * parts), w.tail_id % (2 * parts)} == {a, b} and w.relation_id % parts == q]
                for w in sorted(own, key=lambda w: (w.turn, w.pos)):
                    assert sum(w[c] != w[o] for c, o in zip(strata.TRIPLE[:3], strata.TRIPLE[3:])) == 1
                    lost.append(strata.update(x, tuple(w[c] for c in strata.TRIPLE), 0.1, 1.0))
        normal()
        hit = [v for v in lost if v > 0]
        assert len(lost) == n and history[epoch]["updates"] == len(hit) and history[epoch]["mean_loss"] == pytest.approx(np.mean(hit))
    assert all(np.allclose(v.vec, x["e", v.id], atol=1e-12) for v in got_e.collect()) and all(np.allclose(v.vec, x["r", v.id], atol=1e-12) for v in got_r.collect())
    # the same rate in one batch, whose gradients are all taken at the start, gets less far
    _, _, batch = train.train_transe(t, e, r, epochs=2, n_batches=1, rate=0.1)
    total = lambda h: h["mean_loss"] * h["updates"]
    assert total(history[1]) < total(history[0]) and total(history[1]) / total(history[0]) < total(batch[1]) / total(batch[0]) * 1.2
    with pytest.raises(ValueError, match="too many parts"):
        strata.train_in_strata(t, e, r, 4)


@pytest.mark.parametrize("ends", ["\n", "\r\n"])
def test_quoted_line_breaks_over_blocks(spark, tmp_path, ends):
    """Two files, read in blocks far smaller than some of their records, give what one task per file does."""
    rng = np.random.default_rng(9)
    words = ["a", 'say ""x""', "line\nbreak", "b, c", "", "\n\n", "é" * 30, "long " * 60 + "\n" + "tail " * 60]
    for name in ("one.csv", "two.csv"):
        rows = ["pred,sub,obj"]
        for i in range(300):
            cells = [f"{name}{i}"] + [str(rng.choice(words)) for _ in range(2)]
            rows.append(",".join(f'"{c}"' if c and (rng.random() < 0.3 or any(x in c for x in '",\n')) else c for c in cells))
        (tmp_path / name).write_bytes((ends.join(rows) + (ends if name == "one.csv" else "")).encode())
    read = lambda whole: sorted((r.pos, r.head, r.relation, r.tail) for r in readers.read_triples_csv(spark, str(tmp_path), whole).collect())
    want = read(True)
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 20
        got = read(False)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert [r[0] for r in got] == list(range(600)) and got == want
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "x.csv").write_text('sub,pred,obj\na,"open,c\nd,e,f\n')
    with pytest.raises(Exception, match="stays open"):
        readers.read_triples_csv(spark, str(tmp_path / "bad")).collect()


@pytest.mark.parametrize("bits", [64, 3, 0])
def test_indexed_triples_under_clashes(spark, bits):
    """Fingerprints of few bits clash, and triples then meet by whole terms."""
    rng = np.random.default_rng(2)
    rows = [(f"e{a}", f"p{a % 3}", f"e{b}") for a, b in rng.integers(0, 40, (120, 2))]
    t = triples(spark, rows)
    e, r = vocab.entity_vocab(t), vocab.relation_vocab(t)
    ids, names = ({x[0]: x.id for x in df.collect()} for df in (e, r))
    few = lambda c: tuple(F.pmod(h, F.lit(1 << bits)) if bits < 64 else h for h in vocab.fingerprint(c))
    got = vocab.index_triples(t, e, r, few).orderBy("pos").collect()
    assert [tuple(x)[1:] for x in got] == [(ids[h], names[p], ids[w]) for h, p, w in rows]
    with pytest.raises(Exception, match="no id"):
        vocab.index_triples(t, e.where("id > 0"), r, few).collect()


@pytest.mark.parametrize("at_once", [1 << 25, 50])
def test_triples_are_indexed_in_parts(spark, monkeypatch, at_once):
    """All of them went through two joins at once, with four numbers for two terms."""
    monkeypatch.setattr(vocab, "AT_ONCE", at_once)
    seen, own = [], vocab._indexed
    monkeypatch.setattr(vocab, "_indexed", lambda marked, *a: seen.append(marked) or own(marked, *a))
    rng = np.random.default_rng(3)
    rows = [(f"e{a}", f"p{a % 3}", f"e{b}") for a, b in rng.integers(0, 40, (120, 2))]
    t = triples(spark, rows)
    ids, names = ({x[0]: x.id for x in df.collect()} for df in (vocab.entity_vocab(t), vocab.relation_vocab(t)))
    got, relations = vocab.index_by_own_ids(t, len(rows))
    assert [tuple(x) for x in got.orderBy("pos").collect()] == [(i, ids[h], names[p], ids[w]) for i, (h, p, w) in enumerate(rows)]
    assert {x[0]: x.id for x in relations.collect()} == names and sum(df.count() for df in seen) == len(rows)
    assert len(seen) == max(1, -(-120 // at_once)) and all(df.where("h2 != 0 OR t2 != 0").isEmpty() for df in seen)


def test_sequences_are_encoded_once_and_by_length(spark):
    lengths = np.array([1, 1, 2, 5, 5, 9, 40])
    cuts = prior.batches_by_length(lengths, 10)
    assert [lengths[c].tolist() for c in cuts] == [[1, 1, 2], [5, 5], [9], [40]]
    df = spark.createDataFrame([("a" * n,) for n in (3, 500, 40, 41, 7, 5000)], "sequence string")
    encoder = lambda texts: np.array([[len(x), len(texts) * max(map(len, texts))] for x in texts])
    got = {len(r.sequence): r.vec for r in prior.encode(df, encoder, most=600).collect()}
    assert all(v[0] == n and (v[1] <= 600 or n == 5000) for n, v in got.items()) and len(got) == 6

    def never(texts):
        raise AssertionError(f"encoded again: {texts}")

    known = prior.encoded_by_hash(prior.encode(df, encoder, most=600))
    assert prior.encode(df, never, known=known).count() == 6
    more = df.unionByName(spark.createDataFrame([("b",)], "sequence string"))
    again = prior.encode(more, lambda texts: np.zeros((len(texts), 2)), known=known).collect()
    assert sorted(r.vec[0] for r in again) == [0, 3, 7, 40, 41, 500, 5000]


@pytest.mark.parametrize("scorer", [R.squared_distance, R.city_distance])
def test_ball_ranks_equal_ranks(spark, scorer):
    """Clustered candidates with copies: the same counts, and few pairs scored."""
    rng = np.random.default_rng(7)
    middles = rng.integers(-60, 60, (8, 4))
    x = np.concatenate([middles[rng.integers(0, 8, 200)] + rng.integers(-2, 3, (200, 4)), middles[:2]])
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<bigint>")
    tests = spark.createDataFrame([(i, i % 3, (i * 7) % 202) for i in range(60)], "head_id long, relation_id long, tail_id long")
    names = ["head_id", "relation_id", "tail_id", "better", "equal", "optimistic"]
    relations = vectors.where("id < 3").withColumn("vec", F.transform("vec", lambda v: F.floor(v / 20)))
    got = R.ball_ranks(tests, vectors, relations, scorer, n_balls=12, block=20, candidates=30)
    assert sorted(map(tuple, got.select(*names).collect())) == sorted(map(tuple, R.ranks(tests, vectors, relations, scorer).select(*names).collect()))
    assert got.agg(F.sum("scored")).first()[0] < 0.6 * 60 * 202
    with pytest.raises(ValueError, match="distance"):
        R.ball_ranks(tests, vectors, relations, R.dot_score)


def dense_graph(x, edges, encoder):
    """The encoder's output over whole arrays."""
    for i, w in enumerate(encoder.layers):
        full, z = w.full, x @ w.parts["own"]
        for node in range(len(x)):
            for r in range(len(full)):
                inward = [x[h] for h, q, t in edges if t == node and q == r]
                if inward:
                    z[node] = z[node] + np.mean(inward, axis=0) @ full[r]
        x = np.where(z > 0, z, rgcn.SLOPES[encoder.activation] * z) if i + 1 < len(encoder.layers) else z
    return x


@pytest.mark.parametrize("kind,activation", [("bases", "relu"), ("blocks", "leaky_relu")])
def test_graph_gradients_against_differences(spark, kind, activation):
    rng = np.random.default_rng(8)
    x, c = rng.normal(size=(6, 4)), rng.normal(size=(6, 4))
    edges = [(0, 0, 1), (2, 0, 1), (3, 1, 1), (1, 1, 4), (0, 1, 4), (5, 0, 5), (4, 0, 0)]
    encoder = rgcn.Encoder.drawn(2, 4, 2, activation, kind)
    table = spark.createDataFrame(edges, "head_id long, relation_id long, tail_id long")
    features = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")
    out = {r.id: r.vec for r in encoder.forward(table, features, keep=True).collect()}
    assert all(np.allclose(out[i], v) for i, v in enumerate(dense_graph(x, edges, encoder)))
    slope = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(c)], "id long, grad array<double>")
    back, grads = encoder.backward(table, slope)
    loss = lambda: (dense_graph(x, edges, encoder) * c).sum()

    def differs(array, at):
        old = array[at]
        both = []
        for move in (1e-6, -1e-6):
            array[at] = old + move
            both.append(loss())
        array[at] = old
        return (both[0] - both[1]) / 2e-6

    got = {r.id: r.grad for r in back.collect()}
    for at in [(0, 0), (2, 3), (4, 1), (5, 2)]:
        assert got[at[0]][at[1]] == pytest.approx(differs(x, at), rel=1e-5, abs=1e-7)
    for w, g in zip(encoder.layers, grads):
        for name, own in g.items():
            for at in [tuple(rng.integers(0, n) for n in own.shape) for _ in range(4)]:
                assert own[at] == pytest.approx(differs(w.parts[name], at), rel=1e-5, abs=1e-7), name


@pytest.mark.slow
@pytest.mark.parametrize("decoder", ["transe", "boxe"])
def test_graph_training_lowers_the_loss(spark, decoder):
    t = ring(spark, 20, 2)
    sets = 1 if decoder == "transe" else 2
    features = [train.random_table(spark.range(20), f"x{k}", 4, reach=0.5) for k in range(sets)]
    names = ("vec",) if decoder == "transe" else train.BOXE_RELATION
    relations = train._one(train.boxe_parameters(spark.range(2), names, 4), *names).drop("trial")
    own = train.Settings(decoder, loss="softplus" if decoder == "transe" else "nssa", margin=3.0, rate=0.05, negatives="bernoulli")
    encoders = [rgcn.Encoder.drawn(2, 4, seed=k, dropout=0.0) for k in range(sets)]
    encoded, moved, history = rgcn.train(t, features, relations, encoders, own, epochs=2)
    assert len(encoded) == sets and all(e.count() == 20 for e in encoded) and moved.count() == 2
    assert history[-1]["mean_loss"] < history[0]["mean_loss"]


def test_sums_of_vectors(spark):
    df = spark.createDataFrame([(1, "a", [1.0, 2.0]), (1, "a", [3.0, 4.0]), (2, "a", [5.0, 6.0]), (1, "b", [7.0, 8.0])], "k long, s string, vec array<double>")
    got = {(r.k, r.s): (r.total, r.n) for r in summed_vectors(df, ["k", "s"]).collect()}
    assert got == {(1, "a"): ([4.0, 6.0], 2), (2, "a"): ([5.0, 6.0], 1), (1, "b"): ([7.0, 8.0], 1)}
    assert summed_vectors(df.limit(0), ["k"]).count() == 0


def test_runs_of_a_key_are_added_across_batches(spark):
    rows = spark.range(600).select((F.col("id") % 3).cast("int").alias("trial"), F.when(F.col("id") % 2 == 0, "e").otherwise("r").alias("tbl"), (F.col("id") % 5).alias("id"), F.col("id").cast("double").alias("x"))
    steps = rows.withColumn("grad", F.when(F.col("tbl") == "e", F.array("x", F.lit(1.0))).otherwise(F.array("x", F.lit(1.0), F.lit(2.0)))).select("trial", "tbl", "id", "grad").repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        summed = train.summed(steps)
        got = {(r.trial, r.tbl, r.id): r.grad for r in summed.collect()}
        plan = summed._jdf.queryExecution().toString()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {}
    for i in range(600):
        of = want.setdefault((i % 3, "er"[i % 2], i % 5), [])
        of.append(i)
    assert got == {k: [float(sum(v)), float(len(v)), 2.0 * len(v)][: 2 if k[1] == "e" else 3] for k, v in want.items()}
    assert "MapInPandas" in plan and "AggregateInPandas" not in plan  # no call of Python for each key


def ring(spark, n=60, relations=1):
    """A cycle of entities."""
    return spark.range(n).select(F.col("id").alias("pos"), F.col("id").alias("head_id"), F.pmod("id", F.lit(relations)).alias("relation_id"), ((F.col("id") + 1) % n).alias("tail_id"))


@pytest.mark.slow
def test_search_shares_jobs_and_drops_the_worse_half(spark):
    t = ring(spark)
    table = train.trials(spark, 4)
    assert {r.model for r in table.collect()} == {"boxe", "transe"}
    found = train.search(t, spark.range(60), spark.range(1), table).collect()
    assert len(found) == 4 and all(1 <= x.metric <= 60 for x in found) and len({x.metric for x in found}) > 1
    assert sorted(x.epochs for x in found) == [1, 1, 2, 2]
    assert max(x.metric for x in found if x.epochs == 2) <= 60
    best = train.best_trial(train.search(t, spark.range(60), spark.range(1), table)).first()
    assert best.metric == min(x.metric for x in found if x.epochs == 2)


def test_ranks_of_trials_are_those_of_each_alone(spark):
    t = ring(spark, 20, 2)
    settings = {0: train.Settings("transe", 1), 1: train.Settings("transe", 2), 2: train.Settings("boxe", 1), 3: train.Settings("boxe", 2)}
    e, r, es, rs = {}, {}, [], []
    for k, s in settings.items():
        names = (("vec",), ("vec",)) if s.model == "transe" else (train.BOXE_ENTITY, train.BOXE_RELATION)
        e[k], r[k] = (train.boxe_parameters(spark.range(n), own, 4, seed=k) for n, own in ((20, names[0]), (2, names[1])))
        es.append(train._one(e[k], *names[0]).withColumn("trial", F.lit(k)))
        rs.append(train._one(r[k], *names[1]).withColumn("trial", F.lit(k)))
    together = train.trial_ranks(t, reduce(lambda a, b: a.unionByName(b), es), reduce(lambda a, b: a.unionByName(b), rs), settings)
    got = {}
    for x in together.collect():
        got.setdefault(x.trial, []).append((x.better, x.equal))
    for k, s in settings.items():
        alone = R.ranks(t, e[k], r[k], R.distance_scorer(s.p)) if s.model == "transe" else R.boxe_ranks(t, e[k], r[k], s.p)
        assert sorted(got[k]) == sorted((x.better, x.equal) for x in alone.collect())


def one_loss(s, rows):
    """Loss of rows (group, k, h, r, t), and its gradients in each."""
    first = np.array([k < 0 for _, k, *_ in rows])
    h, r, t = (np.stack([x[i] for x in rows]) for i in (2, 3, 4))
    score, d_h, d_r, d_t = train.TERMS[s.model](h, r, t, s)
    loss, _, slope = train.loss_terms(score, first, s)
    return loss, score, slope, [slope[:, None] * d for d in (d_h, d_r, d_t)]


@pytest.mark.parametrize("model,p,tanh", [("transe", 1, True), ("transe", 2, True), ("boxe", 1, True), ("boxe", 2, True), ("boxe", 2, False)])
@pytest.mark.parametrize("loss", ["margin", "softplus", "nssa"])
def test_gradients_against_differences(model, p, tanh, loss):
    rng = np.random.default_rng(3)
    s = train.Settings(model, p, tanh, loss, margin=3.0)
    d = 3
    e, r = (d, d) if model == "transe" else (2 * d, 4 * d + 2)
    rows = [[g, k, rng.normal(size=e), rng.normal(size=r), rng.normal(size=e)] for g in range(3) for k in range(-1, g + 1)]
    weights = None
    _, score, slope, grads = one_loss(s, rows)
    if loss == "nssa":  # weights are constants: hold them while differences are taken
        weights = slope
    for row in (0, 1, 4, 8):
        for part in range(3):
            for at in range(len(rows[row][2 + part])):
                both = []
                for move in (1e-6, -1e-6):
                    changed = [list(x) for x in rows]
                    changed[row][2 + part] = rows[row][2 + part] + move * np.eye(len(rows[row][2 + part]))[at]
                    value, other, _, _ = one_loss(s, changed)
                    both.append(value if weights is None else float((weights * other).sum()))
                assert (both[0] - both[1]) / 2e-6 == pytest.approx(grads[part][row][at], rel=1e-3, abs=2e-5)


def test_self_adversarial_loss_and_its_slope_in_scores():
    s = train.Settings(loss="nssa", margin=3.0, temperature=2.0)
    score, first = np.array([-1.0, -2.0, -0.5, 0.3, -4.0]), np.array([True, False, False, True, False])
    loss, n, slope = train.loss_terms(score, first, s)
    soft = lambda x: np.log1p(np.exp(x))
    w = np.exp(2 * score[1:3])
    w /= w.sum()
    want = (soft(-(score[0] + 3)) + (w * soft(score[1:3] + 3)).sum() + soft(-(score[3] + 3)) + soft(score[4] + 3)) / 2
    assert n == 2 and loss == pytest.approx(want) and (slope[first] < 0).all() and (slope[~first] > 0).all()
    assert slope[2] == pytest.approx(w[1] / (1 + np.exp(-(score[2] + 3))) / 2)


def dense(spark, t, optimizer, epochs, n_batches, rate, n=60):
    """TransE with whole tables in numpy, every row moved in every step; negatives and batches are the library's."""
    e = np.array([v.vec for v in train.random_table(spark.range(n), "e", 5).orderBy("id").collect()], dtype=float)
    r = np.array([v.vec for v in train.random_table(spark.range(2), "r", 5).orderBy("id").collect()], dtype=float)
    s = train.Settings(loss="nssa", rate=rate, optimizer=optimizer)
    e = e / np.linalg.norm(e, axis=1, keepdims=True)
    moments = [[np.zeros_like(x), np.zeros_like(x)] for x in (e, r)]
    stats, step = sample.bernoulli_stats(t), 0
    for epoch in range(epochs):
        dealt = sample.batches(t, epoch, n_batches)
        for b in range(n_batches):
            step += 1
            own = dealt.where(F.col("batch") == b)
            wrong = sample.bernoulli_negatives(own, n, 2, epoch, stats).collect()
            rows = []
            for x in own.collect():
                tries = [(x.head_id, x.relation_id, x.tail_id)] + [(w.head_id, w.relation_id, w.tail_id) for w in sorted(wrong, key=lambda w: w.k) if w.pos == x.pos]
                rows += [(x.pos, k - 1, *ids) for k, ids in enumerate(tries)]
            _, _, _, (d_h, d_r, d_t) = one_loss(s, [(g, k, e[h], r[q], e[w]) for g, k, h, q, w in rows])
            grads = np.zeros_like(e), np.zeros_like(r)
            for i, (_, _, h, q, w) in enumerate(rows):
                grads[0][h] += d_h[i]
                grads[0][w] += d_t[i]
                grads[1][q] += d_r[i]
            for x, g, mv in zip((e, r), grads, moments):
                if optimizer == "adam":
                    mv[0][:] = 0.9 * mv[0] + 0.1 * g
                    mv[1][:] = 0.999 * mv[1] + 0.001 * g * g
                    x -= rate * (mv[0] / (1 - 0.9**step)) / (np.sqrt(mv[1] / (1 - 0.999**step)) + 1e-8)
                else:
                    x -= rate * g
        e /= np.linalg.norm(e, axis=1, keepdims=True)
    return e, r


@pytest.mark.slow
@pytest.mark.parametrize("optimizer", ["sgd", "adam"])
def test_sparse_steps_equal_dense_ones(spark, optimizer):
    """Rows are written only when a batch touches them; momentum and normalisation reach the others when they are read."""
    t = ring(spark, 60, 2)
    e, r = dense(spark, t, optimizer, 2, 4, 0.02)
    got_e, got_r, _ = train.train_transe(t, train.random_table(spark.range(60), "e", 5), train.random_table(spark.range(2), "r", 5), epochs=2, n_batches=4, rate=0.02, optimizer=optimizer, negatives="bernoulli", loss="nssa")
    assert np.allclose([v.vec for v in got_e.orderBy("id").collect()], e, atol=1e-12) and np.allclose([v.vec for v in got_r.orderBy("id").collect()], r, atol=1e-12)


def test_a_step_writes_what_it_changes(spark):
    start = spark.range(1000).select(F.lit(0).alias("trial"), F.lit("e").alias("tbl"), "id", F.array(F.lit(1.0), F.lit(2.0)).alias("x"))
    s = store.Store(start, {(0, "e"): store.Rule(0.1, "adam")})
    few = spark.range(3).select(F.lit(0).alias("trial"), F.lit("e").alias("tbl"), "id", F.array(F.lit(1.0), F.lit(-1.0)).alias("grad"))
    for step in (1, 2):
        s.change(s.rows({0: step - 1}, few.select(*store.KEY)), few, {0: step})
        assert spark.read.parquet(s.log[-1]).count() == 3
    assert s.logged == 6 and s.rows({0: 2}).count() == 1000
    moved = {r.id: r.x for r in s.rows({0: 2}).where("id < 5").collect()}
    assert moved[4] == [1.0, 2.0] and moved[0] == pytest.approx([0.8, 2.2])
    s.merge()
    assert s.log == [] and {r.id: r.x for r in s.rows({0: 2}).where("id < 5").collect()} == moved


def test_momentum_ends():
    x, m, v = (np.full((1, 2), z) for z in (1.0, 0.5, 0.2))
    rule = store.Rule(0.1, "adam")
    long = store.caught_up(x, m, v, np.array([7]), 7 + 5 * store.MEMORY, rule)
    assert np.allclose(long[0], store.caught_up(x, m, v, np.array([7]), 7 + store.MEMORY, rule)[0], atol=1e-14)
    assert np.allclose(long[2], 0.2 * 0.999 ** (5 * store.MEMORY))


def test_chances_are_those_of_all_triples(spark):
    """A batch of one triple of a one-to-many relation still takes the relation's chance."""
    t = spark.createDataFrame([(i, 0, 0, i + 1) for i in range(99)], "pos long, head_id long, relation_id long, tail_id long")
    stats = sample.bernoulli_stats(t)
    assert stats.first().p_head == pytest.approx(0.99)
    wrong = sample.bernoulli_negatives(t.where("pos % 3 = 0"), 100, 2, 0, stats)
    assert wrong.where("head_id != 0").count() > 55  # of 66; alone, this batch would have the same chance
    whole = {(r.pos, r.k): tuple(r) for r in sample.bernoulli_negatives(t, 100).collect()}
    assert all(whole[r.pos, r.k] == tuple(r) for r in wrong.collect())


def test_profile_last_write_wins_and_ties(spark):
    t = triples(spark, [("a", "p", "b"), ("c", "q", "a")]).withColumn("split", F.lit("train"))
    label = "http://www.w3.org/2000/01/rdf-schema#label"
    notes = spark.createDataFrame([("a", label, "old", 0), ("a", label, "new", 1), ("zz", label, "no", 2), ("imgt:y", label, "yes", 3)], "sub string, pred string, obj string, pos long")
    got = {r.subject: r.value for r in profile.latest(profile.routed(notes, t), "label").collect()}
    assert got == {"a": "new", "imgt:y": "yes"}
    assert [r.relation for r in profile.relation_topk(t, 1).collect()] == ["p"]


def test_streamed_triples(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.tsv").write_text("a\tp\tb\nc\tp\td\n\nbad line\n")
    q = ingest.relation_counts(ingest.stream_triples(spark, str(tmp_path / "in"))).writeStream.outputMode("complete").format("memory").queryName("streamed").start()
    q.processAllAvailable()
    q.stop()
    assert {(r.relation, r.n) for r in spark.table("streamed").collect()} == {("p", 2)}

def test_shared_places_give_the_same_ids_in_every_reading(spark, tmp_path):
    """Where ``pos`` is not unique, terms decide: dictionaries and files come out the same from any order of rows."""
    rows = [(f"h{i % 50}", f"p{i % 5}", f"t{i % 40}", i // 100) for i in range(400)]
    found = []
    for k, order in enumerate((rows, rows[::-1], sorted(rows, key=lambda r: r[2]))):
        t = spark.createDataFrame(order, "head string, relation string, tail string, pos long").repartition(3 + k)
        sinks.write_triples(t, str(tmp_path / f"o{k}"), "tsv")
        lines = readers.read_triples_tsv(spark, str(tmp_path / f"o{k}")).orderBy("pos")
        found.append((sorted(vocab.entity_vocab(t).collect()), sorted(vocab.relation_vocab(t).collect()), [tuple(x) for x in lines.collect()]))
    assert found[0] == found[1] == found[2] and sorted(x.id for x in found[0][0]) == list(range(90))


def test_rows_of_a_file_stay_in_their_tasks(spark, tmp_path):
    """Blocks without quotes are numbered and cut into records without a sort of their rows; others give the same numbers."""
    for k, cell in enumerate(("plain", 'two\n"" lines', "plain")):
        body = "".join(f'a{k}_{i},p,"{cell}"\n' if "\n" in cell and i % 7 == 0 else f"a{k}_{i},p,x\n" for i in range(200))
        (tmp_path / f"part-{k}.csv").write_text("sub,pred,obj\n" + body + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 500)
    try:
        got = readers.read_triples_csv(spark, str(tmp_path))
        assert [(x["head"], x.pos) for x in got.orderBy("pos").collect()] == [(f"a{k}_{i}", 200 * k + i) for k in range(3) for i in range(200)]
        assert got.where("tail LIKE 'two%'").select("tail").distinct().collect()[0][0] == 'two\n" lines'
        (tmp_path / "plain").mkdir()
        (tmp_path / "plain" / "a.tsv").write_text("".join(f"h{i}\tp\tt{i}\n" for i in range(300)))
        t = readers.read_triples_tsv(spark, str(tmp_path / "plain"))
        assert [(x["head"], x.pos) for x in t.orderBy("pos").collect()] == [(f"h{i}", i) for i in range(300)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_numbers_of_unbroken_blocks_need_no_sort(spark):
    """A block whose rows follow one another is numbered by its ids alone: only rows of broken blocks reach the window."""
    rows = [("f", 0, 10 + i, f"u{i}") for i in range(5)] + [("f", 9, 100 + 2 * i, f"b{i}") for i in range(5)]
    flat = spark.createDataFrame(rows, "place_file string, place_start long, place_row long, v string")
    got = readers._numbered(flat)
    assert {x.v: x.pos for x in got.collect()} == {f"u{i}": i for i in range(5)} | {f"b{i}": 5 + i for i in range(5)}
    assert "UnionExec" in str(got._jdf.queryExecution().executedPlan().getClass()) or "Union" in got._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("what", ["index", "bernoulli"])
def test_relations_are_sent_to_their_triples(spark, what):
    """Few relations hold most triples, so these are not dealt out by relation, even where Spark knows no sizes."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        if what == "index":
            t = triples(spark, [("a", "p", "b"), ("c", "q", "a")])
            out = vocab.index_triples(t, vocab.entity_vocab(t), vocab.relation_vocab(t))
        else:
            t = spark.range(50).select(F.col("id").alias("pos"), (F.col("id") % 7).alias("head_id"), (F.col("id") % 2).alias("relation_id"), (F.col("id") % 5).alias("tail_id"))
            out = sample.bernoulli_negatives(t, 10)
        plan = out._jdf.queryExecution().executedPlan().toString()
        joins = [x for x in plan.split("\n") if "Join" in x]
        # the last join above the triples; counts of distinct ids below may be joins as well
        of_relations = [x for x in joins if "relation" in x]
        assert "BroadcastHashJoin" in of_relations[0]
        assert out.count() == {"index": 2, "bernoulli": 100}[what]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_ends_and_relations_are_told_apart_without_triples(spark, tmp_path, monkeypatch):
    rows = {
        "nation": ("n_nationkey int, n_name string, n_regionkey int", [(1, "FRANCE", 3), (2, "PERU", None)]),
        "customer": ("c_custkey long, c_name string, c_nationkey int", [(7, "c7", 1), (10, "c10", 5)]),
        "supplier": ("s_suppkey long, s_name string, s_nationkey int", []),
        "orders": ("o_orderkey long, o_custkey long", [(1, 7), (2, 99)]),
        "part": ("p_partkey long, p_name string, p_brand string, p_type string", [(4, " Order_1 ", "http://x.org/a/", "SMALL TIN"), (5, "Disease", None, "BIG TIN")]),
        "lineitem": ("l_orderkey long, l_partkey long, l_suppkey long", [(1, 4, 8), (1, 4, 8), (3, 6, None)]),
    }
    for name, (schema, values) in rows.items():
        spark.createDataFrame(values, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    sf, triples = str(tmp_path), X.compact_triples(spark, str(tmp_path))
    listed = lambda df: sorted((r[0] for r in df.collect()), key=str)
    assert listed(X.kg_entities(spark, sf)) == listed(profile.entities_of(triples))
    assert listed(X.kg_relations(spark, sf)) == listed(profile.relations_of(triples))
    want = profile.entity_dim(triples, profile.routed(X.kg_annotations(spark, sf), triples)).select("entity", "primary_type").collect()
    monkeypatch.setattr(X, "kg_triples", None)  # no triple is derived for the types of entities
    got = catalog.QUERIES["primary_type"](spark, sf).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, want), key=str)


def test_terms_without_white_space_need_no_pattern(spark):
    terms = ["a:b:c", ":", "", " x ", " y", "plain", "a\nb:c", "http://x.org/a#b:c", "https://x.org/p/q//", "\tz:1", None]
    df = spark.createDataFrame([(t,) for t in terms], "t string")
    got = [(r.c, r.n) for r in df.select(T.compact_term(F.col("t")).alias("c"), T.local_name(F.col("t")).alias("n")).collect()]
    short = ["a:b:c", ":", "", "x", "y", "plain", "a\nb:c", "b:c", "q", "z:1", None]
    assert got == [(s, s if s is None else s.partition(":")[2] if ":" in s else s) for s in short]
