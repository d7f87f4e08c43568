import pytest
from pyspark.sql import functions as F

from triplane.functions import terms as T

TERMS = [
    ("https://www.imgt.org/imgt-ontology#mAb_12", "imgt:mAb_12", "mAb_12", "mAb"),
    ("http://purl.obolibrary.org/obo/MONDO_0005148", "obo:MONDO_0005148", "MONDO_0005148", "MONDO"),
    ("obo:MONDO_1", "obo:MONDO_1", "MONDO_1", "Disease"),
    ("HGNC:1100", "HGNC:1100", "1100", "NumericId"),
    ("HGNC:HGNC:1100", "HGNC:HGNC:1100", "HGNC:1100", "HGNC"),
    ("HGNC:ABC1", "HGNC:ABC1", "ABC1", "HGNC"),
    ("ORDO:Orphanet_123", "ORDO:Orphanet_123", "Orphanet_123", "Disease"),
    ("ORDO:123", "ORDO:123", "123", "NumericId"),
    ("imgt:StudyProduct_1", "imgt:StudyProduct_1", "StudyProduct_1", "StudyProduct"),
    ("imgt:Amgen_Inc", "imgt:Amgen_Inc", "Amgen_Inc", "Organisation"),
    ("imgt:FDA", "imgt:FDA", "FDA", "Organisation"),
    ("imgt:Solid_tumors", "imgt:Solid_tumors", "Solid_tumors", "Disease"),
    ("imgt:Solid_tumor", "imgt:Solid_tumor", "Solid_tumor", "Solid"),
    ("imgt:Breast_cancer", "imgt:Breast_cancer", "Breast_cancer", "Breast"),
    ("imgt:_x", "imgt:_x", "_x", ""),
    ("http://example.org/a#b#c", "c", "c", "c"),
    ("http://example.org/path/Item/", "Item", "Item", "Item"),
    ("http://example.org/x/a:b", "a:b", "b", "b"),
    ("http://example.org/a#", "", "", ""),
    (" plain ", "plain", "plain", "plain"),
    ("", "", "", ""),
]


def test_terms(spark):
    df = spark.createDataFrame([(i, t[0]) for i, t in enumerate(TERMS)], "i int, v string")
    got = {r.i: r for r in df.select("i", T.compact_term(F.col("v")).alias("c"), T.local_name(F.col("v")).alias("n"), T.family(F.col("v")).alias("f")).collect()}
    for i, (_, compact, name, family) in enumerate(TERMS):
        assert (got[i].c, got[i].n, got[i].f) == (compact, name, family), TERMS[i]


@pytest.mark.parametrize("value,good", [("http://x/a", True), ("a+b.c-1://", True), ("urn:x", False), ("mailto:a@b", False), ("_:b0", False), ("//x", False), ("1a://x", False), ("", False), (" http://x", False)])
def test_is_uri(spark, value, good):
    assert spark.createDataFrame([(value,)], "v string").select(T.is_uri(F.col("v"))).first()[0] is good


def test_coarse_category(spark):
    rows = [("imgt:Breast_cancer", "Breast", "Breast", None, "Disease"), ("x", "mAb", "y", None, "mAb"), ("x", "q", "INN", None, "INN"), ("x", "q", "y", ["doid:1"], "Disease"), ("imgt:_x", "", "y", [], "y"), ("x", "q", "y", [], "q")]
    df = spark.createDataFrame(rows, "e string, f string, p string, t array<string>, want string")
    got = df.select(T.coarse_category(F.col("e"), F.col("f"), F.col("p"), F.col("t")).alias("got"), "want")
    assert all(r.got == r.want for r in got.collect())


def test_plain_uris_are_shortened_by_compiled_expressions(spark):
    """Only terms that may lose white space go through a function of arrays; both ways give the same."""
    column = T.compact_term(F.col("t"))
    assert str(column._jc).replace("\n", " ").split(" ELSE ")[0].count("transform") == 0
    ends = ["", " ", "\t", "\x85", " ", " ", "　", "é", "/", "//", "#", "~", "!"]
    texts = [f"{a}{u}{b}" for u in ("http://x/y#z", "https://x/y/z", "http://purl.obolibrary.org/obo/A_1", "http://", "x y") for a in ("", " ", "　") for b in ends]
    rows = spark.createDataFrame([(t,) for t in [*texts, *ends, None]], "t string")
    stripped = F.regexp_replace("t", "(?U)^\\s+|\\s+$", "")
    got = rows.select("t", column.alias("got"), T.compact_term(F.concat(F.lit(" "), stripped)).alias("want"))
    assert [tuple(x) for x in got.where("NOT got <=> want").collect()] == []
