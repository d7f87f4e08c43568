import random
import re
from collections import defaultdict

import duckdb
import pytest

from triplane.llm import line_templates as L

KIND = "doc_id long, text string, line_templates_drop string"


def brute(rows):
    """Texts after line dedup, by plain loops."""
    forms = []
    for n, (_, text, _) in enumerate(rows):
        for at, line in enumerate((text or "").split("\n") if text is not None else []):
            form = " ".join(L.WILD if re.search("[0-9]", t) else t for t in re.split("[ \t\r\f\v]+", line) if t)
            if form:
                forms.append((n, at, form))
    leaves, docs = defaultdict(list), defaultdict(set)
    for n, at, form in forms:
        tokens = form.split(" ")
        docs[form].add(n)
        if len(tokens) > L.LEADING:
            leaves[(len(tokens), *tokens[: L.LEADING])].append((n, tokens))
    template, owners = {}, defaultdict(set)
    for (size, *lead), own in leaves.items():
        everyone = {n for n, _ in own}
        if len(everyone) < L.MIN_DOCS or len({tuple(t) for _, t in own}) < 2:
            continue
        for n, tokens in own:
            constant = [t != L.WILD and 2 * len({m for m, other in own if other[p] == t}) >= len(everyone) for p, t in enumerate(tokens)][L.LEADING :]
            words = sum(constant) + sum(t != L.WILD for t in lead)
            if 2 * sum(constant) >= size - L.LEADING and 2 * words >= size:
                name = (*lead, *(t if c else L.WILD for t, c in zip(tokens[L.LEADING :], constant, strict=True)))
                template[" ".join(tokens)] = name
                owners[name].add(n)
    seen, gone = set(), set()
    for n, at, form in sorted(forms, key=lambda x: (rows[x[0]][0] is None, rows[x[0]][0] or 0, x[1])):
        name = template.get(form)
        if name is None or len(owners[name]) < (L.MIN_DOCS if L.WILD in name else L.EXACT_DOCS):
            name, tokens = form, form.split(" ")
            wilds = tokens.count(L.WILD)
            if len(docs[form]) < (L.MIN_DOCS if wilds else L.EXACT_DOCS) or 2 * (len(tokens) - wilds) < len(tokens):
                continue
        if name in seen:
            gone.add((n, at))
        seen.add(name)
    return [None if t is None else "\n".join(line for at, line in enumerate(t.split("\n")) if (n, at) not in gone) for n, (_, t, _) in enumerate(rows)]


def run(spark, rows):
    docs = spark.createDataFrame(rows, KIND)
    out = L.without_recurring(docs)
    assert out.columns == docs.columns
    return {r.line_templates_drop: r.text for r in out.collect()}


def check(spark, rows):
    assert run(spark, rows) == dict(zip((r[2] for r in rows), brute(rows), strict=True))


def test_templates_go_and_the_rest_stays(spark):
    rows = []
    for i in range(20):
        own = "abcdefghijklmnopqrst"[i]
        lines = [f"{own}nique words of one document only", f"Page {i} of {i * 7} in total", "Share this with friends now", "Menu", f"own {own} tail end line", f"{i}"]
        rows.append((i, "\n".join(lines), f"{i}"))
    out = run(spark, rows)
    assert out["0"] == rows[0][1]  # the first of each stays
    for i in range(1, 20):
        text = out[f"{i}"].split("\n")
        assert [line.split(" ")[0] for line in text] == [f"{'abcdefghijklmnopqrst'[i]}nique", "own", f"{i}"]
    check(spark, rows)


def test_too_few_documents(spark):
    rows = [(i, f"The very same line of text\nand another {i} that is alike", f"{i}") for i in range(L.EXACT_DOCS - 1)]
    assert set(run(spark, rows).values()) == {r[1] for r in rows}


def test_a_document_counts_once(spark):
    """Five documents, each with two forms of one template."""
    rows = [(i, f"User {w} logged in from the office\nUser {w} logged in from the office at {i}\nUser {v} logged in from the office\nown line {w}", f"{i}") for i, (w, v) in enumerate(zip("abcde", "fghij", strict=True))]
    assert run(spark, rows) == {r[2]: r[1] for r in rows}


def test_leading_words_alone_are_no_template(spark):
    rows = [(i, f"He said that {w}", f"{i}") for i, w in enumerate("maybe never always often rarely today tomorrow yesterday soon later once twice".split())]
    assert run(spark, rows) == {r[2]: r[1] for r in rows}


@pytest.mark.parametrize("seed", range(3))
def test_many_forms_in_a_document_against_brute_force(spark, seed):
    r = random.Random(seed)
    word = lambda k: r.choice("abcdefghijklmnop"[:k])
    rows = []
    for i in range(45):
        lines = []
        for _ in range(r.randrange(0, 6)):
            kind = r.randrange(6)
            lines.append(
                [
                    f"job {word(3)} is now {word(12)} on node {word(2)}",
                    f"x y z {word(2)} {word(16)}",
                    " ".join(word(2) for _ in range(r.randrange(1, 7))),
                    f"Page {r.randrange(9)}  of\t{r.randrange(99)}",
                    f"{r.randrange(5)}",
                    "",
                ][kind]
            )
        rows.append((None if i == 5 else r.randrange(9) * 100 + i, "\n".join(lines), f"{i}"))
    check(spark, rows)


def test_awkward_rows(spark):
    same = "Terms apply to all our users"
    rows = [(i, same, f"a{i}") for i in range(12)] + [(50, None, "b"), (51, "", "c"), (None, same, "d"), (52, f"{same}\n\n{same}", "e"), (3, "other text of the same id", "f"), (0, same, "g"), (60, "x\t y  z\t1w2\r", "h")]
    out = run(spark, rows)
    assert out["a0"] == out["g"] == same and out["a5"] == ""
    assert out["b"] is None and out["c"] == "" and out["d"] == "" and out["e"] == ""
    assert out["f"] == "other text of the same id" and out["h"] == "x\t y  z\t1w2\r"
    assert L.without_recurring(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_a_long_text_of_many_lines(spark):
    text = "\n".join(f"line of {'abcdefghij'[i % 10]}{'abcdefghij'[i // 10 % 10]} long text" for i in range(50_000))
    rows = [(i, text, f"{i}") for i in range(3)]
    out = run(spark, rows)
    assert len(out["0"].split("\n")) == 100 and out["1"] == out["2"] == ""


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_given_table_against_sql(spark, sf):
    path = f"/root/testdata/{sf}/documents.parquet"
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}'")
    want = sorted(db.execute(L.SQL).fetchall())
    got = sorted(tuple(r) for r in L.digest(spark.read.parquet(path)).select("doc_id", "n_lines", "n_chars", "text_md5").collect())
    assert got == want
