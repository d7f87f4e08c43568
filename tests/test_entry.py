import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUICK = ["relation_counts", "rdf_terms", "term_kinds", "compact_terms", "entity_vocab", "split_stats", "bernoulli_stats", "prior_coverage", "random_vectors", "tail_rank_transe", "losses"]


@pytest.fixture(scope="module")
def db():
    out = duckdb.connect()
    for t in TABLES:
        out.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return out


def test_contract(spark):
    names = entry.queries()
    assert set(entry.oracle_sql()) <= set(names)
    rows = entry.entry(spark).collect()
    assert len(rows) == 9 and sum(r["count"] for r in rows) > 0


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", QUICK)
def test_against_sql(spark, db, name):
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    found = db.execute(entry.oracle_sql()[name])
    at = [[d[0] for d in found.description].index(c) for c in columns]
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in found.fetchall()), key=str)


def test_the_rest_stands_without_llm(tmp_path):
    """Without the subpackage and the pipeline the contract still imports, and the other tests run; those of long trainings, which run beside this one, are left out."""
    import os
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.abspath(entry.__file__))
    shutil.copytree(f"{root}/triplane", tmp_path / "triplane", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", "pytest.ini"):
        shutil.copy(f"{root}/{name}", tmp_path)
    # what the packages need stays on the path, only the repository itself does not
    others = [p for p in [*os.environ.get("PYTHONPATH", "").split(os.pathsep), *sys.path] if p and os.path.abspath(p) not in (root, f"{root}/tests")]
    env = {**os.environ, "PYTHONPATH": os.pathsep.join([str(tmp_path), *dict.fromkeys(others)])}
    code = f"import __spark_entry__ as e; assert e.__file__.startswith({str(tmp_path)!r}); assert e.queries() and e.oracle_sql() and not any(q.startswith('op') or q == 'pipeline' for q in e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, check=True)
    shutil.copytree(f"{root}/tests", tmp_path / "tests", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    ran = subprocess.run([sys.executable, "-m", "pytest", "-q", "-x", "tests", "-m", "not slow", "--deselect", "tests/test_entry.py::test_the_rest_stands_without_llm"], cwd=tmp_path, env=env, timeout=1500, capture_output=True, text=True)
    assert ran.returncode == 0, ran.stdout[-3000:]
