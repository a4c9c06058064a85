"""Registered queries against DuckDB on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = [n for n in entry.oracle_sql() if not n.startswith("op") and n != "pipeline"]


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.skipif(not os.path.isdir(SF), reason="the tables are not here")
@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    tidy = lambda rows: sorted([tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows], key=repr)
    cols = sorted(df.columns)
    found = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == cols
    want = tidy([tuple(r[names.index(c)] for c in cols) for r in found.fetchall()])
    assert tidy([tuple(r) for r in df.select(*cols).collect()]) == want


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(SF), reason="the tables are not here")
def test_flagship(spark):
    df = entry.entry(spark)
    assert set(df.columns) == {"id_a", "id_b", "jw"} and df.count() > 0


def test_without_the_training_data_operators(tmp_path):
    """A copy without the subpackage and its tests still imports and has the linkage engine's queries."""
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.abspath(entry.__file__))
    shutil.copytree(os.path.join(root, "kindred"), tmp_path / "kindred", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for f in ("__spark_entry__.py", "corpus_pipeline.py", "bench.py"):
        if os.path.exists(os.path.join(root, f)):
            shutil.copy(os.path.join(root, f), tmp_path)
    says = "import __spark_entry__ as e, kindred.cli; q = e.queries(); assert len(q) > 90 and not any(k.startswith('op') or k == 'pipeline' for k in q) and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", says], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})
