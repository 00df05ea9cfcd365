"""Every query with SQL against DuckDB; the entry's functions; independence of the optional parts."""

import os
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from kerbside.plans import catalogue


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{sf}/{f}')")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_equals_sql(spark, sf, db, name):
    df = catalogue.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    want = db.sql(catalogue.SQL[name])
    assert sorted(want.columns) == columns
    order = [want.columns.index(c) for c in columns]
    assert sorted(str([r[c] for c in columns]) for r in df.collect()) == sorted(str([r[i] for i in order]) for r in want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).columns == ["id", "distance_to_query_m"]
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(catalogue.QUERIES) <= set(entry.queries())


def test_entry_without_the_optional_parts(tmp_path):
    import shutil

    root = Path(entry.__file__).resolve().parent
    shutil.copytree(root / "kerbside", tmp_path / "kerbside", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert len(e.queries()) > 40 and not any(n.startswith('op') for n in e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
