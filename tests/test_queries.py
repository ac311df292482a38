"""All queries with SQL twins, held against DuckDB on the smallest tables; imports without the optional subpackage."""

import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parent.parent
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def norm(v):
    return f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_twin(spark, sf, duck, name):
    out = entry.queries()[name](spark, sf)
    columns = sorted(out.columns)
    got = sorted(tuple(norm(r[c]) for c in columns) for r in out.collect())
    twin = duck.sql(entry.oracle_sql()[name])
    assert sorted(twin.columns) == columns
    at = [twin.columns.index(c) for c in columns]
    assert got == sorted(tuple(norm(r[i]) for i in at) for r in twin.fetchall())


def test_imports_without_the_optional_subpackage():
    code = "import sys; sys.modules['docdelta.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert q and not any(k.startswith('op') for k in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
