"""Every query with SQL must equal it on the smallest data; every other one must run."""

import glob
import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from tools_compare import rows

CORE = {k: f for k, f in entry.queries().items() if not f.__module__.startswith("lodeweave.llm")}
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for p in glob.glob(sf_dir + "/*.parquet"):
        c.execute(f"create view {p.split('/')[-1][:-8]} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(CORE))
def test_query(spark, con, sf_dir, name):
    df = CORE[name](spark, sf_dir)
    got = df.collect()
    if name in SQL:
        r = con.execute(SQL[name])
        assert rows(df.columns, got) == rows([c[0] for c in r.description], r.fetchall())


def test_queries_are_listed_without_a_session():
    """Nothing builds columns at import time."""
    code = "import __spark_entry__ as e; assert e.queries() and set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=os.path.dirname(entry.__file__))


def test_entry(spark):
    assert entry.entry(spark).count() > 0
