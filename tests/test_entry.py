"""What the driver calls, held against SQL."""

from __future__ import annotations

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

NAMES = sorted(n for n in entry.oracle_sql() if not n.startswith("op") and n != "pipeline")


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for p in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query_is_that_of_sql(spark, sf, con, name):
    df = entry.queries()[name](spark, sf)
    rel = con.sql(entry.oracle_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(rel.columns)
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({entry.oracle_sql()[name]})").fetchall()
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in df.select(columns).collect())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_packages_do_not_need_the_llm_folder():
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for path in glob.glob(f"{root}/flowlens/**/*.py", recursive=True):
        if "/llm/" not in path:
            with open(path) as f:
                assert "llm" not in f.read()
