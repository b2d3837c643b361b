"""Registered queries against their SQL on the smallest tables."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))

import __spark_entry__ as E  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
QUERIES, SQL = E.queries(), E.oracle_sql()
# Queries of several seconds, run by tools/check.py instead.
SLOW = {"ica_scores", "forest_cv"}


@pytest.fixture(scope="session")
def con():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for f in Path(FOLDER).glob("*.parquet"):
        c.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return c


def test_sql_belongs_to_queries():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - SLOW))
def test_query(spark, con, name):
    from check import rows

    got = QUERIES[name](spark, FOLDER).toArrow()
    if name not in SQL:
        assert got.num_rows > 0
        return
    want = con.execute(SQL[name]).to_arrow_table()
    kinds = lambda t: {f.name: str(f.type).replace("large_", "") for f in t.schema}
    assert kinds(got) == kinds(want)
    assert rows(got) == rows(want)


def test_entry(spark):
    assert E.entry(spark).count() > 0
