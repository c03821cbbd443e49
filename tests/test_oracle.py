"""Every query with SQL against DuckDB, over the smallest tables."""

from pathlib import Path

import pytest

import __spark_entry__
from webloom import queries

duckdb = pytest.importorskip("duckdb")
ROOT = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not ROOT.exists(), reason="no test data")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in ROOT.glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def _norm(v):
    return f"{v:.9g}" if isinstance(v, float) else repr(v)


CORE_SQL, CORE = queries.SQL, queries.QUERIES


@pytest.mark.parametrize("name", sorted(CORE_SQL))
def test_same_rows(spark, con, name):
    same_rows(spark, con, name)


def same_rows(spark, con, name):
    df = __spark_entry__.queries()[name](spark, str(ROOT))
    cols = sorted(df.columns)
    got = sorted(tuple(map(_norm, r)) for r in df.select(*[f"`{c}`" for c in cols]).collect())
    rel = con.execute(__spark_entry__.oracle_sql()[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert got == sorted(tuple(_norm(r[i]) for i in at) for r in rel.fetchall())


@pytest.mark.parametrize("name", sorted(set(CORE) - set(CORE_SQL)))
def test_runs(spark, name):
    assert __spark_entry__.queries()[name](spark, str(ROOT)).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 15


def test_the_entry_has_all_queries():
    assert set(CORE) <= set(__spark_entry__.queries()) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
