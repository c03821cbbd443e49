"""Every query of the training-data operators over the smallest tables, and against DuckDB where it has SQL."""

from pathlib import Path

import pytest

from webloom.llm import queries
from webloom.llm.tokenizer import TOKENIZER

duckdb = pytest.importorskip("duckdb")
ROOT = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not ROOT.exists() or not Path(TOKENIZER).exists(), reason="no test data")


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_runs(spark, name):
    df = queries.QUERIES[name](spark, str(ROOT))
    rows = df.collect()
    assert rows
    if name in queries.SQL:
        con = duckdb.connect()
        for p in ROOT.glob("*.parquet"):
            con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
        rel = con.execute(queries.SQL[name])
        assert [d[0] for d in rel.description] == df.columns
        assert sorted(map(tuple, rows)) == sorted(rel.fetchall())
