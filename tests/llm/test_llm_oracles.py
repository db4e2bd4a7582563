"""Queries with oracle SQL against DuckDB."""

from collections import Counter
from pathlib import Path

import duckdb
import pytest

from feedloom.llm.queries import ORACLES, QUERIES

FOLDER = Path("/root/testdata/sf0.01")


@pytest.mark.skipif(not FOLDER.exists(), reason="test tables are not mounted")
@pytest.mark.parametrize("name", list(ORACLES))
def test_oracle(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "conversations"):
        con.execute(f"create view {table} as select * from '{FOLDER}/{table}.parquet'")
    result = con.execute(ORACLES[name])
    columns = [d[0] for d in result.description]
    expected = Counter(result.fetchall())
    out = QUERIES[name](spark, str(FOLDER))
    assert sorted(out.columns) == sorted(columns)
    assert Counter(tuple(r) for r in out.select(columns).collect()) == expected
