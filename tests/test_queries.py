"""Every registered query against its DuckDB oracle on the smallest data set."""

from collections import Counter
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

FOLDER = Path("/root/testdata/sf0.001")
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()

pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="test tables are not mounted")


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return con


def test_every_query_has_an_oracle():
    assert set(entry.QUERIES) == set(entry.ORACLES)


@pytest.mark.parametrize("name", list(entry.QUERIES))
def test_query(spark, oracle, name):
    df = entry.queries()[name](spark, str(FOLDER))
    columns = sorted(df.columns)
    got = Counter(tuple(r[c] for c in columns) for r in df.collect())
    result = oracle.execute(entry.oracle_sql()[name])
    names = [d[0] for d in result.description]
    expected = Counter(tuple(dict(zip(names, row))[c] for c in columns) for row in result.fetchall())
    assert sorted(names) == columns
    assert got == expected


def test_entry(spark):
    assert entry.entry(spark).count() > 0
