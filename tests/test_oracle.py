"""Every query of the library against its DuckDB oracle SQL on the sf0.001 tables.

Rows, column names and values (floats to 6 places) must match, order-insensitively.
The training-data queries have tests of their own.
"""

import duckdb
import pytest

import __spark_entry__ as E
from tools.check_oracle import TABLES, rows_of

SF = "/root/testdata/sf0.001"
KEYS = sorted(E.catalog.all_queries())
SQL = E.oracle.all_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def test_every_key_has_sql():
    assert set(KEYS) == set(SQL)
    assert len(KEYS) >= 80
    assert set(KEYS) <= set(E.queries()) and set(SQL) <= set(E.oracle_sql())


@pytest.mark.parametrize("key", KEYS)
def test_query_matches_oracle(spark, con, key):
    df = E.queries()[key](spark, SF)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    res = con.execute(SQL[key])
    cols = [d[0] for d in res.description]
    want = rows_of(cols, res.fetchall())
    assert sorted(df.columns) == sorted(cols)
    assert got == want


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["query_id", "rank", "hall_id", "total_score", "is_gold"]
    assert df.count() >= 0
