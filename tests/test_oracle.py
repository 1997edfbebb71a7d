"""The correctness gate as a test: every query with oracle SQL, Spark vs DuckDB at sf0.001."""

import os

import duckdb
import pytest

import __spark_entry__ as E
from scripts.compare_oracle import TABLES, digest
from tests.conftest import SF001

ORACLE = E.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        p = f"{SF001}/{t}.parquet"
        if os.path.exists(p):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    yield c
    c.close()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, con, name):
    s = E.queries()[name](spark, SF001).toPandas()
    d = con.execute(ORACLE[name]).df()
    assert sorted(s.columns) == sorted(d.columns)
    assert len(s) == len(d)
    assert digest(s) == digest(d)
