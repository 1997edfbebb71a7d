"""Driver contract: entry runs on sf0.001, every oracle names a query."""

import __spark_entry__ as E


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert set(df.columns) == {"member", "side", "n_tuples", "n_claims"}
    assert len(rows) >= 0


def test_oracles_name_queries():
    assert set(E.oracle_sql()) <= set(E.queries())
