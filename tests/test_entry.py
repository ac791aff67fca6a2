"""Driver contract: entry runs, every oracle has a query, names line up."""

import __spark_entry__ as E


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert df.columns == ["lang", "rows", "words"]
    assert sum(r.rows for r in rows) > 0


def test_oracles_subset_of_queries():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 90


def test_flagship_matches_duckdb(spark):
    import duckdb

    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM read_parquet('/root/testdata/sf0.001/documents.parquet')")
    want = sorted(tuple(r) for r in con.sql(E.oracle_sql()[E.FLAGSHIP]).fetchall())
    got = sorted((r.lang, r.rows, r.words) for r in E.entry(spark).collect())
    assert got == want
