import os

import pytest

import __spark_entry__ as entry
from evidentia import oracle, queries

SMALL = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables here")


def test_names():
    assert set(oracle.oracle_sql()) <= set(queries.queries()) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


@needs_data
def test_entry(spark):
    out = entry.entry(spark).collect()
    assert len(out) == 1 and 0 <= out[0]["score"] <= 100


@needs_data
@pytest.mark.parametrize("name", sorted(oracle.oracle_sql()))
def test_query_equals_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for t in ("documents", "embeddings", "labels", "events", "conversations", "benchmark", "pages", "part", "orders", "lineitem", "region"):
        con.sql(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    ours, theirs = queries.queries()[name](spark, SMALL).toPandas(), con.sql(oracle.oracle_sql()[name]).df()
    names = sorted(ours.columns)
    assert names == sorted(theirs.columns)
    plain = lambda df: sorted(tuple("-" if v is None or v != v else repr(round(float(v), 6)) if isinstance(v, (int, float)) else str(v) for v in r) for r in df[names].astype(object).itertuples(index=False))
    assert plain(ours) == plain(theirs)
    # No table is left in memory. What one scan is shared for is tested by itself.
    assert not spark.sparkContext._jsc.getPersistentRDDs()
    # Nothing is compared with nothing, but where the corpus has no such rows at its real threshold.
    assert len(ours) > 0
