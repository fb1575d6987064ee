import duckdb
import pytest

import __spark_entry__ as entry

TABLES = ("documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def test_flagship(spark):
    out = entry.entry(spark).collect()
    assert out and all(r.largest_token_size <= 128 for r in out)


def test_oracles_belong_to_queries():
    assert entry.oracle_sql().keys() <= entry.queries().keys()
    assert all(isinstance(sql, str) for sql in entry.oracle_sql().values())


@pytest.mark.parametrize("name", sorted(n for n in entry.oracle_sql() if not n.startswith("op1_")))
def test_query_equals_its_sql(spark, sf, name):
    got = entry.queries()[name](spark, sf).toPandas()
    with duckdb.connect() as c:
        for t in TABLES:
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
        want = c.execute(entry.oracle_sql()[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = lambda df: sorted(map(str, df[columns].itertuples(index=False, name=None)))
    assert rows(got) == rows(want)
