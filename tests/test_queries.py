"""Each registered query of the library against its SQL on the smallest tables."""

import duckdb
import pytest

from clusterlake.plans.catalog import QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, name):
    f, sql = QUERIES[name]
    df = f(spark, sf)
    rows = df.collect()
    if sql is None:
        assert rows
        return
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    rel = c.sql(sql)
    cols = sorted(rel.columns)
    assert sorted(df.columns) == cols
    order = [rel.columns.index(x) for x in cols]
    want = sorted((tuple(r[i] for i in order) for r in rel.fetchall()), key=str)
    assert sorted((tuple(r[x] for x in cols) for r in rows), key=str) == want
