import duckdb
import pytest

from tidemark.llm import catalog


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, name):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    df = catalog.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    con.execute(catalog.ORACLES[name])
    names = [d[0] for d in con.description]
    assert sorted(names) == cols
    assert sorted(tuple(r[c] for c in cols) for r in df.collect()) == sorted(tuple(r[names.index(c)] for c in cols) for r in con.fetchall())
