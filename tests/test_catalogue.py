import os

import duckdb
import pytest

from ontoloom.plans import catalogue

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in catalogue.TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got = catalogue.QUERIES[name](spark, DATA)
    want = con.sql(catalogue.SQL[name])
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    rows = lambda r: sorted(map(repr, r))
    assert rows(tuple(x[c] for c in cols) for x in got.collect()) == rows(want.select(*cols).fetchall())
