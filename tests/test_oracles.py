"""Every query with SQL against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.mark.parametrize("name", [n for n in __spark_entry__.plans.QUERIES if n in __spark_entry__.plans.ORACLES])
def test_oracle(spark, name):
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"create view {f.removesuffix('.parquet')} as select * from read_parquet('{SF}/{f}')")
    got = __spark_entry__.queries()[name](spark, SF).toPandas()
    want = c.sql(__spark_entry__.oracle_sql()[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    rows = lambda d: sorted(map(tuple, d[cols].astype(str).values.tolist()))
    assert rows(got) == rows(want)
