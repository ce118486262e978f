"""Every query of the scan operators against its DuckDB SQL."""

import os

import duckdb
import pytest

import __spark_entry__
from linetide.plans import catalogue

SMALL = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="the tables are not here")
@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "pages", "conversations"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL}/{table}.parquet'")
    df = catalogue.queries()[name](spark, SMALL)
    want = con.sql(catalogue.oracle_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    assert sorted(map(str, (tuple(r) for r in df.select(*columns).collect()))) == sorted(map(str, want.select(*(duckdb.ColumnExpression(c) for c in columns)).fetchall()))


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="the tables are not here")
def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
