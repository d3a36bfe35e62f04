"""Operators that SQL can express, on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables here")
@pytest.mark.parametrize("name", ["op9_warc", "op12_prefixtrie", "op13_vectorcodes"])
def test_operator_equals_its_sql(spark, name):
    df = entry.queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    con = duckdb.connect()
    for f in os.listdir(FOLDER):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{FOLDER}/{f}'")
    theirs = con.sql(f"select {', '.join(columns)} from ({entry.oracle_sql()[name]})").fetchall()
    assert sorted(map(str, (tuple(r[c] for c in columns) for r in df.collect()))) == sorted(map(str, theirs))
