"""Corpus queries against their SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

from activity_engine.llm.queries import QUERIES, SQL

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for p in glob.glob(f"{SMALL}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    df = QUERIES[name](spark, SMALL)
    columns = sorted(df.columns)
    cursor = con.execute(SQL[name])
    names = [x[0] for x in cursor.description]
    assert sorted(names) == columns
    want = sorted(str([r[names.index(c)] for c in columns]) for r in cursor.fetchall())
    assert sorted(str([r[c] for c in columns]) for r in df.collect()) == want
