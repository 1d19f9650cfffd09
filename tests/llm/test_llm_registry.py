"""Every llm query with SQL gives the rows of its SQL; the others run."""

import glob
import os

import duckdb
import pytest

from affinis.llm.queries import ORACLE, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, name):
    df = QUERIES[name](spark, data)
    got = sorted(tuple(str(r[c]) for c in sorted(df.columns)) for r in df.collect())
    if name in ORACLE:
        con = duckdb.connect()
        for p in glob.glob(f"{data}/*.parquet"):
            con.execute(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{p}')")
        answer = con.execute(ORACLE[name])
        columns = [c[0] for c in answer.description]
        order = sorted(range(len(columns)), key=lambda i: columns[i])
        assert [columns[i] for i in order] == sorted(df.columns)
        assert got == sorted(tuple(str(row[i]) for i in order) for row in answer.fetchall())
    else:
        assert df.columns
