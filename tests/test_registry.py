"""Every core query with SQL gives the rows of its SQL on the smallest data; llm queries are tested beside their operators."""

import glob
import os

import duckdb
import pytest

from affinis.plans import catalog, problems, workflows

QUERIES = problems.QUERIES | catalog.QUERIES | workflows.QUERIES
ORACLE = problems.ORACLE | catalog.ORACLE | workflows.ORACLE


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    text = lambda v: "" if v is None or v != v else repr(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return [columns[i] for i in order], sorted(tuple(text(row[i]) for i in order) for row in rows)


@pytest.fixture(scope="module")
def sql(data):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for p in glob.glob(f"{data}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{p}')")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, sql, name):
    df = QUERIES[name](spark, data)
    got = canonical(df.columns, df.collect())
    if name in ORACLE:
        answer = sql.execute(ORACLE[name])
        columns = [c[0] for c in answer.description]
        assert got == canonical(columns, answer.fetchall())
    else:
        assert got[0]
