"""Queries of the subpackage with SQL against DuckDB on the smallest data."""

import glob
import os

import duckdb
import pytest

from tidelog.llm import queries as Q

DATA = "/root/testdata/sf0.001"


def normal(rows):
    return sorted(tuple("~" if v is None else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(Q.ORACLE))
def test_query(spark, name):
    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    df = Q.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    cursor = con.execute(Q.ORACLE[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert normal(df.select(*columns).collect()) == normal([tuple(r[i] for i in at) for r in cursor.fetchall()])


def test_other_queries_run(spark):
    for name in sorted(set(Q.QUERIES) - set(Q.ORACLE)):
        assert Q.QUERIES[name](spark, DATA).count() >= 0
