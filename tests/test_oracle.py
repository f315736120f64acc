"""Every query with SQL against DuckDB on the smallest data."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"


def core():
    from tidelog.plans import catalogue, training

    return {**training.ORACLE, **catalogue.ORACLE}


def normal(rows):
    return sorted(tuple("~" if v is None else f"{v:.9g}" if isinstance(v, float) else str(v) for v in r) for r in rows)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(core()))
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    got = normal(df.select(*columns).collect())
    cursor = duck.execute(core()[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert got == normal([tuple(r[i] for i in at) for r in cursor.fetchall()])


def test_queries_without_sql_run(spark):
    for name in sorted(set(entry.queries()) - set(entry.oracle_sql())):
        if name[0] in "qx" or name.startswith(("p1_", "p2_", "p5_")):
            assert entry.queries()[name](spark, DATA).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
