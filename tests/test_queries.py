"""Every query against its SQL on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as driver
from threadloom import code_queries, more_queries, queries  # noqa: F401 (they add their queries)

SF = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.6g}")
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_matches_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    answer = duck.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in answer.description]
    assert sorted(names) == columns
    want = [tuple(plain(r[names.index(c)]) for c in columns) for r in answer.fetchall()]
    got = [tuple(plain(r[c]) for c in columns) for r in df.collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_entry_runs(spark):
    assert driver.entry(spark).count() == 5


def test_all_sql_has_a_query():
    assert set(driver.oracle_sql()) <= set(driver.queries())


def test_flagship_filter_reaches_the_scan(spark):
    plan = queries.topk_dot_sql(spark, SF)._jdf.queryExecution().toString()
    assert "LessThan(label,5)" in plan
    assert "TakeOrderedAndProject" in plan
