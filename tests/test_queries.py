"""Every registered query against its SQL oracle, and the shape of its plan."""

import duckdb
import pytest

from __spark_entry__ import entry
from querymill.registry.base import ORACLES as BODIES
from querymill.registry.base import QUERIES, TABLES, oracle_text

FOLDER = "/root/testdata/sf0.001"
ORACLES = {name: oracle_text(body) for name, body in BODIES.items()}


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for table in TABLES:
        con.execute(f"create view {table} as from '{FOLDER}/{table}.parquet'")
    return con


def plain(value):
    return f"{value:.9g}" if isinstance(value, float) else repr(value)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)
    assert len(QUERIES) == 87


def test_entry(spark):
    assert entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(v) for v in row) for row in df.select(*columns).collect())
    rel = con.sql(ORACLES[name])
    assert sorted(rel.columns) == columns
    places = [rel.columns.index(c) for c in columns]
    assert got == sorted(tuple(plain(row[i]) for i in places) for row in rel.fetchall())
    plan = df._jdf.queryExecution().toString()
    for node in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"):
        assert node not in plan
