"""The registered queries against their SQL, on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from tidemark.plans import queries as plans

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF}/{name}')")
    return con


def plain(value):
    if isinstance(value, float) and value == value and abs(value) < 1e15 and value == int(value):
        return int(value)
    return "nan" if value != value else value


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted([names[i] for i in order] for _ in [0]) + sorted(([plain(v[i]) for i in order] for v in values), key=repr)


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, duck, name):
    got = plans.QUERIES[name](spark, SF)
    found = [tuple(r) for r in got.collect()]
    if name in plans.ORACLES:
        want = duck.execute(plans.ORACLES[name])
        columns = [c[0] for c in want.description]
        assert rows(got.columns, found) == rows(columns, want.fetchall())
    else:
        assert found


def test_entry(spark):
    assert entry.entry(spark).count() == 1000
    assert set(plans.QUERIES) <= set(entry.queries()) and set(plans.ORACLES) <= set(entry.oracle_sql())
    assert set(entry.oracle_sql()) <= set(entry.queries())
