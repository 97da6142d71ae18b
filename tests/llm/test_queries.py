"""The registered queries against their SQL, on the smallest tables."""

import os

import duckdb
import pytest

from tidemark.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, name):
    con = duckdb.connect()
    for file in os.listdir(SF):
        con.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF}/{file}')")
    want = con.execute(ORACLES[name])
    columns = sorted(c[0] for c in want.description)
    order = [[c[0] for c in want.description].index(c) for c in columns]
    got = QUERIES[name](spark, SF)
    assert sorted(got.columns) == columns
    assert sorted((repr([r[c] for c in columns]) for r in got.collect())) == sorted(repr([r[i] for i in order]) for r in want.fetchall())
