"""Queries of the subpackage that have SQL against DuckDB, on whole tables."""

import glob
import os

import duckdb
import pytest
from gridquarry.llm.oracles import ORACLES
from gridquarry.llm.queries import oracle_sql, queries


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    sf = "/root/testdata/sf0.01"
    duck = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        duck.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    found = duck.execute(oracle_sql()[name])
    names = [d[0] for d in found.description]
    frame = queries()[name](spark, sf)
    assert sorted(names) == sorted(frame.columns)
    assert sorted(map(tuple, frame.select(names).collect())) == sorted(found.fetchall())
