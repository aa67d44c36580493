"""Every query with an oracle against DuckDB on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest
from gridquarry.plans import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        connection.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return connection


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9)
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


#: Second names of one query are the same function, which is run once.
FIRST = {fn: name for name, fn in reversed(sorted(QUERIES.items()))}


@pytest.mark.parametrize("name", sorted(name for name in FIRST.values() if name in ORACLES))
def test_query_equals_oracle(spark, duck, name):
    frame = QUERIES[name](spark, SF)
    columns = sorted(frame.columns)
    found = duck.execute(ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall()), key=str)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in frame.collect()), key=str)
    assert got == want
    assert got or name in ("duplicate_ids", "empty_masks", "vocabulary_check")


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(ORACLES) <= set(entry.queries())
