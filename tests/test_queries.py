"""Every query with SQL gives the rows of its SQL on the smallest tables; the others run."""

import datetime
import math
import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry
from epiloom import queries as core

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 9)
    if isinstance(x, (list, tuple)):
        return tuple(plain(y) for y in x)
    if isinstance(x, dict):
        return tuple(plain(y) for y in x.values())
    if hasattr(x, "asDict"):
        return tuple(plain(y) for y in x)
    if isinstance(x, (bytearray, memoryview)):
        return bytes(x)
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None)
    return x


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF}/{f}')")
    return con


@pytest.mark.parametrize("name", sorted(core.QUERIES))
def test_core_query(spark, db, name):
    df = core.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rows = Counter(tuple(plain(r[c]) for c in columns) for r in df.collect())
    if name in core.SQL:
        got = db.execute(core.SQL[name])
        names = [d[0] for d in got.description]
        assert sorted(names) == columns
        at = [names.index(c) for c in columns]
        assert rows == Counter(tuple(plain(r[i]) for i in at) for r in got.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() >= 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
