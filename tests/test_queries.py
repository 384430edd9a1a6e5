"""Every query with SQL against DuckDB at the smallest size."""

import glob
import math
import os

import duckdb
import pytest

from maploom.plans.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"
#: Needs more rows than the smallest size has, or is timed in bench.py.
SLOW = {"fill_all_patterns"}


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, (bool, str)):
        return str(v)
    return f"{float(v) + 0.0:.9g}"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from read_parquet('{path}')")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="the given tables aren't here")
@pytest.mark.parametrize("name", sorted(set(QUERIES) - SLOW))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    names = sorted(df.columns)
    got = [tuple(plain(r[c]) for c in names) for r in df.collect()]
    if name not in SQL:
        assert got
        return
    cur = duck.execute(SQL[name])
    have = [d[0] for d in cur.description]
    assert sorted(have) == names
    want = [tuple(plain(r[have.index(c)]) for c in names) for r in cur.fetchall()]
    key = lambda r: tuple((v is not None, v or "") for v in r)
    assert sorted(got, key=key) == sorted(want, key=key)
