"""Every registered query of the reference's own operators against its SQL twin on the smallest tables."""

import math
import os

import duckdb
import pytest

from millrace import plans

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        p = f"{DATA}/{f}"
        c.sql(f"create view {f.split('.')[0]} as select * from '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    return tuple(norm(x) for x in v) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(plans.queries()))
def test_query(spark, duck, name):
    df = plans.queries()[name](spark, DATA)
    got = df.collect()
    if name not in plans.oracle_sql():
        assert got
        return
    twin = duck.sql(plans.oracle_sql()[name])
    assert sorted(df.columns) == sorted(twin.columns)
    at = [twin.columns.index(c) for c in df.columns]
    key = lambda r: [(x is None, str(x)) for x in r]
    assert sorted((tuple(map(norm, r)) for r in got), key=key) == sorted((tuple(norm(r[i]) for i in at) for r in twin.fetchall()), key=key)
