"""Every query against its SQL in DuckDB, over the smallest tables."""

import math

import duckdb
import pytest

from sparkquire.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    got = catalog.queries()[name](spark, SF)
    rows = sorted(repr(tuple(plain(r[c]) for c in sorted(got.columns))) for r in got.collect())
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    r = duck.execute(sql)
    names = [d[0] for d in r.description]
    assert sorted(names) == sorted(got.columns)
    at = [names.index(c) for c in sorted(names)]
    assert rows == sorted(repr(tuple(plain(x[i]) for i in at)) for x in r.fetchall())
