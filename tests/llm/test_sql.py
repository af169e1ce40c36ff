"""The operators that SQL expresses, against DuckDB over the smallest tables."""

import duckdb
import pytest

from sparkquire.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "embeddings"):
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    r = c.execute(queries.oracle_sql()[name])
    names = [d[0] for d in r.description]
    got = queries.queries()[name](spark, SF)
    assert sorted(names) == sorted(got.columns)
    assert sorted(map(repr, r.fetchall())) == sorted(repr(tuple(x[n] for n in names)) for x in got.collect())
