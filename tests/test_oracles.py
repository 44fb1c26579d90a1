"""Every query with SQL against DuckDB on the smallest tables."""

import math

import duckdb
import pytest

from lumenrank import queries as library

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5)
    return tuple(map(norm, v)) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(library.SQL))
def test_query_equals_sql(spark, db, name):
    df = library.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(norm(r[c]) for c in columns) for r in df.collect()), key=repr)
    r = db.sql(library.SQL[name])
    assert sorted(r.columns) == columns
    want = sorted((tuple(norm(x[r.columns.index(c)]) for c in columns) for x in r.fetchall()), key=repr)
    assert got == want
