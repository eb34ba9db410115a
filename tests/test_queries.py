"""Every query with SQL against DuckDB on the smallest tables."""

import os
from glob import glob

import duckdb
import pytest

from quillspark.plans import catalog


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for p in glob(f"{small}/*.parquet"):
        name = os.path.basename(p)[:-8]
        con.execute(f"CREATE VIEW {name} AS FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return con


def norm(rows):
    return sorted(tuple(repr(round(v, 6)) if isinstance(v, float) else repr(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_against_sql(spark, small, duck, name):
    df = catalog.QUERIES[name](spark, small)
    cursor = duck.execute(catalog.ORACLE_SQL[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert norm(df.select(*columns).collect()) == norm(cursor.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_other_queries_run(spark, small, name):
    assert catalog.QUERIES[name](spark, small).count() > 0
