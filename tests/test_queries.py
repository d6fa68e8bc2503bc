"""The engine's queries against their SQL, run by DuckDB on the same tables."""

import os

import duckdb
import pytest

from millrace import job_queries as queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 4)
    if isinstance(v, dict):
        return sorted((plain(k), plain(x)) for k, x in v.items())
    return [plain(x) for x in v] if isinstance(v, list | tuple) else v


def rows(names, found):
    at = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in at], sorted((tuple(plain(r[i]) for i in at) for r in found), key=repr)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    got = queries.queries()[name](spark, SF)
    want = duck.execute(queries.oracle_sql()[name])
    assert rows(got.columns, got.collect()) == rows([c[0] for c in want.description], want.fetchall())
