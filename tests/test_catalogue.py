"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import math
import os

import duckdb
import pytest

from lodestar import catalogue

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, ORACLE = catalogue.queries(), catalogue.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5)
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, list | tuple):
        return str([plain(x) for x in v])
    return int(v) if type(v).__name__ == "Decimal" else v


def rows(names, values):
    return sorted((tuple(plain(r[n]) for n in names) for r in values), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF)
    collected = [r.asDict() for r in got.collect()]
    if name not in ORACLE:
        return
    want = duck.sql(ORACLE[name])
    assert sorted(want.columns) == sorted(got.columns)
    names = sorted(got.columns)
    assert rows(names, collected) == rows(names, [dict(zip(want.columns, r, strict=True)) for r in want.fetchall()])
