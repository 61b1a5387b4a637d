"""Every registered signal query against its SQL, on the smallest tables."""

import duckdb
import pytest

import __spark_entry__  # noqa: F401  (registers the queries)
from tidefold.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "events embeddings documents pages benchmark labels conversations orders lineitem".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_equals_its_oracle(spark, duck, name):
    got = registry.queries()[name](spark, SF)
    columns = sorted(got.columns)
    want = duck.sql(registry.oracle_sql()[name])
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    rows = sorted((tuple(r[c] for c in columns) for r in got.collect()), key=str)
    assert rows == sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=str)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
