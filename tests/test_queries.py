"""Registered queries against their SQL."""

import duckdb
import pytest

import __spark_entry__ as contract

SF_DIR = "/root/testdata/sf0.001"
TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "embeddings", "pages", "benchmark", "labels", "conversations",
]
QUERIES, ORACLE = dict(contract.registry.QUERIES), contract.oracle.statements()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in TABLES:
        connection.sql(f"create view {table} as select * from '{SF_DIR}/{table}.parquet'")
    return connection


def test_every_statement_has_a_query():
    assert set(ORACLE) == set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, duck, name):
    found = QUERIES[name](spark, SF_DIR)
    wanted = duck.sql(ORACLE[name])
    columns = sorted(found.columns)
    assert columns == sorted(wanted.columns)
    place = [wanted.columns.index(c) for c in columns]
    left = sorted((tuple(r[c] for c in columns) for r in found.collect()), key=repr)
    right = sorted((tuple(r[i] for i in place) for r in wanted.fetchall()), key=repr)
    assert left == right


def test_entry(spark):
    found = contract.entry(spark).collect()
    assert len(found) == 20
    assert all(r.content.startswith(f"# Project Context: {r.repo}\n") for r in found)
