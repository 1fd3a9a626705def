"""Registered queries against their SQL, at the smallest scale."""

from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry
from tessella.plans.bindings import TABLES
from tessella.plans.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS FROM '{SF}/{t}.parquet'")
    return con


def counted(table):
    names = sorted(table.column_names)
    return names, Counter(map(repr, zip(*[table.column(n).to_pylist() for n in names], strict=True)))


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_matches_its_sql(spark, con, name):
    assert counted(QUERIES[name](spark, SF).toArrow()) == counted(con.sql(ORACLE_SQL[name]).to_arrow_table())


def test_contract(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
