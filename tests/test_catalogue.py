"""Every registered query of the engine against its SQL, at the smallest scale."""

import os

import duckdb
import pytest

import __spark_entry__ as entry_module
from docquarry.plans import catalogue, indexed, rules, web  # noqa: F401


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for name in os.listdir(small):
        con.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{small}/{name}'")
    return con


def rows_of(df):
    columns = sorted(df.columns)
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_agrees_with_sql(spark, small, duck, name):
    found = duck.sql(catalogue.ORACLE_SQL[name])
    at = sorted(range(len(found.columns)), key=lambda i: found.columns[i])
    expected = sorted((tuple(r[i] for i in at) for r in found.fetchall()), key=repr)
    assert rows_of(catalogue.QUERIES[name](spark, small)) == expected


def test_entry_has_rows(spark):
    assert entry_module.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(catalogue.ORACLE_SQL) <= set(catalogue.QUERIES)


@pytest.mark.parametrize("name", ["search_diversified", "search_proximity", "search_snippets", "html_cards", "paragraph_reflow"])
def test_queries_without_sql_run(spark, small, name):
    assert catalogue.QUERIES[name](spark, small).columns
