"""Every registered query against its SQL in an independent engine."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as entry
from scripts.check import TABLES, compare
from tests.conftest import SMALL
from twinkeep.plans import oracle, registry


@pytest.fixture(scope="module")
def engine():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL}/{table}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(registry.registered()))
def test_query_matches_sql(spark, engine, name):
    verdict, _ = compare(spark, engine, name, SMALL)
    assert verdict.startswith("ok"), verdict
    assert "types" not in verdict, verdict


def test_every_query_has_sql():
    assert set(oracle.oracle_sql()) == set(registry.registered())


def test_entry_offers_every_query():
    assert set(registry.registered()) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_counts(spark):
    assert entry.entry(spark).count() == 330
