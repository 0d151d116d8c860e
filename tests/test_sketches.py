"""Sync candidates by sketches against the exact profiles."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from twinkeep.operators import schema

ROWS = 200_000


@pytest.fixture(scope="module")
def wide(spark):
    from twinkeep.session import work_path

    path = work_path(spark, "sketched")
    spark.range(ROWS).selectExpr(
        "id AS `a key`",
        "id % 50000 AS repeated",
        "IF(id % 3 = 0, NULL, CAST(id AS STRING)) AS holes",
        "timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, least(id, 199000)) AS late",
        "CASE WHEN id < 5 THEN double('NaN') WHEN id < 9 THEN -0.0D WHEN id < 12 THEN 0.0D ELSE id / 7 END AS x",
        "CAST(NULL AS DATE) AS none",
        "CAST(CAST(least(id, 199990) AS STRING) AS BINARY) AS bytes",
        "timestamp_seconds(id % 7777) AS at",
    ).repartition(6).write.parquet(path)
    return spark.read.parquet(path)


@pytest.mark.parametrize("lg_k", [10, 14])
def test_counts_are_exact_and_estimates_within_their_error(wide, lg_k):
    found = {r.column_name: r for r in schema.sketch_columns(wide, wide.columns, lg_k).collect()}
    assert list(found) == wide.columns
    for name, row in found.items():
        exact = schema.profile_candidate(wide, name).first()
        assert (row.total_rows, row.null_rows, row.ties_at_max) == (
            exact.total_rows, exact.null_rows, exact.ties_at_max
        )
        error = schema.SIGMAS * schema.sketch_error(lg_k)
        assert abs(row.distinct_estimate - exact.distinct_values) <= error * exact.distinct_values
        assert row.may_be_unique or not exact.is_unique
    assert [n for n, r in found.items() if r.may_be_unique] in (["a key", "late", "x", "bytes"], ["a key", "late", "x"], ["a key", "x", "bytes"], ["a key", "x"])


def test_an_empty_table(wide):
    rows = schema.sketch_columns(wide.limit(0), wide.columns).collect()
    assert [(r.total_rows, r.null_rows, r.distinct_estimate, r.ties_at_max) for r in rows] == [(0, 0, 0, 0)] * 8
    assert all(r.may_be_unique for r in rows)


def test_sketches_of_parts_merge(wide):
    parts = [
        schema.sketch_columns(wide.where(F.col("repeated") % 3 == p), ["a key", "repeated"]) for p in range(3)
    ]
    merged = parts[0].union(parts[1]).union(parts[2]).groupBy("column_name")
    found = dict(merged.agg(F.hll_sketch_estimate(F.hll_union_agg("sketch"))).collect())
    error = schema.SIGMAS * schema.sketch_error()
    assert abs(found["a key"] - ROWS) <= error * ROWS
    assert abs(found["repeated"] - 50_000) <= error * 50_000


def test_no_value_is_shuffled_and_maxima_reach_the_scan(wide):
    plan = schema.sketch_columns(wide, ["a key", "late"])._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(a key" not in plan
    assert "EqualTo(late,2024-01-03" in plan
