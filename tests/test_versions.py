"""Versions with fingerprint trees against the full comparison."""

from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

from twinkeep.operators import compare, versions

ROWS = 40_000


@pytest.fixture(scope="module")
def base(spark):
    return spark.range(ROWS).select(
        "id", (F.col("id") * 7 % 1000).alias("v"), F.concat(F.lit("text "), F.col("id") % 100).alias("s")
    )


def bag(frame):
    return Counter(map(tuple, frame.collect()))


def written(frame, folder, name, **more):
    return versions.write_version(frame, f"{folder}/{name}", ["id"], fanout=8, **more)


def test_same_differences_as_the_full_comparison(spark, base, folder):
    changed = base.where("id % 9973 <> 5").withColumn("v", F.when(F.col("id") == 77, -1).otherwise(F.col("v")))
    changed = changed.unionByName(base.where("id = 123")).unionByName(base.where("id < 3").withColumn("id", F.col("id") + ROWS))
    left, right = written(base, folder, "a"), written(changed, folder, "b")
    found = versions.compare_versions(spark, left, right)
    full = compare.find_differences(base, changed)
    assert bag(found.missing().select(base.columns)) == bag(full.missing().select(base.columns))
    assert bag(found.extra().select(base.columns)) == bag(full.extra().select(base.columns))


def test_reads_in_proportion_to_the_change(spark, base, folder):
    """One changed row: one folder of eight is opened on each side, and one leaf bucket of 512 remains."""
    changed = base.withColumn("v", F.when(F.col("id") == 77, -1).otherwise(F.col("v")))
    left, right = written(base, folder, "a"), written(changed, folder, "b")
    found, named = versions.differing_nodes(spark, left, right)
    assert len(named) == 1 and found.count() == 1
    sides = versions.changed_rows_of(spark, left, right)
    for version, side in zip((left, right), sides):
        plan = side._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [isnotnull(_top" in plan or "PartitionFilters: [(_top" in plan
        assert "PushedFilters: [IsNotNull(_bucket), EqualTo(_bucket" in plan
        assert side.count() < ROWS / 200
        assert len(version.rows(spark).inputFiles()) >= 8


def test_equal_empty_and_many_differences(spark, base, folder, monkeypatch):
    left, same = written(base, folder, "a"), written(base.repartition(3), folder, "same")
    assert versions.differing_nodes(spark, left, same)[1] == []
    assert versions.compare_versions(spark, left, same).missing().count() == 0
    empty = written(base.limit(0), folder, "empty")
    assert versions.compare_versions(spark, left, empty).missing().count() == ROWS
    monkeypatch.setattr(versions, "NAMED_NODES", 3)
    other = written(base.where("id % 50 <> 1"), folder, "other")
    assert versions.differing_nodes(spark, left, other)[1] is None
    assert versions.compare_versions(spark, left, other).missing().count() == ROWS // 50
    with pytest.raises(ValueError):
        versions.differing_nodes(spark, left, versions.Version(left.path, 4, 3, left.schema))
    assert versions.open_version(spark, left.path) == left


def test_types_of_the_other_side(spark, folder):
    left = spark.createDataFrame([(1, 1.0, None), (2, 2.5, "")], "id int, v double, s string")
    right = spark.createDataFrame([(1, 1, ""), (2, 3, None)], "id long, v int, s string")
    a, b = written(left, folder, "a", like=right), written(right, folder, "b", like=left)
    assert [r.id for r in versions.compare_versions(spark, a, b).missing().collect()] == [2]
