"""Numbering, copies and aligned changes against plain Python."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from twinkeep.operators import changes, copies, ledger
from twinkeep.operators.numbering import number_within, placed


@pytest.mark.parametrize("broadcast", [0, 1000])
def test_copies_of_all_kinds(spark, broadcast):
    rng = random.Random(broadcast)
    data = [(None, None, 0.0), ("", float("nan"), -0.0), ("a", 1.0, 2.0)] * 3
    data += [(rng.choice("abc"), float(rng.randrange(3)), float(rng.randrange(40))) for _ in range(300)]
    frame = spark.createDataFrame(data, "s string, d double, x double").repartition(7)
    marked = copies.mark_copies(frame, broadcast_digests=broadcast).collect()
    numbers = defaultdict(list)
    for r in marked:
        numbers[(r.s or "", 0.0 if r.d is None or r.d != r.d else r.d, r.d is None or r.d != r.d, r.x + 0.0)].append(r.copy_number)
    assert all(sorted(v) == list(range(1, len(v) + 1)) for v in numbers.values())
    assert len(marked) == len(data) and max(map(len, numbers.values())) >= 6


def test_hot_row_spans_partitions(spark):
    """A third of all rows is one row: it is numbered in many tasks, each with a share of its copies."""
    merge = "spark.sql.adaptive.coalescePartitions.enabled"  # which would make one task of so little
    spark.conf.set(merge, "false")
    try:
        _hot_row(spark)
    finally:
        spark.conf.set(merge, "true")


def _hot_row(spark):
    frame = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("v"))
    marked = copies.mark_copies(frame)
    assert marked.where("v = 0").agg(F.min("copy_number"), F.max("copy_number"), F.count_distinct("copy_number")).first()[:] == (1, 10_000, 10_000)
    assert marked.where("v <> 0 AND copy_number <> 1").count() == 0
    parts = placed(frame, ["v"]).where("v = 0").groupBy("_num_part").count().collect()
    assert len(parts) > 2 and max(r["count"] for r in parts) < 9_000


def test_order_nulls_and_empty(spark):
    data = [(None, 3), (None, 1), ("", 2), ("a", None), ("a", 5), ("a", 5)]
    frame = spark.createDataFrame(data, "k string, v int")
    got = number_within(frame, ["k"], [F.col("v").desc_nulls_last()], "place").collect()
    assert Counter((r.k, r.v, r.place) for r in got) == Counter(
        {(None, 3, 1): 1, (None, 1, 2): 1, ("", 2, 1): 1, ("a", 5, 1): 1, ("a", 5, 2): 1, ("a", None, 3): 1}
    )
    assert copies.mark_copies(frame.limit(0)).count() == 0


def test_any_number_of_newest_rows(spark, monkeypatch):
    runs = spark.range(900).select(
        F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 5)).alias("key"),
        (F.col("id") % 50).alias("at"), "id",
    )
    expected = ledger.newest_per_key(runs, ["key"], ["at", "id"], 40).collect()
    monkeypatch.setattr(ledger, "MOST_PER_KEY", 10)
    got = ledger.newest_per_key(runs, ["key"], ["at", "id"], 40)
    assert "row_number" not in got._jdf.queryExecution().toString()
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, expected))


def brute_changes(left, right):
    """Kinds per key by multiset of the rows that one side lacks."""
    out = Counter()
    only_left = [r for r in left if r not in set(right)]
    only_right = [r for r in right if r not in set(left)]
    for key in {r[0] for r in only_left + only_right}:
        a = sum(r[0] == key for r in only_left)
        b = sum(r[0] == key for r in only_right)
        out += Counter({(key, "changed"): min(a, b), (key, "inserted"): a - min(a, b), (key, "deleted"): b - min(a, b)})
    return out


def test_changes_with_repeated_keys(spark):
    rng = random.Random(3)
    left = [(rng.randrange(30), rng.choice("xyz"), rng.randrange(3)) for _ in range(200)]
    right = [(rng.randrange(30), rng.choice("xyz"), rng.randrange(3)) for _ in range(150)] + left[:60]
    frames = [spark.createDataFrame(d, "k int, s string, n int").repartition(4) for d in (left, right)]
    found = changes.changed_rows(*frames, keys=["k"]).collect()
    assert Counter((r.k, r.kind) for r in found) == brute_changes(left, right)
    for r in found:
        assert (r.changes is not None) == (r.kind == "changed")
        for c in r.changes or ():
            assert c.name in ("s", "n") and c.source != c.destination


def test_changes_name_columns_and_values(spark):
    left = spark.createDataFrame([(1, None, 1.0), (2, "b", 2.0), (None, "n", 0.0)], "k int, s string, d double")
    right = spark.createDataFrame([(1, "", 1.5), (3, "c", 3.0), (None, "m", 0.0)], "k int, s string, d float")
    found = {(r.kind, r.k): [tuple(c) for c in r.changes or ()] for r in changes.changed_rows(left, right, ["k"]).collect()}
    assert found == {
        ("changed", 1): [("d", "1.0", "1.5")],
        ("changed", None): [("s", "n", "m")],
        ("inserted", 2): [],
        ("deleted", 3): [],
    }
    assert changes.changed_rows(left, left, ["k"]).count() == 0
    with pytest.raises(ValueError):
        changes.changed_rows(left, right, ["absent"])
