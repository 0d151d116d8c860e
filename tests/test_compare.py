from __future__ import annotations

from collections import Counter
from random import Random

import pytest
from pyspark.sql import functions as F

from tests.conftest import SMALL
from twinkeep.operators import changes, compare, schema
from twinkeep.plans.inputs import derived, table

SCHEMA = "k bigint, v string"


@pytest.fixture(scope="module")
def pair(spark):
    return derived(spark, SMALL, "replica_src"), derived(spark, SMALL, "replica_dst")


def test_known_counts(pair):
    row = compare.compare_counts(*pair).first().asDict()
    assert row == {
        "rows_source": 1560,
        "rows_destination": 1403,
        "duplicate_source_rows": 60,
        "duplicate_destination_rows": 38,
        "missing_rows": 330,
        "extra_rows": 173,
        "missing_distinct": 300,
        "extra_distinct": 165,
        "both_distinct": 1200,
    }


def test_wrong_answers_are_told_apart(pair):
    source, destination = pair
    assert source.exceptAll(destination).count() != 330
    assert source.subtract(destination).count() != 300


def test_preview_numbers(pair):
    row = compare.partial_preview(*pair, ["o_orderkey", "o_totalprice"], "o_orderkey > 1000")
    assert row.select("rows_source", "would_insert", "already_synced").first() == (519, 100, 399)


def test_distinct_source_is_missing_plus_both(pair):
    row = compare.compare_counts(*pair).first()
    assert row.rows_source - row.duplicate_source_rows == row.missing_distinct + row.both_distinct


def test_self_compare_is_clean(spark):
    lineitem = table(spark, SMALL, "lineitem")
    row = compare.compare_counts(lineitem, lineitem).first()
    assert (row.missing_rows, row.extra_rows) == (0, 0)
    found = compare.find_differences(lineitem, lineitem)
    assert found.missing().isEmpty() and found.extra().isEmpty()
    fingerprints = compare.bucket_fingerprints(lineitem, lineitem, F.col("l_orderkey") % 16)
    assert fingerprints.where("NOT is_equal").isEmpty()


def test_fingerprint_sees_swapped_copies(spark):
    """Two copies of one row against two of another: xor alone would not tell."""
    a = spark.createDataFrame([(1, "x"), (1, "x")], SCHEMA)
    b = spark.createDataFrame([(1, "y"), (1, "y")], SCHEMA)
    assert not compare.bucket_fingerprints(a, b, F.col("k")).first().is_equal


def test_empty_sides(spark):
    some = spark.createDataFrame([(1, "x"), (1, "x"), (2, None)], SCHEMA)
    none = some.limit(0)
    assert compare.missing_rows(some, none).count() == 3
    assert compare.extra_rows(some, none).count() == 0
    assert compare.extra_rows(none, some).count() == 3
    assert compare.validate_table(none, none).first() == (0, 0, 0, 0, 0, 0)
    assert compare.verify_consistency(some, none).first() == (3, 0, "error")
    assert compare.verify_consistency(none, none).first() == (0, 0, "ok")


def test_no_shared_column_raises(spark):
    a, b = spark.range(1).toDF("a"), spark.range(1).toDF("b")
    with pytest.raises(ValueError):
        compare.missing_rows(a, b)


def test_missing_rows_keep_their_own_values(spark):
    """NULL and '' are equal for the comparison but come back as they were."""
    source = spark.createDataFrame([(1, None), (1, ""), (2, "b")], SCHEMA)
    destination = spark.createDataFrame([(2, "b")], SCHEMA)
    rows = compare.missing_rows(source, destination).collect()
    assert Counter(tuple(r) for r in rows) == Counter([(1, None), (1, "")])


def _row(draw, keys):
    return draw.choice(keys), draw.choice([None, "", "a", "b"])


def brute_missing(left, right):
    there = {(k, v or "") for k, v in right}
    return Counter((k, v) for k, v in left if (k, v or "") not in there)


@pytest.mark.parametrize(
    "hot_copies, broadcast_digests",
    [(10**5, 10**5), (3, 10**5), (3, 1), (1, 1), (10**5, 1)],
)
def test_every_fetch_path_matches_brute_force(spark, hot_copies, broadcast_digests):
    draw = Random(hot_copies + broadcast_digests)
    left, right = ([_row(draw, keys) for _ in range(60)] for keys in (range(6), range(3, 9)))
    source = spark.createDataFrame(left, SCHEMA)
    destination = spark.createDataFrame(right, SCHEMA)
    limits = {"hot_copies": hot_copies, "broadcast_digests": broadcast_digests}
    found = compare.find_differences(source, destination, **limits)
    few = compare.differences_from_few(source, destination, **limits)
    by_bucket = compare.find_differences(source, destination, bucket=F.col("k"), **limits)
    missing, extra = brute_missing(left, right), brute_missing(right, left)
    for differences in (found, few, by_bucket):
        got = Counter(tuple(r) for r in differences.missing().collect())
        assert got == missing
        assert differences.copies(compare.MISSING) == missing.total()
    for differences in (found, by_bucket):
        assert Counter(tuple(r) for r in differences.extra().collect()) == extra


def test_hot_rows_stay_out_of_the_shuffle(spark):
    """A third of all rows are copies of one row, another third of a row both
    sides have; the shuffled part must hold neither."""
    source = spark.range(30_000).selectExpr(
        "CASE WHEN id % 3 = 0 THEN -1 WHEN id % 3 = 1 THEN -2 ELSE id END AS k",
        "'v' AS v",
    )
    destination = spark.createDataFrame([(-2, "v")], SCHEMA)
    found = compare.find_differences(
        source, destination, hot_copies=1000, broadcast_digests=100
    )
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        missing = found.missing()
        assert missing.count() == 20_000
        plan = missing._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in plan and "LeftAnti" in plan and "SortMergeJoin" in plan
    assert found._hot_from("source") == 1000


def test_hot_share_is_bounded(spark):
    source = spark.range(4_000).selectExpr("id % 40 AS k", "'v' AS v")
    found = compare.find_differences(
        source, source.limit(0), hot_copies=10, broadcast_digests=8
    )
    assert found._hot_from("source") == 500
    assert found.missing().count() == 4_000


def test_debug_rows_show_empty_text(spark):
    source = spark.createDataFrame([(1, None), (2, "b")], SCHEMA)
    shown = compare.debug_new_rows(source, source.limit(0), ["k"], limit=1).collect()
    assert [tuple(r) for r in shown] == [(1, "", 2)]


def test_later_copies_fold_values(spark):
    df = spark.createDataFrame([(1, None), (1, ""), (1, ""), (2, "b")], SCHEMA)
    assert [tuple(r) for r in compare.later_copies(df).collect()] == [(1, "", 2)]


def test_odd_column_names(spark):
    names = ["a.b", "it's", 'q"', "back`tick", "sl\\ash", "a b"]
    plain = ", ".join(f"c{i} string" for i in range(len(names)))
    source = spark.createDataFrame([tuple("abcdef"), tuple("ghijkl")], plain).toDF(*names)
    destination = source.limit(1)
    assert compare.missing_rows(source, destination).columns == names
    assert compare.compare_counts(source, destination).first().missing_rows == 1
    profile = schema.profile_types(source).collect()
    assert [r.column_name for r in profile] == names
    assert [tuple(r) for r in changes.delta_summary(source, source).collect()] == [(0, 2, 2)]


def test_wide_tables(spark):
    wide = spark.range(3).selectExpr(*[f"id + {i} AS c{i}" for i in range(400)])
    assert compare.compare_counts(wide, wide.where("c0 > 0")).first().missing_rows == 1


def test_ranking(spark):
    some = spark.createDataFrame([(1, "x"), (1, "x"), (2, "y")], SCHEMA)
    none = some.limit(0)
    deltas = changes.table_deltas(
        {"b": (some, none), "a": (some, none), "c": (some, some), "d": (none, none)}
    )
    ranked = changes.top_changed_tables(deltas).orderBy("rank").collect()
    assert [(r.table_name, r.delta_count, r.is_top) for r in ranked] == [
        ("a", 3, True),
        ("b", 3, True),
        ("c", 0, True),
        ("d", 0, False),
    ]
    assert changes.changed_totals(deltas).first() == (4, 6, 9, 3)


def test_a_comparison_from_few_rows_refuses_what_it_did_not_look_for(spark):
    one, two = spark.range(3).toDF("k"), spark.range(8).toDF("k")
    found = compare.differences_from_few(one, two)
    assert found.missing().isEmpty()
    with pytest.raises(ValueError, match="missing rows only"):
        found.extra()


def test_large_whole_numbers_and_doubles_compare_exactly(spark):
    whole = spark.sql("SELECT 9007199254740993L AS k UNION ALL SELECT 5L UNION ALL SELECT 7L")
    real = spark.sql("SELECT 9007199254740992.0D AS k UNION ALL SELECT 5.0D UNION ALL SELECT 7.5D")
    found = compare.find_differences(whole, real)
    assert sorted(r.k for r in found.missing().collect()) == [7, 9007199254740993]
    same = spark.sql("SELECT CAST(0.1 AS DECIMAL(20, 4)) AS k UNION ALL SELECT 12345678901234.25")
    double = spark.sql("SELECT 0.1D AS k UNION ALL SELECT 12345678901234.25D")
    assert compare.find_differences(same, double).missing().isEmpty()


def test_no_single_task_follows_the_buckets(spark, monkeypatch):
    """Whatever number of buckets differs, broadcast or not, the rows are the same."""
    one, two = spark.range(3000).toDF("k"), spark.range(100, 3000).toDF("k")
    for limit in (compare.BROADCAST_DIGESTS, 5):
        found = compare.find_differences(one, two, bucket=F.col("k"), buckets=64, broadcast_digests=limit)
        assert found.missing().count() == 100
    found.release()
    with pytest.raises(Exception, match="PATH_NOT_FOUND|FILE_NOT_EXIST|FAILED_READ_FILE"):
        found.digests.count()
