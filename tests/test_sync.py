from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

from tests.conftest import SMALL
from twinkeep.functions.names import target_table
from twinkeep.operators import compare, ledger, sync
from twinkeep.plans.inputs import derived, table
from twinkeep.sources.ledger_tables import (
    DATABASE_RUNS,
    RUN_LOG,
    TABLE_RUNS,
    append_rows,
    create_ledgers,
)
from twinkeep.sources.sinks import append_evolving

ROW = "k bigint, v string"


def bag(df):
    return Counter(tuple(r) for r in df.collect())


def rows(spark, *pairs):
    return spark.createDataFrame(list(pairs), ROW)


def test_full_sync_keeps_the_watermark(spark, namespace):
    done = sync.full_sync(spark, rows(spark, (1, "a"), (9, "b"), (10, "c")), f"{namespace}.t", "k")
    assert (done.rows_written, done.watermark) == (3, sync.Watermark("10", "bigint"))


def test_full_sync_of_nothing_creates_nothing(spark, namespace):
    done = sync.full_sync(spark, rows(spark, (1, "a")).limit(0), f"{namespace}.t", "k")
    assert done.rows_written == 0
    assert not spark.catalog.tableExists(f"{namespace}.t")


def test_range_is_strict_and_typed(spark, namespace):
    """9 is below 10 as a number, above it as text."""
    target = f"{namespace}.t"
    first = sync.full_sync(spark, rows(spark, (9, "a"), (10, "b")), target, "k")
    done = sync.incremental_sync(
        spark, rows(spark, (9, "new"), (10, "new"), (11, "c")), target, "k", first.watermark
    )
    assert (done.route, done.rows_written, done.watermark.text) == ("range", 1, "11")
    assert bag(spark.table(target)) == Counter([(9, "a"), (10, "b"), (11, "c")])


def test_ties_at_the_end_all_arrive(spark, namespace):
    target = f"{namespace}.t"
    first = sync.full_sync(spark, rows(spark, (1, "a")), target, "k")
    source = spark.range(50).selectExpr("1 + id % 2 AS k", "CAST(id AS string) AS v")
    done = sync.incremental_sync(spark, source, target, "k", first.watermark)
    assert done.rows_written == 25


def test_binary_row_versions_sync_whole(spark, namespace):
    target = f"{namespace}.t"
    source = spark.sql("SELECT unhex(h) AS k, h AS v FROM VALUES ('00000000000007D1'), ('FF80'), ('00') AS t(h)")
    first = sync.full_sync(spark, source, target, "k")
    assert (first.rows_written, spark.table(target).count()) == (3, 3)
    assert first.watermark == sync.Watermark("FF80", "binary")
    more = source.unionAll(spark.sql("SELECT unhex('FF81') AS k, 'new' AS v"))
    done = sync.incremental_sync(spark, more, target, "k", first.watermark)
    assert (done.route, done.rows_written, done.watermark.text) == ("range", 1, "FF81")
    assert bag(spark.table(target)) == bag(more)


def test_nan_is_no_watermark(spark, namespace):
    target = f"{namespace}.t"
    source = spark.createDataFrame([(1.5, "a"), (float("nan"), "b"), (None, "c")], "k double, v string")
    first = sync.full_sync(spark, source, target, "k")
    assert (first.rows_written, first.watermark.text) == (3, "1.5")
    more = source.unionAll(spark.createDataFrame([(2.5, "d")], source.schema))
    for expected in (1, 0):
        done = sync.incremental_sync(spark, more, target, "k", first.watermark)
        assert (done.rows_written, done.watermark.text) == (expected, "2.5")
    assert spark.table(target).count() == 4


@pytest.mark.parametrize(
    "value",
    ["CAST(7 AS TINYINT)", "9223372036854775807L", "CAST(1.10 AS DECIMAL(20, 4))", "CAST(0.1 AS FLOAT)", "1e-310D",
     "'a ''\\n ü'", "DATE'2024-02-29'", "TIMESTAMP'2024-01-01 00:00:00.123456'",
     "TIMESTAMP_NTZ'2024-01-01 00:00:00.123456'", "X'00FF'"],
)
def test_watermarks_come_back_as_the_value(spark, namespace, value):
    source = spark.sql(f"SELECT {value} AS k, 1 AS v")
    done = sync.full_sync(spark, source, f"{namespace}.t", "k")
    back = done.watermark.column(source.schema["k"].dataType)
    assert source.where(F.col("k") == back).count() == 1


def test_a_type_without_text_is_refused(spark, namespace):
    with pytest.raises(ValueError, match="exact text"):
        sync.full_sync(spark, spark.sql("SELECT array(1) AS k"), f"{namespace}.t", "k")


def test_full_load_reads_its_source_once(spark, namespace, folder):
    """Two reads of a source that grows would disagree; one read is all there is."""
    rows(spark, (1, "a"), (2, "b")).write.parquet(folder)
    source = spark.read.parquet(folder)
    watched = sync._Watched(source, "k")
    plan = watched.rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "CollectMetrics" in plan
    done = sync.full_sync(spark, source, f"{namespace}.t", "k")
    assert done.rows_written == spark.table(f"{namespace}.t").count() == 2


def test_null_sync_values_arrive_with_the_full_load(spark, namespace):
    target = f"{namespace}.t"
    done = sync.full_sync(spark, rows(spark, (None, "a"), (1, "b")), target, "k")
    assert done.rows_written == 2 and spark.table(target).count() == 2


def test_range_repairs_a_crash_before_the_ledger(spark, namespace):
    """The rows arrived but the watermark did not: the next run adds only the
    rest, however many copies there are."""
    target = f"{namespace}.t"
    first = sync.full_sync(spark, rows(spark, (1, "a")), target, "k")
    append_evolving(spark, rows(spark, (2, "b"), (2, "b")), target)
    source = rows(spark, (1, "a"), (2, "b"), (2, "b"), (3, "c"), (3, "c"))
    done = sync.incremental_sync(spark, source, target, "k", first.watermark)
    assert done.rows_written == 2
    assert bag(spark.table(target)) == bag(source)


def test_empty_source_keeps_the_target(spark, namespace):
    target = f"{namespace}.t"
    source = rows(spark, (1, "a"))
    first = sync.full_sync(spark, source, target, "k")
    done = sync.incremental_sync(spark, source.limit(0), target, "k", first.watermark)
    assert (done.route, done.rows_written, done.watermark) == ("empty_source", 0, first.watermark)
    assert spark.table(target).count() == 1


def test_unreadable_source_raises(spark, namespace, folder):
    source = rows(spark, (1, "a"))
    first = sync.full_sync(spark, source, f"{namespace}.t", "k")
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        sync.incremental_sync(
            spark, spark.read.schema(ROW).parquet(folder), f"{namespace}.t", "k", first.watermark
        )


def test_digest_route_appends_changed_rows_and_then_nothing(spark, namespace):
    target = f"{namespace}.t"
    source, replica = derived(spark, SMALL, "replica_src"), derived(spark, SMALL, "replica_dst")
    sync.full_sync(spark, replica, target)
    first = sync.incremental_sync(spark, source, target, "o_orderkey")
    again = sync.incremental_sync(spark, source, target)
    assert (first.route, first.rows_written) == ("digest", 330)
    assert first.watermark is not None
    assert again.rows_written == 0
    assert compare.compare_counts(source, spark.table(target)).first().missing_rows == 0


def test_digest_route_with_nothing_new_still_moves_the_watermark(spark, namespace):
    source = rows(spark, (1, "a"), (5, "b"))
    sync.full_sync(spark, source, f"{namespace}.t")
    done = sync.incremental_sync(spark, source, f"{namespace}.t", "k")
    assert (done.rows_written, done.watermark.text) == (0, "5")


def test_absent_target_is_loaded(spark, namespace):
    done = sync.incremental_sync(spark, rows(spark, (1, "a"), (1, "a")), f"{namespace}.t")
    assert (done.route, done.rows_written) == ("load", 2)


def test_target_with_more_and_fewer_columns(spark, namespace):
    target = f"{namespace}.t"
    append_evolving(spark, rows(spark, (1, "a")), target)
    wider = spark.createDataFrame([(2, "b", 0.5)], f"{ROW}, w double")
    assert append_evolving(spark, wider, target) == ["w"]
    assert append_evolving(spark, spark.createDataFrame([("c",)], "v string"), target) == []
    assert bag(spark.table(target)) == Counter(
        [(1, "a", None), (2, "b", 0.5), (None, "c", None)]
    )


def test_columns_differing_in_case_are_one_column(spark, namespace):
    target = f"{namespace}.t"
    append_evolving(spark, rows(spark, (1, "a")), target)
    assert append_evolving(spark, rows(spark, (2, "b")).toDF("K", "V"), target) == []
    assert spark.table(target).count() == 2


def test_column_names_are_cleaned_everywhere(spark, namespace):
    target = f"{namespace}.t"
    odd = spark.createDataFrame([(1, 2)], "`a b` int, `c#` int")
    append_evolving(spark, odd, target)
    append_evolving(spark, odd, target)
    assert spark.table(target).columns == ["ab", "c"] and spark.table(target).count() == 2


def test_database_runs_full_then_incremental(spark, namespace, folder):
    create_ledgers(spark, namespace)
    server, by = f"srv-{namespace}", {"dbo.good": "k"}
    good = rows(spark, (1, "a"), (2, "b"))

    def bad():
        return spark.read.schema(ROW).parquet(folder)

    with_rows = {"dbo.good": good, "dbo.bad": bad, "plain": good, "sys.hidden": good}
    first = sync.sync_database(spark, namespace, server, "my db", with_rows, by, folder + "-out")
    found = {r.table_name: r for r in first.collect()}
    assert set(found) == {"good", "bad", "plain"}
    assert found["good"].sync_status == "COMPLETED" and found["good"].last_pk_value == "2"
    assert found["bad"].sync_status == "FAILED" and "PATH_NOT_FOUND" in found["bad"].error
    assert found["plain"].schema_name == "dbo"
    later = {"dbo.good": rows(spark, (1, "x"), (2, "b"), (3, "c"))}
    second = sync.sync_database(spark, namespace, server, "my db", later, by, folder + "-out")
    assert [(r.route, r.rows_written) for r in second.collect()] == [("range", 1)]
    state = ledger.database_state(spark.table(f"{namespace}.{DATABASE_RUNS}")).first()
    assert state.sync_status == "COMPLETED"
    # The full run had a table that failed: it is no completed run.
    assert state.last_full_sync is None and state.last_incremental_sync == state.updated_at
    log = spark.table(f"{namespace}.{RUN_LOG}").orderBy("run_id").collect()
    assert [(r.status, r.details) for r in log] == [
        ("FAILED", "my db: 2 of 3 tables"), ("COMPLETED", "my db: 1 of 1 tables")
    ]
    assert spark.table(f"{namespace}.{TABLE_RUNS}").count() == 4
    assert spark.table(target_table(server, "my db", "dbo.good")).count() == 3
    assert sync.tables_processed(second).first()["processed"] == 1


def test_fleet_leaves_out_system_and_skipped_databases(spark, namespace, folder):
    create_ledgers(spark, namespace)
    some = {"dbo.t": rows(spark, (1, "a"))}
    sources = [
        sync.SourceDatabase(f"s-{namespace}", name, some) for name in ("master", "one", "two")
    ]
    done = sync.sync_fleet(
        spark, namespace, sources, skip={f"s-{namespace}": ["two"]}, target_root=folder
    )
    assert [r.database_name for r in done.collect()] == ["one"]


def test_tables_with_one_target_fail_and_columns_choose_themselves(spark, namespace, folder):
    create_ledgers(spark, namespace)
    one = spark.createDataFrame([(1, 5, "a")], "id int, k bigint, v string")
    given = {"dbo.x_y": one, "dbo_x.y": one, "dbo.ok": one, "dbo.keyed": one}
    keys = spark.createDataFrame([("dbo.keyed", "k", 1)], "table_name string, column_name string, pk_position int")

    def run(tables):
        done = sync.sync_database(spark, namespace, f"s-{namespace}", "d", tables, target_root=folder, keys=keys)
        return {r.schema_name + "." + r.table_name: r for r in done.collect()}

    found = run(given)
    failed = {n for n, r in found.items() if r.sync_status == "FAILED"}
    assert failed == {"dbo.x_y", "dbo_x.y"}
    assert (found["dbo.ok"].last_pk_value, found["dbo.keyed"].last_pk_value) == ("1", "5")
    wider = spark.createDataFrame([(2, 6, "b", 0.5)], "id int, k bigint, v string, w double")
    again = run({"dbo.ok": wider})
    assert (again["dbo.ok"].route, again["dbo.ok"].added_columns) == ("range", "w")


def test_watermark_types_come_back(spark, namespace):
    source = spark.sql(
        """SELECT timestamp_ntz'2024-01-01 10:00:00.123456' AS t, 1.10D AS d,
                  CAST(1.10 AS decimal(10,2)) AS n, 'x' AS s"""
    )
    for column in source.columns:
        done = sync.full_sync(spark, source, f"{namespace}.t_{column}", column)
        kind = source.schema[column].dataType
        assert source.where(F.col(column) == done.watermark.column(kind)).count() == 1


def test_a_zoned_watermark_survives_another_session_zone(spark, namespace):
    source = spark.sql("SELECT timestamp'2024-07-01 10:00:00.5 UTC' AS t")
    done = sync.full_sync(spark, source, f"{namespace}.z", "t")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        kind = source.schema["t"].dataType
        assert source.where(F.col("t") == done.watermark.column(kind)).count() == 1
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_state_of_a_full_run_keeps_the_incremental_time(spark, namespace):
    create_ledgers(spark, namespace)
    from datetime import datetime

    base = {"server_name": "s", "database_name": "d", "sync_status": "COMPLETED"}
    append_rows(
        spark,
        namespace,
        DATABASE_RUNS,
        [
            {**base, "sync_type": "incremental", "updated_at": datetime(2024, 1, 1)},
            {**base, "sync_type": "full", "sync_status": None, "updated_at": datetime(2024, 1, 2)},
        ],
    )
    state = ledger.database_state(spark.table(f"{namespace}.{DATABASE_RUNS}")).first()
    assert state.last_incremental_sync == datetime(2024, 1, 1)
    assert state.last_full_sync == datetime(2024, 1, 2)
    assert state.sync_status is None


def test_range_on_orders_copies_everything_beyond(spark, namespace):
    orders = table(spark, SMALL, "orders")
    half = orders.where("o_orderkey < 700")
    first = sync.full_sync(spark, half, f"{namespace}.o", "o_orderkey")
    sync.incremental_sync(spark, orders, f"{namespace}.o", "o_orderkey", first.watermark)
    assert compare.compare_counts(orders, spark.table(f"{namespace}.o")).first().missing_rows == 0
    assert spark.table(f"{namespace}.o").count() == orders.count()
