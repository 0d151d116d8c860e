"""Ledger views, metrics, alerts, logs, schemas and scans on hand-made rows."""

from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tests.conftest import SMALL
from twinkeep.functions import names, status
from twinkeep.operators import alerts, ledger, logs, metrics, schema
from twinkeep.plans.inputs import derived, table
from twinkeep.plans.registry import AS_OF
from twinkeep.sources import csv_tree, sinks, tables, text_log
from twinkeep.sources.ledger_tables import RUN_LOG, append_rows, create_ledgers, run_log_entries


@pytest.fixture(scope="module")
def state(spark):
    return ledger.database_state(derived(spark, SMALL, "run_ledger"))


def test_state_and_severity_numbers(state):
    assert state.count() == 15
    level = status.severity(F.col("sync_status")).alias("level")
    found = {r.level: r["count"] for r in state.groupBy(level).count().collect()}
    assert found == {"CRITICAL": 3, "HIGH": 1, "INFO": 6, "WARNING": 5}
    assert alerts.stale_syncs(state, AS_OF).count() == 4


def test_a_failing_database_goes_stale_and_exports_are_whole(spark):
    runs = spark.sql(
        """SELECT id AS run_id, 's' AS server_name, 'd' AS database_name, 'incremental' AS sync_type,
                  CASE WHEN id = 0 THEN 'COMPLETED' ELSE 'FAILED' END AS sync_status,
                  CAST(NULL AS STRING) AS error,
                  timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, CAST(id AS INT)) AS updated_at
           FROM range(600)"""
    )
    stale = alerts.stale_syncs(ledger.database_state(runs), "2024-01-26 00:00:00").collect()
    assert [(r.database_name, r.age_hours) for r in stale] == [("d", 600)]
    assert ledger.database_history(runs, n=None).count() == 600
    assert ledger.database_history(runs).count() == 50
    assert ledger.database_history(runs, n=5000).count() == 600


def test_filters_are_optional(state):
    one = state.first()
    assert ledger.failed_syncs(state).count() >= ledger.failed_syncs(state, "srv_0").count()
    kept = ledger.matching(
        state, server_name=one.server_name, database_name=one.database_name
    )
    assert kept.count() == 1
    assert ledger.matching(state, server_name=None).count() == 15


def test_status_expressions(spark):
    df = spark.createDataFrame(
        [(None,), ("",), ("Completed",), ("sync_failed",), ("warning",), ("RUNNING",)],
        "s string",
    )
    assert [r[0] for r in df.select(status.severity(F.col("s"))).collect()] == [
        "INFO", "INFO", "INFO", "CRITICAL", "WARNING", "HIGH",
    ]
    errors = spark.createDataFrame(
        [("Login timeout",), ("Could not connect",), ("bad TYPE",), ("Conflict",), ("x",)],
        "e string",
    )
    assert [r[0] for r in errors.select(status.error_category(F.col("e"))).collect()] == [
        "connection_timeout", "connection", "schema_mismatch", "data_conflict", "unknown",
    ]
    counts = spark.createDataFrame([(5, 5), (5, 3), (5, 0), (3, 5)], "s bigint, d bigint")
    s, d = F.col("s"), F.col("d")
    rows = counts.select(
        status.count_status(s, d), status.sync_badge(s, d), status.difference_sign(s, d),
        status.delta_count(s, d),
    ).collect()
    assert [tuple(r) for r in rows] == [
        ("ok", "Synced", "0", 0),
        ("warning", "Partial", "+", 2),
        ("error", "Not Synced", "+", 5),
        ("warning", "Partial", "-", 0),
    ]


def test_times_do_not_depend_on_the_zone(spark):
    df = spark.sql(
        "SELECT timestamp_ntz'2024-03-10 00:00:00' AS a, timestamp_ntz'2024-03-11 01:00:00.0019' b"
    )
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        row = df.select(
            status.hours_between(F.col("b"), F.col("a")),
            status.millis_between(F.col("b"), F.col("a")),
            status.epoch_millis(F.lit("1970-01-02").cast("timestamp_ntz")),
        ).first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert tuple(row) == (25, 25 * 3_600_000 + 1, 86_400_000)


def test_names(spark):
    df = spark.createDataFrame([("a.b.c",), ("plain",), ("ström-1 x#",)], "n string")
    n = F.col("n")
    assert [tuple(r) for r in df.select(
        names.schema_part(n), names.table_part(n), names.clean_name(n)
    ).collect()] == [("a", "b.c", "abc"), ("dbo", "plain", "plain"), ("dbo", "ström-1 x#", "ström-1x")]
    assert names.namespace_text("srv-1.x", "my-db 2") == "srv_1x_my_db_2"
    assert names.target_table("s", "d", "dbo.a-b c.d") == "`s_d`.`dbo_a_b_c_d`"
    assert names.split_text("a.b.c") == ("a", "b.c") and names.split_text("t") == ("dbo", "t")


def test_latest_row_wins_even_when_it_is_null(spark):
    runs = spark.createDataFrame(
        [("k", 1, "a"), ("k", 2, None), ("j", 1, "b")], "key string, at int, v string"
    )
    found = {r.key: r.v for r in ledger.latest_per_key(runs, ["key"], ["at"]).collect()}
    assert found == {"k": None, "j": "b"}


def test_table_state_skips_runs_without_watermark(spark):
    at = datetime(2024, 1, 1), datetime(2024, 1, 2)
    runs = spark.createDataFrame(
        [(1, "s", "d", "dbo", "t", "5", at[0]), (2, "s", "d", "dbo", "t", None, at[1]),
         (3, "s", "d", "dbo", "u", None, at[1])],
        "run_id bigint, server_name string, database_name string, schema_name string, "
        "table_name string, last_pk_value string, updated_at timestamp_ntz",
    )
    found = {r.table_name: r for r in ledger.table_state(runs).collect()}
    assert found["t"].last_pk_value == "5" and found["t"].updated_at == at[1]
    assert found["u"].last_pk_value is None


def test_run_log_default_details(spark, namespace):
    create_ledgers(spark, namespace)
    create_ledgers(spark, namespace)
    row = {"server_name": "s", "sync_time": datetime(2024, 1, 1, 1, 2, 3), "status": "success"}
    append_rows(spark, namespace, RUN_LOG, [row])
    log = spark.table(f"{namespace}.{RUN_LOG}")
    assert run_log_entries(log).first().details == "-"
    assert ledger.last_syncs(log).first() == ("s", "2024-01-01 01:02:03", "success", "-")


def test_fleet_levels(spark):
    summary = metrics.sync_summary(derived(spark, SMALL, "fleet_counts"))
    levels = {r.level: r["count"] for r in summary.groupBy("level").count().collect()}
    assert levels == {"table": 6, "database": 4, "server": 2, "fleet": 1}


def test_alert_lines_and_counts(spark, state):
    lines = spark.createDataFrame(
        [("2024-01-01 00:00:01,5 - ERROR - Error processing srv: x ",),
         ("2024-01-01 00:00:02,5 - INFO - fine",),
         ("2024-01-01 00:00:00,5 - ERROR - Failed to sync/load dbo.t: y",)],
        "line string",
    )
    as_of = "2024-01-01 12:00:00"
    assert alerts.log_alerts(lines, as_of, tail=2).count() == 1
    assert alerts.alert_counts(alerts.log_alerts(lines, as_of)).first() == (2, 2, 0, 0)
    assert alerts.log_alerts(lines, "2024-01-03 00:00:00").count() == 0
    many = spark.range(500).selectExpr("'2024-01-01 00:00:01,5 - ERROR - Error processing x' || id AS line")
    assert alerts.log_alerts(many, as_of).count() == 500
    assert [r.line[:19] for r in text_log.log_tail(lines, 1).collect()] == ["2024-01-01 00:00:02"]


def test_schema_events(spark):
    lines = spark.createDataFrame(
        [("t0 - INFO - Added columns on s.t: ['a', 'b c']",),
         ("t1 - INFO - Added columns on s.t: [a, b]",),
         ("Added columns on s.u: []",),
         ("t3 - INFO - Added columns on s.v",),
         ("t4 - INFO - nothing",)],
        "line string",
    )
    found = [tuple(r) for r in logs.schema_change_events(lines).collect()]
    assert found == [
        ("t0", "s.t", ["a", "b c"], "Columns added to s.t: ['a', 'b c']"),
        ("t1", "s.t", ["a", "b"], "Columns added to s.t: ['a', 'b']"),
        ("", "s.u", [], "Columns added to s.u: []"),
        ("t3", "s.v", [], "Columns added to s.v: []"),
    ]
    assert logs.schema_change_events(lines, database="s.u").count() == 1


def test_sync_column_rule(spark):
    rows = [
        ("orders", "o_orderkey", 1, "bigint", 1), ("orders", "o_custkey", 2, "bigint", None),
        ("orders", "o_orderdate", 5, "datetime2", None),
        ("lineitem", "l_orderkey", 1, "bigint", 1), ("lineitem", "l_linenumber", 4, "int", 2),
        ("lineitem", "l_shipdate", 11, "datetime2", None),
        ("events", "ts", 2, "datetime2", None), ("events", "event_id", 1, "bigint", None),
        ("labels", "quality", 2, "int", None), ("labels", "doc_id", 1, "bigint", None),
        ("notes", "body", 1, "nvarchar", None),
    ]
    metadata = spark.createDataFrame(
        rows,
        "table_name string, column_name string, ordinal int, data_type string, pk_position int",
    )
    found = {r.table_name: (r.sync_column, r.rule) for r in schema.choose_sync_column(metadata).collect()}
    assert found == {
        "orders": ("o_orderkey", "key"),
        "lineitem": ("l_orderkey", "key"),
        "events": ("ts", "time"),
        "labels": ("doc_id", "id"),
    }


def test_primary_keys(spark):
    usage = spark.createDataFrame(
        [("t", "b", "PK_t", 4), ("t", "a", "PKxt", 7), ("t", "c", "FK_t", 1)],
        "table_name string, column_name string, constraint_name string, ordinal_position int",
    )
    found = [tuple(r) for r in schema.primary_keys(usage).orderBy("pk_position").collect()]
    assert found == [("t", "b", 1), ("t", "a", 2)]


def test_candidate_profile_flags_ties(spark):
    df = spark.createDataFrame([(1,), (2,), (2,), (None,)], "k bigint")
    assert schema.profile_candidate(df, "k").first() == (4, 1, 2, 2, False)
    assert schema.profile_candidate(df.limit(0), "k").first() == (0, 0, 0, 0, True)


def test_type_profile(spark):
    uuid = "123e4567-e89b-12d3-a456-426614174000"
    df = spark.createDataFrame(
        [(uuid, "1", "x" * 300, 1.5), (None, "-22", "y", None)],
        "u string, i string, t string, d double",
    ).selectExpr("*", "date'2024-01-01' AS day", "CAST(1 AS decimal(9,2)) AS n", "array(1) AS a")
    found = {r.column_name: r for r in schema.profile_types(df).collect()}
    assert {n: r.suggested_type for n, r in found.items()} == {
        "u": "UUID", "i": "VARCHAR(255)", "t": "TEXT", "d": "DOUBLE PRECISION",
        "day": "DATE", "n": "NUMERIC(9,2)", "a": "TEXT",
    }
    assert found["i"].all_integers and not found["t"].all_integers
    assert (found["d"].filled_rows, found["d"].null_rows) == (1, 1)


def test_drift(spark):
    a = tables.column_metadata(spark, {"t": spark.range(1).selectExpr("id", "id AS x")})
    b = tables.column_metadata(spark, {"t": spark.range(1).selectExpr("'1' AS id", "id AS z")})
    found = {r.column_name: tuple(r)[2:] for r in schema.schema_drift(a, b).collect()}
    assert found == {
        "id": ("bigint", "string", False, True),
        "x": ("bigint", None, True, False),
        "z": (None, "bigint", False, False),
    }
    assert [r.column_name for r in schema.missing_columns(a, b).collect()] == ["x"]


def test_csv_tree(spark, namespace, folder):
    customer = table(spark, SMALL, "customer")
    sinks.export_report(customer, f"{folder}/{namespace}-a b/dbo_customer.csv")
    sinks.write_header(customer, f"{folder}/{namespace}-a b/dbo_void.csv")
    done = csv_tree.load_csv_tree(spark, folder, folder + "-out").orderBy("table_name").collect()
    assert [(r.namespace, r.table_name, r.status) for r in done] == [
        (f"{namespace}_a_b", "dbo_customer", "success"),
        (f"{namespace}_a_b", "dbo_void", "success"),
    ]
    loaded = spark.table(f"{namespace}_a_b.dbo_customer")
    assert loaded.count() == 150 and dict(loaded.dtypes)["c_acctbal"] == "double"
    assert spark.table(f"{namespace}_a_b.dbo_void").columns == customer.columns
    again = csv_tree.load_csv_tree(spark, folder, folder + "-out")
    assert again.count() == 2 and spark.table(f"{namespace}_a_b.dbo_customer").count() == 150


def test_report_formats(spark, folder):
    rows = spark.sql("SELECT timestamp_ntz'2024-01-01 00:00:00.123456' AS t, NULL AS n, 'a' AS s")
    sinks.export_report(rows, folder, "json")
    assert spark.read.text(folder).first()[0] == (
        '{"t":"2024-01-01T00:00:00.123456","n":null,"s":"a"}'
    )
    with pytest.raises(ValueError):
        sinks.export_report(rows, folder, "xlsx")
    assert '"s":"a"' in sinks.as_document(rows).first().document


def test_scans(spark, namespace):
    orders = table(spark, SMALL, "orders")
    assert tables.table_or_empty(spark, f"{namespace}.absent", orders.schema).isEmpty()
    orders.write.saveAsTable(f"{namespace}.orders")
    assert tables.table_or_empty(spark, f"{namespace}.orders", orders.schema).count() == 1500
    listing = tables.catalog_listing(spark, [namespace])
    assert [tuple(r) for r in listing.collect()] == [(namespace, "orders")]
    odd = spark.createDataFrame(
        [("SYS", "t"), ("sys", "trace_xe_event_map"), ("dbo", "t")],
        "schema_name string, table_name string",
    )
    assert [tuple(r) for r in tables.user_tables(odd).collect()] == [("dbo", "t")]
    assert tables.has_rows_after(orders, "o_orderkey", None)
    assert tables.has_rows_after(orders, "o_orderkey", "1498")
    assert not tables.has_rows_after(orders, "o_orderkey", 1499)


def test_watermark_filter_reaches_the_scan(spark):
    plan = tables.after_watermark(table(spark, SMALL, "orders"), "o_orderkey", "9")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(o_orderkey,9)" in text


def test_counts_read_no_column(spark):
    orders = table(spark, SMALL, "orders")
    text = tables.row_counts({"o": orders})._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<>" in text


def test_jdbc_options():
    with pytest.raises(ValueError):
        tables.jdbc_options("id", None, 8, 100)
    assert tables.jdbc_options("id", ("1", "9"), 8, 100) == {
        "fetchsize": "100", "partitionColumn": "id", "lowerBound": "1", "upperBound": "9",
        "numPartitions": "8",
    }
    assert tables.jdbc_options(None, None, None, 5) == {"fetchsize": "5"}
