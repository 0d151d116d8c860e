"""Every operator as a named query over the given tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinkeep.functions.names import clean_name, namespace_name, schema_part, table_part
from twinkeep.functions.status import severity, thousands
from twinkeep.operators import (
    alerts,
    changes,
    compaction,
    compare,
    copies,
    ledger,
    logs,
    metrics,
    schema,
    sessions,
    sync,
    versions,
)
from twinkeep.plans.inputs import derived, table
from twinkeep.session import work_path
from twinkeep.sources import csv_tree, sinks, tables, text_log
from twinkeep.sources.ledger_tables import DATABASE_RUNS, JOB_RUNS, TABLE_RUNS, create_ledgers, run_log_entries
from twinkeep.streaming import incremental, live_status

Query = Callable[[SparkSession, str], DataFrame]

AS_OF = "2024-01-31 00:00:00"
CUT_DATE = "1995-06-01"
ORDER_KEY = ["o_orderkey"]
FILTER = "o_orderdate >= timestamp_ntz'1995-01-01 00:00:00' AND o_orderstatus <> 'F'"

_REGISTERED: dict[str, Query] = {}


def query(function: Query) -> Query:
    _REGISTERED[function.__name__] = function
    return function


def registered() -> dict[str, Query]:
    return dict(_REGISTERED)


def _replica(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return derived(spark, sf, "replica_src"), derived(spark, sf, "replica_dst")


def _namespace(spark: SparkSession) -> tuple[str, str]:
    """A fresh catalog namespace in the shared folder, and that folder."""
    name = f"tk_{uuid.uuid4().hex}"
    root = work_path(spark, "tables")
    sinks.ensure_namespace(spark, name, root)
    return name, root


# Comparison ------------------------------------------------------------------


@query
def compare_missing_rows(spark: SparkSession, sf: str) -> DataFrame:
    return compare.missing_rows(*_replica(spark, sf))


@query
def compare_extra_rows(spark: SparkSession, sf: str) -> DataFrame:
    return compare.extra_rows(*_replica(spark, sf))


@query
def compare_counts(spark: SparkSession, sf: str) -> DataFrame:
    return compare.compare_counts(*_replica(spark, sf))


@query
def compare_heads(spark: SparkSession, sf: str) -> DataFrame:
    return compare.compare_heads(*_replica(spark, sf), order_by=ORDER_KEY)


@query
def compare_wide_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Whole texts: documents against a copy that lost one source."""
    source = table(spark, sf, "documents")
    return compare.missing_rows(source, source.where("lang <> 'en'"))


@query
def delta_rows(spark: SparkSession, sf: str) -> DataFrame:
    return changes.delta_rows(*_replica(spark, sf))


@query
def delta_summary(spark: SparkSession, sf: str) -> DataFrame:
    return changes.delta_summary(*_replica(spark, sf))


@query
def validate_table(spark: SparkSession, sf: str) -> DataFrame:
    return compare.validate_table(*_replica(spark, sf))


@query
def validate_self(spark: SparkSession, sf: str) -> DataFrame:
    lineitem = table(spark, sf, "lineitem")
    return compare.validate_table(lineitem, lineitem)


@query
def verify_consistency(spark: SparkSession, sf: str) -> DataFrame:
    return compare.verify_consistency(*_replica(spark, sf))


@query
def partial_preview(spark: SparkSession, sf: str) -> DataFrame:
    return compare.partial_preview(
        *_replica(spark, sf), columns=["o_orderkey", "o_totalprice"], filter_sql=FILTER
    )


@query
def debug_new_rows(spark: SparkSession, sf: str) -> DataFrame:
    return compare.debug_new_rows(*_replica(spark, sf), order_by=ORDER_KEY)


@query
def duplicate_rows(spark: SparkSession, sf: str) -> DataFrame:
    return compare.later_copies(derived(spark, sf, "replica_dst"))


@query
def verified_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Listed keys held against all rows: one holds, one is too short, one repeats and has NULLs."""
    source, _ = _replica(spark, sf)
    undated = source.withColumn("o_custkey", F.when(F.col("o_orderkey") % 30 != 0, F.col("o_custkey")))
    given = {"orders": table(spark, sf, "orders"), "lineitem": table(spark, sf, "lineitem"), "replica": undated}
    keys = {"orders": ["o_orderkey"], "lineitem": ["l_orderkey"], "replica": ["o_orderkey", "o_custkey"]}
    return schema.verified_keys(given, keys)


@query
def marked_copies(spark: SparkSession, sf: str) -> DataFrame:
    """Every row with the number of its copy."""
    return copies.mark_copies(derived(spark, sf, "replica_dst"))


@query
def marked_statuses(spark: SparkSession, sf: str) -> DataFrame:
    """Copies in one column alone, numbered by key: three values hold all rows."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return copies.mark_copies(orders, ["o_orderstatus"], [F.col("o_totalprice").desc(), F.col("o_orderkey")])


@query
def changed_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Differing rows aligned by key, with the columns that differ and both values."""
    found = changes.changed_rows(*_replica(spark, sf), keys=["o_orderkey"])
    shown = F.transform("changes", lambda c: F.concat(c["name"], F.lit(":"), F.coalesce(c["source"], F.lit(""))))
    return found.select("kind", "o_orderkey", "copy", F.coalesce(F.array_join(shown, ","), F.lit("")).alias("changes"))


@query
def changed_row_counts(spark: SparkSession, sf: str) -> DataFrame:
    found = changes.changed_rows(*_replica(spark, sf), keys=["o_orderkey"])
    columns = F.coalesce(F.array_join(F.col("changes")["name"], ","), F.lit(""))
    return found.groupBy("kind", columns.alias("columns")).agg(F.count("*").alias("n"))


def _versions(spark: SparkSession, sf: str) -> tuple[versions.Version, versions.Version]:
    left, right = _replica(spark, sf)
    root = work_path(spark, "versions")
    pair = ((left, right, "left"), (right, left, "right"))
    return tuple(versions.write_version(a, f"{root}/{n}", ORDER_KEY, like=b, fanout=16) for a, b, n in pair)


@query
def compare_by_tree(spark: SparkSession, sf: str) -> DataFrame:
    """The missing rows again, found from stored fingerprint trees."""
    return versions.compare_versions(spark, *_versions(spark, sf)).missing()


@query
def duplicate_counts(spark: SparkSession, sf: str) -> DataFrame:
    return compare.duplicate_counts(derived(spark, sf, "replica_dst"))


@query
def bucket_check(spark: SparkSession, sf: str) -> DataFrame:
    return compare.bucket_fingerprints(
        *_replica(spark, sf), bucket=F.pmod(F.col("o_orderkey"), F.lit(64))
    )


@query
def compare_by_buckets(spark: SparkSession, sf: str) -> DataFrame:
    """The replica lost one day; other buckets are never compared row by row."""
    source = table(spark, sf, "orders")
    last_day = source.agg(F.max("o_orderdate").alias("day"))
    replica = source.where(F.col("o_orderdate") < last_day.scalar())
    return compare.find_differences(source, replica, bucket=F.col("o_orderkey")).missing()


# Many tables -----------------------------------------------------------------


def _pairs(spark: SparkSession, sf: str) -> dict[str, tuple[DataFrame, DataFrame]]:
    lineitem, customer = table(spark, sf, "lineitem"), table(spark, sf, "customer")
    part, supplier = table(spark, sf, "part"), table(spark, sf, "supplier")
    return {
        "orders": _replica(spark, sf),
        "lineitem": (lineitem, lineitem.where("l_orderkey % 4 <> 0")),
        "customer": (customer, customer.where("c_custkey % 20 <> 0")),
        "part": (part, part),
        "supplier": (supplier, supplier.limit(0)),
    }


@query
def top_changed_tables(spark: SparkSession, sf: str) -> DataFrame:
    return changes.top_changed_tables(changes.table_deltas(_pairs(spark, sf)))


@query
def top_changed_totals(spark: SparkSession, sf: str) -> DataFrame:
    return changes.changed_totals(changes.table_deltas(_pairs(spark, sf)))


def _unreadable(spark: SparkSession):
    """A pair whose source is not there."""
    return lambda: (spark.read.parquet(work_path(spark, "absent")), spark.range(1).toDF("k"))


@query
def top_changed_with_errors(spark: SparkSession, sf: str) -> DataFrame:
    """One unreadable table: its row carries an error, the others their deltas."""
    found = changes.table_deltas_or_errors(_pairs(spark, sf) | {"absent": _unreadable(spark)})
    ranked = changes.top_changed_tables(found)
    return ranked.withColumn("failed", F.col("error").isNotNull()).drop("error")


@query
def fleet_counts_of_tables(spark: SparkSession, sf: str) -> DataFrame:
    """Counts of real table pairs, rolled up."""
    pairs = {
        (f"srv_{k % 2}", f"db_{k % 3}", name): pair
        for k, (name, pair) in enumerate(_pairs(spark, sf).items())
    }
    pairs[("srv_0", "db_0", "absent")] = _unreadable(spark)
    counts = metrics.counts_of_tables(pairs)
    totals = metrics.paired_counts(counts)
    failed = counts.groupBy(*metrics.FLEET_KEY).agg(F.bool_or(F.col("error").isNotNull()).alias("failed"))
    return totals.join(failed, metrics.FLEET_KEY)


@query
def failed_syncs_of_server(spark: SparkSession, sf: str) -> DataFrame:
    return ledger.failed_syncs(_state(spark, sf), server="srv_1")


@query
def history_of_server(spark: SparkSession, sf: str) -> DataFrame:
    return ledger.database_history(derived(spark, sf, "run_ledger"), server="srv_2")


@query
def schema_events_of_table(spark: SparkSession, sf: str) -> DataFrame:
    events = logs.schema_change_events(_logged(spark, sf), database="t3")
    return events.withColumn("added_columns", F.concat_ws(",", "added_columns"))


@query
def primary_key_columns(spark: SparkSession, sf: str) -> DataFrame:
    """Key columns of a constraint listing, made of the listing of columns."""
    given = {n: table(spark, sf, n) for n in ("orders", "lineitem", "part", "events")}
    usage = tables.column_metadata(spark, given).where("column_name RLIKE 'key$' AND column_name <> 'o_custkey'").select(
        "table_name",
        "column_name",
        F.concat(F.when(F.col("table_name") == "part", "FK_").otherwise("PK_"), "table_name").alias("constraint_name"),
        F.instr(F.lit("l_orderkey l_suppkey l_partkey"), F.col("column_name")).alias("ordinal_position"),
    )
    return schema.primary_keys(usage)


@query
def table_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.table_metrics(
        derived(spark, sf, "fleet_counts"), derived(spark, sf, "fleet_state")
    )


@query
def database_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.database_metrics(derived(spark, sf, "fleet_counts"))


@query
def server_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.server_metrics(derived(spark, sf, "fleet_counts"))


@query
def sync_summary(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.sync_summary(derived(spark, sf, "fleet_counts"))


@query
def metrics_documents(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.metrics_documents(
        metrics.sync_summary(derived(spark, sf, "fleet_counts"))
    )


def _snapshots(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.table_snapshots(
        ledger.table_state(derived(spark, sf, "table_ledger")),
        derived(spark, sf, "snapshot_src"),
        derived(spark, sf, "snapshot_dst"),
    )


@query
def table_snapshots(spark: SparkSession, sf: str) -> DataFrame:
    return _snapshots(spark, sf)


# Ledgers ---------------------------------------------------------------------


def _state(spark: SparkSession, sf: str) -> DataFrame:
    return ledger.database_state(derived(spark, sf, "run_ledger"))


@query
def database_state(spark: SparkSession, sf: str) -> DataFrame:
    return _state(spark, sf)


@query
def table_state(spark: SparkSession, sf: str) -> DataFrame:
    return ledger.table_state(derived(spark, sf, "table_ledger"))


@query
def database_history(spark: SparkSession, sf: str) -> DataFrame:
    return ledger.database_history(derived(spark, sf, "run_ledger"))


@query
def table_history(spark: SparkSession, sf: str) -> DataFrame:
    return ledger.table_history(ledger.table_state(derived(spark, sf, "table_ledger")))


@query
def table_sync_history(spark: SparkSession, sf: str) -> DataFrame:
    return ledger.table_sync_history(derived(spark, sf, "table_ledger"))


@query
def last_syncs(spark: SparkSession, sf: str) -> DataFrame:
    return ledger.last_syncs(derived(spark, sf, "run_log"))


@query
def last_sync(spark: SparkSession, sf: str) -> DataFrame:
    return ledger.last_syncs(derived(spark, sf, "run_log"), n=1)


@query
def failed_syncs(spark: SparkSession, sf: str) -> DataFrame:
    return ledger.failed_syncs(_state(spark, sf))


@query
def severity_counts(spark: SparkSession, sf: str) -> DataFrame:
    level = severity(F.col("sync_status")).alias("severity")
    return _state(spark, sf).groupBy(level).agg(F.count("*").alias("databases"))


@query
def resume_points(spark: SparkSession, sf: str) -> DataFrame:
    return ledger.resume_points(ledger.table_state(derived(spark, sf, "table_ledger")))


@query
def table_sync_status(spark: SparkSession, sf: str) -> DataFrame:
    listing = derived(spark, sf, "listing").distinct()
    return ledger.table_sync_status(
        listing, ledger.table_state(derived(spark, sf, "table_ledger"))
    )


@query
def live_jobs(spark: SparkSession, sf: str) -> DataFrame:
    return ledger.live_jobs(ledger.job_state(derived(spark, sf, "job_ledger")))


@query
def run_log_details(spark: SparkSession, sf: str) -> DataFrame:
    return run_log_entries(derived(spark, sf, "run_log"))


def _report(spark: SparkSession, sf: str) -> DataFrame:
    return ledger.history_report(
        ledger.database_history(derived(spark, sf, "run_ledger"), n=None),
        ledger.table_history(ledger.table_state(derived(spark, sf, "table_ledger")), n=None),
    )


@query
def report_union(spark: SparkSession, sf: str) -> DataFrame:
    return _report(spark, sf)


@query
def report_csv_export(spark: SparkSession, sf: str) -> DataFrame:
    report, path = _report(spark, sf), work_path(spark, "report")
    sinks.export_report(report, path, "csv")
    return csv_tree.read_export(spark, path, report.schema)


@query
def report_json_export(spark: SparkSession, sf: str) -> DataFrame:
    report, path = _report(spark, sf), work_path(spark, "report")
    sinks.export_report(report, path, "json")
    return spark.read.schema(report.schema).json(path)


# Sync ------------------------------------------------------------------------


@query
def full_sync(spark: SparkSession, sf: str) -> DataFrame:
    name, _ = _namespace(spark)
    target = f"{name}.dbo_lineitem"
    sync.full_sync(spark, table(spark, sf, "lineitem"), target, "l_orderkey")
    return spark.table(target)


@query
def incremental_range(spark: SparkSession, sf: str) -> DataFrame:
    """The replica holds older orders; the sync column has ties and the older
    rows changed, which this route does not see."""
    source, replica = _replica(spark, sf)
    name, _ = _namespace(spark)
    target = f"{name}.dbo_orders"
    older = replica.where(F.col("o_orderdate") < F.lit(CUT_DATE).cast("timestamp_ntz"))
    first = sync.full_sync(spark, older, target, "o_orderdate")
    sync.incremental_sync(spark, source, target, "o_orderdate", first.watermark)
    return spark.table(target)


@query
def batched_range(spark: SparkSession, sf: str) -> DataFrame:
    """The same backlog in batches, by a run that dies after its second batch is written but
    before it is committed, and another that goes on from the first."""
    source, replica = _replica(spark, sf)
    name, _ = _namespace(spark)
    target = f"{name}.dbo_orders"
    older = replica.where(F.col("o_orderdate") < F.lit(CUT_DATE).cast("timestamp_ntz"))
    first = sync.full_sync(spark, older, target, "o_orderdate")
    size = max(1, source.count() // 8)
    committed = [first.watermark]

    def dies(batch: sync.Outcome) -> None:
        if len(committed) == 2:
            raise InterruptedError("killed between data and commit")
        committed.append(batch.watermark)

    try:
        sync.incremental_sync(spark, source, target, "o_orderdate", first.watermark, size, dies)
    except InterruptedError:
        sync.incremental_sync(spark, source, target, "o_orderdate", committed[-1], size)
    return spark.table(target)


@query
def left_behind(spark: SparkSession, sf: str) -> DataFrame:
    """Rows that the range route never brings: without a date, and late ones."""
    source, replica = _replica(spark, sf)
    name, _ = _namespace(spark)
    target = f"{name}.dbo_orders"
    done = sync.full_sync(spark, replica.where(F.col("o_orderdate") < F.lit(CUT_DATE).cast("timestamp_ntz")), target, "o_orderdate")
    undated = F.when(F.col("o_orderkey") % 40 != 0, F.col("o_orderdate"))
    return sync.left_behind(spark, source.withColumn("o_orderdate", undated), target, "o_orderdate", done.watermark)


def _digest_synced(spark: SparkSession, sf: str) -> str:
    source, replica = _replica(spark, sf)
    name, _ = _namespace(spark)
    target = f"{name}.dbo_orders"
    sync.full_sync(spark, replica, target)
    sync.incremental_sync(spark, source, target)
    sync.incremental_sync(spark, source, target)
    return target


@query
def incremental_digest(spark: SparkSession, sf: str) -> DataFrame:
    return spark.table(_digest_synced(spark, sf))


@query
def sync_then_compare(spark: SparkSession, sf: str) -> DataFrame:
    target = _digest_synced(spark, sf)
    return compare.compare_counts(derived(spark, sf, "replica_src"), spark.table(target))


@query
def empty_source_guard(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders")
    name, _ = _namespace(spark)
    target = f"{name}.dbo_orders"
    first = sync.full_sync(spark, orders, target, "o_orderkey")
    sync.incremental_sync(spark, orders.where("false"), target, "o_orderkey", first.watermark)
    return spark.table(target)


@query
def evolve_append(spark: SparkSession, sf: str) -> DataFrame:
    name, _ = _namespace(spark)
    target = f"{name}.dbo_orders"
    sinks.append_evolving(spark, table(spark, sf, "orders"), target)
    sinks.append_evolving(spark, derived(spark, sf, "evolved_src"), target)
    return spark.table(target)


def _twice_synced(spark: SparkSession, sf: str) -> tuple[str, DataFrame]:
    """Two runs of one database: the second sees rows the first did not."""
    name, root = _namespace(spark)
    create_ledgers(spark, name)
    orders, lineitem = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    customer, events = table(spark, sf, "customer"), table(spark, sf, "events")
    cut = F.lit(CUT_DATE).cast("timestamp_ntz")
    first = {
        "dbo.orders": orders.where(F.col("o_orderdate") < cut),
        "dbo.lineitem": lineitem.where(F.col("l_shipdate") < cut),
        "dbo.customer": customer,
        "sys.events": events,
    }
    later = {
        "dbo.orders": orders,
        "dbo.lineitem": lineitem,
        "dbo.customer": customer,
        "dbo.events": events,
    }
    by = {"dbo.orders": "o_orderdate", "dbo.lineitem": "l_shipdate", "dbo.events": "event_id"}
    server, database = f"srv-{uuid.uuid4().hex}", "sales"
    sync.sync_database(spark, name, server, database, first, by, root)
    return name, sync.sync_database(spark, name, server, database, later, by, root)


@query
def sync_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    name, _ = _twice_synced(spark, sf)
    return spark.table(f"{name}.{TABLE_RUNS}").select(
        "database_name", "schema_name", "table_name", "route", "rows_written",
        "last_pk_value", "last_pk_type", "sync_status",
    )


@query
def added_columns_ledger(spark: SparkSession, sf: str) -> DataFrame:
    """The sync column by rule from a key listing; the second run finds a new column and
    notes it."""
    name, root = _namespace(spark)
    create_ledgers(spark, name)
    server = f"srv-{uuid.uuid4().hex}"
    keys = spark.createDataFrame(
        [("dbo.orders", "o_orderkey", 1)], "table_name string, column_name string, pk_position int"
    )
    orders, wider = table(spark, sf, "orders"), derived(spark, sf, "evolved_src")
    for given in (orders.where("o_orderkey < 1000"), wider.where("o_orderkey >= 1000")):
        sync.sync_database(
            spark, name, server, "sales", {"dbo.orders": given}, target_root=root, keys=keys
        )
    return spark.table(f"{name}.{TABLE_RUNS}").select("table_name", "route", "added_columns", "sync_status")


@query
def fleet_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    """A fleet of two servers; system and skipped databases are left out."""
    name, root = _namespace(spark)
    create_ledgers(spark, name)
    tag = uuid.uuid4().hex
    given = {f"dbo.{n}": table(spark, sf, n) for n in ("orders", "customer")}
    sources = [
        sync.SourceDatabase(f"{server}-{tag}", database, given)
        for server in ("one", "two")
        for database in ("sales", "stock", "master")
    ]
    done = sync.sync_fleet(spark, name, sources, {f"two-{tag}": ["stock"]}, root)
    return done.select(
        F.substring_index("server_name", "-", 1).alias("server"), "database_name", "table_name",
        "route", "rows_written", "sync_status",
    )


def _compacted(spark: SparkSession, sf: str, name: str, given: str) -> DataFrame:
    """A ledger filled in two parts; a snapshot of the first is in force."""
    space, root = _namespace(spark)
    create_ledgers(spark, space)
    schema = spark.table(f"{space}.{name}").schema
    source = derived(spark, sf, given)
    found = source.select(
        *[(F.col(f.name) if f.name in source.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema]
    )
    for number, part in enumerate(("run_id % 3 < 2", "run_id % 3 = 2")):
        found.where(part).write.insertInto(f"{space}.{name}")
        if not number:
            compaction.compact_ledger(spark, space, name, f"{root}/snapshots")
    return compaction.state_rows(spark, space, name)


@query
def compacted_table_state(spark: SparkSession, sf: str) -> DataFrame:
    state = ledger.table_state(_compacted(spark, sf, TABLE_RUNS, "table_ledger"))
    return state.drop("last_pk_type").withColumn("last_pk_value", F.col("last_pk_value").cast("bigint"))


@query
def compacted_database_state(spark: SparkSession, sf: str) -> DataFrame:
    return ledger.database_state(_compacted(spark, sf, DATABASE_RUNS, "run_ledger"))


@query
def compacted_job_state(spark: SparkSession, sf: str) -> DataFrame:
    return ledger.live_jobs(ledger.job_state(_compacted(spark, sf, JOB_RUNS, "job_ledger")))


@query
def tables_processed(spark: SparkSession, sf: str) -> DataFrame:
    _, outcomes = _twice_synced(spark, sf)
    return sync.tables_processed(outcomes).select("database_name", "processed", "tables")


def _through_csv(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A table exported as CSV and loaded again."""
    given, root = table(spark, sf, name), work_path(spark, "exports")
    folder = f"srv-{uuid.uuid4().hex[:8]} x"
    sinks.export_report(given, f"{root}/{folder}/dbo_{name}.csv")
    ddl = ", ".join(f"{n} {t}" for n, t in given.dtypes)
    done = csv_tree.load_csv_tree(
        spark, root, work_path(spark, "tables"), {f"dbo_{name}": ddl}
    ).first()
    return spark.table(f"{done.namespace}.{done.table_name}")


@query
def csv_tree_load(spark: SparkSession, sf: str) -> DataFrame:
    return _through_csv(spark, sf, "customer")


@query
def csv_documents_load(spark: SparkSession, sf: str) -> DataFrame:
    """Texts with line breaks, quotes and commas."""
    return _through_csv(spark, sf, "documents")


@query
def csv_pages_load(spark: SparkSession, sf: str) -> DataFrame:
    return _through_csv(spark, sf, "pages")


@query
def csv_conversations_load(spark: SparkSession, sf: str) -> DataFrame:
    return _through_csv(spark, sf, "conversations")


@query
def header_export(spark: SparkSession, sf: str) -> DataFrame:
    """Columns of the header-only file, beside the rows the table has."""
    orders, path = table(spark, sf, "orders"), work_path(spark, "header")
    sinks.write_header(orders, path)
    header = spark.read.option("header", True).csv(path)
    return orders.agg(F.count("*").alias("total_rows")).select(
        F.lit(",".join(header.columns)).alias("header"), "total_rows"
    )


# Alerts and sessions ---------------------------------------------------------


@query
def stale_syncs(spark: SparkSession, sf: str) -> DataFrame:
    return alerts.stale_syncs(_state(spark, sf), AS_OF)


def _alerts(spark: SparkSession, sf: str) -> DataFrame:
    return alerts.alerts_with_severity(
        _state(spark, sf),
        _snapshots(spark, sf),
        ledger.job_state(derived(spark, sf, "job_ledger")),
        derived(spark, sf, "log_lines"),
        AS_OF,
    )


@query
def alerts_with_severity(spark: SparkSession, sf: str) -> DataFrame:
    return _alerts(spark, sf)


@query
def alert_counts(spark: SparkSession, sf: str) -> DataFrame:
    return alerts.alert_counts(_alerts(spark, sf))


@query
def alerts_basic(spark: SparkSession, sf: str) -> DataFrame:
    return alerts.alerts_basic(_state(spark, sf), _snapshots(spark, sf))


@query
def alert_list_counts(spark: SparkSession, sf: str) -> DataFrame:
    found = alerts.alerts_basic(_state(spark, sf), _snapshots(spark, sf))
    return found.groupBy("kind").agg(F.count("*").alias("alerts"))


@query
def history_counts(spark: SparkSession, sf: str) -> DataFrame:
    """How long the lists of one report are."""
    state = _state(spark, sf)
    lists = {
        "databases": state,
        "failed": ledger.failed_syncs(state),
        "tables": ledger.table_state(derived(spark, sf, "table_ledger")),
    }
    return tables.row_counts(lists, label="list")


@query
def recent_sessions(spark: SparkSession, sf: str) -> DataFrame:
    found = alerts.recent_sessions(_state(spark, sf), _snapshots(spark, sf))
    return found.withColumns(
        {c: F.concat_ws("; ", c) for c in ("warnings", "errors")}
    )


@query
def run_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """The newest three sessions of each database, from its runs."""
    return sessions.newest_sessions(derived(spark, sf, "run_ledger"), 3, "4 hours")


@query
def long_histories(spark: SparkSession, sf: str) -> DataFrame:
    """The newest 5000 runs of each server: more than one task is asked to hold."""
    runs = derived(spark, sf, "run_ledger").select("run_id", "server_name", "sync_status", "updated_at")
    return ledger.newest_per_key(runs, ["server_name"], ["updated_at", "run_id"], 5000)


@query
def session_report(spark: SparkSession, sf: str) -> DataFrame:
    snapshots = _snapshots(spark, sf)
    sessions = alerts.recent_sessions(_state(spark, sf), snapshots)
    found = alerts.session_report(sessions, snapshots, _alerts(spark, sf))
    return found.select(
        "session_id", "duration_ms", "total_tables", "alerts_total", "alerts_critical",
        "alerts_high", "alerts_warning", F.to_json("tables").alias("tables"),
    )


# Logs ------------------------------------------------------------------------


def _logged(spark: SparkSession, sf: str) -> DataFrame:
    """The log as text files, read back."""
    path = work_path(spark, "log")
    derived(spark, sf, "log_lines").select("line").write.text(path)
    return text_log.read_log(spark, path)


@query
def schema_events(spark: SparkSession, sf: str) -> DataFrame:
    events = logs.schema_change_events(_logged(spark, sf))
    return events.withColumn("added_columns", F.concat_ws(",", "added_columns"))


@query
def sync_errors(spark: SparkSession, sf: str) -> DataFrame:
    return logs.sync_errors(_logged(spark, sf))


@query
def error_categories(spark: SparkSession, sf: str) -> DataFrame:
    return logs.error_categories(derived(spark, sf, "run_ledger"))


@query
def log_tail(spark: SparkSession, sf: str) -> DataFrame:
    return text_log.log_tail(_logged(spark, sf))


# Schemas ---------------------------------------------------------------------


@query
def schema_drift(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders")
    replica = orders.drop("o_orderpriority").withColumn(
        "o_custkey", F.col("o_custkey").cast("string")
    )
    return schema.drift_of_tables(
        {
            "orders": (orders, replica),
            "evolved": (derived(spark, sf, "evolved_src"), orders),
        }
    )


@query
def type_profile(spark: SparkSession, sf: str) -> DataFrame:
    names = ("documents", "orders", "events", "pages")
    return schema.profile_tables({n: table(spark, sf, n) for n in names})


@query
def sync_columns(spark: SparkSession, sf: str) -> DataFrame:
    """The rule over the tables' own schemas, then a profile of each choice."""
    given, chosen, picks = _sync_choices(spark, sf)
    profiles = schema.profile_candidates(given, picks)
    return chosen.join(profiles.drop("column_name"), "table_name")


@query
def sync_columns_sketched(spark: SparkSession, sf: str) -> DataFrame:
    """All candidates of the tables, not the chosen alone, by sketches: one pass per table."""
    given, _, _ = _sync_choices(spark, sf)
    candidates = schema.sync_candidates(_sync_metadata(spark, given)).select("table_name", "column_name")
    picks = [tuple(r) for r in candidates.collect()]
    found = schema.sketch_candidates(given, picks)
    return found.select(
        "table_name", "column_name", "total_rows", "null_rows", "ties_at_max", "may_be_unique"
    )


def _sync_choices(spark: SparkSession, sf: str) -> tuple[dict[str, DataFrame], DataFrame, list[tuple[str, str]]]:
    names = ("orders", "lineitem", "events", "labels", "benchmark")
    given = {n: table(spark, sf, n) for n in names}
    chosen = schema.choose_sync_column(_sync_metadata(spark, given))
    return given, chosen, [(r.table_name, r.sync_column) for r in chosen.collect()]


def _sync_metadata(spark: SparkSession, given: dict[str, DataFrame]) -> DataFrame:
    keys = spark.createDataFrame(
        [("orders", "o_orderkey", 1), ("lineitem", "l_orderkey", 1),
         ("lineitem", "l_linenumber", 2)],
        "table_name string, column_name string, pk_position int",
    )
    return tables.column_metadata(spark, given).join(keys, ["table_name", "column_name"], "left")


# Scans -----------------------------------------------------------------------


@query
def subset_scan(spark: SparkSession, sf: str) -> DataFrame:
    return tables.subset(
        table(spark, sf, "orders"), ["o_orderkey", "o_totalprice"], FILTER
    )


@query
def range_scan(spark: SparkSession, sf: str) -> DataFrame:
    return tables.after_watermark(table(spark, sf, "orders"), "o_orderdate", CUT_DATE)


@query
def sample_scan(spark: SparkSession, sf: str) -> DataFrame:
    return tables.sample_rows(table(spark, sf, "events"), ["ts", "event_id"])


@query
def row_counts(spark: SparkSession, sf: str) -> DataFrame:
    names = ("customer", "supplier", "part", "orders", "lineitem", "events", "documents")
    return tables.row_counts({n: table(spark, sf, n) for n in names})


@query
def new_rows_probe(spark: SparkSession, sf: str) -> DataFrame:
    """Which tables hold orders or shipments after the newest order."""
    orders, lineitem = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    newest = orders.agg(F.max("o_orderdate").alias("newest")).scalar()
    return tables.new_rows_probe(
        {
            "orders": (orders, "o_orderdate", newest),
            "lineitem": (lineitem, "l_shipdate", newest),
            "unknown": (orders, "o_orderdate", None),
        }
    )


@query
def catalog_sync(spark: SparkSession, sf: str) -> DataFrame:
    """A database found by its catalog listing and brought up to date, with header files."""
    source, root = _namespace(spark)
    for name in ("orders", "supplier"):
        sinks.replace_table(table(spark, sf, name), f"{source}.{name}")
    ledger_name, _ = _namespace(spark)
    create_ledgers(spark, ledger_name)
    found = sync.catalog_database(spark, f"srv-{uuid.uuid4().hex}", source)
    headers = work_path(spark, "headers")
    done = sync.sync_fleet(spark, ledger_name, [found], target_root=root, header_root=headers)
    written = spark.read.option("header", True).csv(f"{headers}/{source}/orders")
    return done.select("table_name", "route", "rows_written", "sync_status").withColumn(
        "orders_header", F.lit(",".join(written.columns))
    )


@query
def formatted_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Totals as a reader sees them, with thousands marked."""
    names = ("orders", "lineitem", "events")
    counts = tables.row_counts({n: table(spark, sf, n) for n in names})
    return counts.select("table_name", thousands(F.col("n")).alias("rows"))


@query
def user_tables(spark: SparkSession, sf: str) -> DataFrame:
    listing = derived(spark, sf, "listing")
    skip = spark.createDataFrame(
        [("srv_1", "db_1"), ("srv_2", "db_12")], "server_name string, database_name string"
    )
    kept = tables.user_databases(tables.user_tables(listing), skip)
    return kept.groupBy(
        "server_name", "database_name", "schema_name", "table_name"
    ).agg(F.count("*").alias("seen"))


@query
def requested_databases(spark: SparkSession, sf: str) -> DataFrame:
    runs = derived(spark, sf, "run_ledger").select("server_name", "database_name")
    return tables.requested_databases(
        derived(spark, sf, "listing").select("server_name", "database_name").distinct(), runs
    )


@query
def clean_names(spark: SparkSession, sf: str) -> DataFrame:
    customer = table(spark, sf, "customer")
    dotted = F.concat_ws(".", F.lower("c_mktsegment"), "c_name", F.lit("x y"))
    return customer.select(
        "c_custkey",
        clean_name(F.col("c_name")).alias("cleaned"),
        namespace_name(F.col("c_name"), F.col("c_mktsegment")).alias("namespace"),
        schema_part(dotted).alias("schema_name"),
        table_part(dotted).alias("table_name"),
        schema_part(F.col("c_name")).alias("default_schema"),
        table_part(F.col("c_name")).alias("plain_table"),
    )


# Streams ---------------------------------------------------------------------

DROP_END, DROP_START = "2024-01-17 00:00:00", "2024-01-15 00:00:00"


def _drops(spark: SparkSession, sf: str) -> tuple[DataFrame, list[DataFrame]]:
    """Two overlapping deliveries that cover the whole table."""
    events, ts = table(spark, sf, "events"), F.col("ts")
    return events, [
        events.where(ts < F.lit(DROP_END).cast("timestamp_ntz")),
        events.where(ts >= F.lit(DROP_START).cast("timestamp_ntz")),
    ]


def _streamed(
    spark: SparkSession, sf: str, drop_known: bool, range_column: str | None = "ts"
) -> DataFrame:
    events, drops = _drops(spark, sf)
    inbox, target = work_path(spark, "inbox"), work_path(spark, "stream")
    checkpoint = work_path(spark, "checkpoint")
    for drop in [*drops, None]:
        if drop is not None:
            drop.write.mode("append").parquet(inbox)
        incremental.append_new_files(
            spark, inbox, events.schema, target, checkpoint, drop_known, range_column
        )
    return _target(spark, target, events)


def _target(spark: SparkSession, target: str, like: DataFrame) -> DataFrame:
    found = incremental.read_target(spark, target, like.schema)
    return found.drop(incremental.RUN, incremental.BATCH)


@query
def stream_second_checkpoint(spark: SparkSession, sf: str) -> DataFrame:
    """The checkpoint is lost between two overlapping deliveries; the target is not."""
    events, drops = _drops(spark, sf)
    target = work_path(spark, "stream")
    for drop in drops:
        inbox = work_path(spark, "inbox")
        drop.write.parquet(inbox)
        incremental.append_new_files(
            spark, inbox, events.schema, target, work_path(spark, "checkpoint"), True, "ts"
        )
    return _target(spark, target, events)


@query
def stream_append(spark: SparkSession, sf: str) -> DataFrame:
    return _streamed(spark, sf, drop_known=False)


@query
def stream_incremental(spark: SparkSession, sf: str) -> DataFrame:
    return _streamed(spark, sf, drop_known=True)


@query
def stream_by_filters(spark: SparkSession, sf: str) -> DataFrame:
    """No range column: the filters alone tell which folders are read."""
    return _streamed(spark, sf, drop_known=True, range_column=None)


@query
def stream_live_status(spark: SparkSession, sf: str) -> DataFrame:
    runs, at = derived(spark, sf, "run_ledger"), F.col("updated_at")
    middle = F.lit(DROP_START).cast("timestamp_ntz")
    inbox, target = work_path(spark, "inbox"), work_path(spark, "stream")
    checkpoint = work_path(spark, "checkpoint")
    for drop in (runs.where(at >= middle), runs.where(at < middle)):
        drop.write.mode("append").parquet(inbox)
        live_status.follow_status(spark, inbox, runs.schema, target, checkpoint)
    return live_status.current_view(spark, target)
