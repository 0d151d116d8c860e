"""Alerts and run sessions, from ledgers, counts and logs."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinkeep.functions.fixed import RECENT_SESSIONS, STALE_HOURS
from twinkeep.functions.names import qualified
from twinkeep.functions.status import (
    count_status,
    epoch_millis,
    hours_between,
    millis_between,
    severity,
)
from twinkeep.operators.ledger import DATABASE_KEY, failed_syncs, matching, newest_per_key
from twinkeep.operators.logs import is_error_line
from twinkeep.sources.text_log import log_tail, logged_at


def _no_text() -> Column:
    return F.lit(None).cast("string")


def _alert(
    severity_: Column,
    message: Column,
    category: str,
    server: Column | None = None,
    database: Column | None = None,
    table: Column | None = None,
    at: Column | None = None,
) -> list[Column]:
    return [
        severity_.alias("severity"),
        message.alias("message"),
        (_no_text() if server is None else server).alias("server_name"),
        (_no_text() if database is None else database).alias("database_name"),
        (_no_text() if table is None else table).alias("table_name"),
        (F.lit(None) if at is None else at).cast("timestamp_ntz").alias("occurred_at"),
        F.lit(category).alias("category"),
    ]


def state_alerts(state: DataFrame, as_of: str, hours: int = STALE_HOURS) -> DataFrame:
    """Runs that did not complete and syncs gone stale, from one pass over the
    state: each database gives up to two alerts."""
    level = severity(F.col("sync_status"))
    last = F.coalesce("last_incremental_sync", "last_full_sync")
    age = hours_between(F.lit(as_of).cast("timestamp_ntz"), last)
    server, database = F.col("server_name"), F.col("database_name")
    unfinished = F.struct(
        _alert(
            level,
            F.lit("Database sync status not completed"),
            "status",
            server,
            database,
            at=F.col("updated_at"),
        )
    )
    stale = F.struct(
        _alert(
            F.lit("WARNING"),
            F.concat(F.lit("Stale sync ("), age.cast("string"), F.lit("h)")),
            "stale",
            server,
            database,
        )
    )
    found = F.array_compact(
        F.array(
            F.when(level != "INFO", unfinished), F.when(_is_stale(last, as_of, hours), stale)
        )
    )
    return state.select(F.inline(found))


def consistency_alerts(snapshots: DataFrame) -> DataFrame:
    src, dst = F.col("rows_source"), F.col("rows_destination")
    empty = (dst == 0) & (src > 0)
    return snapshots.where(src != dst).select(
        _alert(
            F.when(empty, "HIGH").otherwise("WARNING"),
            F.when(empty, "Destination empty but source has rows").otherwise("Row counts differ"),
            "consistency",
            F.col("server_name"),
            F.col("database_name"),
            qualified(F.col("schema_name"), F.col("table_name")),
        )
    )


def _is_stale(last: Column, as_of: str, hours: int) -> Column:
    return last < F.lit(as_of).cast("timestamp_ntz") - F.make_dt_interval(hours=F.lit(hours))


def stale_syncs(state: DataFrame, as_of: str, hours: int = STALE_HOURS) -> DataFrame:
    """Databases whose last sync is more than ``hours`` before ``as_of``."""
    last = F.coalesce("last_incremental_sync", "last_full_sync")
    return state.where(_is_stale(last, as_of, hours)).select(
        *DATABASE_KEY,
        last.alias("last_sync"),
        hours_between(F.lit(as_of).cast("timestamp_ntz"), last).alias("age_hours"),
    )


def job_alerts(jobs: DataFrame) -> DataFrame:
    message = F.concat(
        F.lit("Schedule failed ("),
        F.col("job_type"),
        F.lit("): "),
        F.coalesce("error", F.lit("")),
    )
    return jobs.where(F.col("status") == "failed").select(
        _alert(F.lit("HIGH"), message, "schedule", F.col("server_name"))
    )


def log_alerts(
    lines: DataFrame, as_of: str, hours: int = STALE_HOURS, tail: int | None = None
) -> DataFrame:
    """Error lines of the last ``hours`` before ``as_of``, and those without a time; with
    ``tail`` only those among the newest lines of the whole log."""
    end, at = F.lit(as_of).cast("timestamp_ntz"), logged_at(F.col("line"))
    chosen = lines if tail is None else log_tail(lines, tail)
    recent = at.isNull() | (
        (at <= end) & (at >= end - F.make_dt_interval(hours=F.lit(hours)))
    )
    return chosen.where(is_error_line(F.col("line")) & recent).select(
        _alert(F.lit("CRITICAL"), F.trim("line"), "log")
    )


def alerts_with_severity(
    state: DataFrame,
    snapshots: DataFrame,
    jobs: DataFrame,
    lines: DataFrame,
    as_of: str,
    server: str | None = None,
    database: str | None = None,
) -> DataFrame:
    """All alerts in one frame. Absent arguments do not filter; log lines name no
    server and are always kept."""
    of_database = {"server_name": server, "database_name": database}
    parts: Sequence[DataFrame] = (
        state_alerts(matching(state, **of_database), as_of),
        consistency_alerts(matching(snapshots, **of_database)),
        job_alerts(matching(jobs, server_name=server)),
        log_alerts(lines, as_of),
    )
    return reduce(DataFrame.unionByName, parts)


def alert_counts(alerts: DataFrame) -> DataFrame:
    level = F.col("severity")
    return alerts.agg(
        F.count("*").alias("total"),
        F.count_if(level == "CRITICAL").alias("critical"),
        F.count_if(level == "HIGH").alias("high"),
        F.count_if(level == "WARNING").alias("warning"),
    )


def alerts_basic(state: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Failed databases, tables whose counts differ, and empty destinations."""
    failures = failed_syncs(state).select(
        F.lit("failures").alias("kind"), *DATABASE_KEY, _no_text().alias("table_name"), "message"
    )
    status = count_status(F.col("rows_source"), F.col("rows_destination"))
    tables = snapshots.withColumn("_status", status).where(F.col("_status") != "ok")
    warning = F.col("_status") == "warning"
    return failures.unionByName(
        tables.select(
            F.when(warning, "warnings").otherwise("failures").alias("kind"),
            *DATABASE_KEY,
            qualified(F.col("schema_name"), F.col("table_name")).alias("table_name"),
            F.when(warning, "Row counts differ").otherwise("Destination empty").alias("message"),
        )
    )


def recent_sessions(
    state: DataFrame, snapshots: DataFrame, n: int = RECENT_SESSIONS
) -> DataFrame:
    """The newest runs of each database as sessions, with the totals of its tables."""
    totals = snapshots.groupBy(*DATABASE_KEY).agg(
        F.count("*").alias("total_tables"),
        F.sum("rows_source").alias("total_rows_source"),
        F.sum("rows_destination").alias("total_rows_destination"),
    )
    started = F.coalesce("last_full_sync", "last_incremental_sync", "updated_at")
    finished = F.col("updated_at")
    level = severity(F.col("sync_status"))
    status = F.col("sync_status")
    none = F.array().cast("array<string>")
    number = F.lit(0).cast("bigint")
    return (
        newest_per_key(state, DATABASE_KEY, ["updated_at"], n)
        .join(totals, DATABASE_KEY, "left")
        .select(
            F.concat_ws(
                ":",
                *DATABASE_KEY,
                epoch_millis(finished).cast("string"),
            ).alias("session_id"),
            *DATABASE_KEY,
            started.alias("started_at"),
            finished.alias("finished_at"),
            millis_between(finished, started).alias("duration_ms"),
            F.coalesce("total_tables", number).alias("total_tables"),
            F.coalesce("total_rows_source", number).alias("total_rows_source"),
            F.coalesce("total_rows_destination", number).alias("total_rows_destination"),
            F.when(level != "INFO", F.array(F.concat(F.lit("Database status: "), status)))
            .otherwise(none)
            .alias("warnings"),
            F.when(level == "CRITICAL", F.array(F.concat(F.lit("Status "), status)))
            .otherwise(none)
            .alias("errors"),
        )
    )


def session_report(sessions: DataFrame, snapshots: DataFrame, alerts: DataFrame) -> DataFrame:
    """Per database its newest session, its tables as an array, and its alert
    counts. Only ledger-sized values are nested."""
    newest = newest_per_key(sessions, DATABASE_KEY, ["finished_at"], 1)
    tables = snapshots.groupBy(*DATABASE_KEY).agg(
        F.array_sort(
            F.collect_list(
                F.struct(
                    qualified(F.col("schema_name"), F.col("table_name")).alias("table_name"),
                    "rows_source",
                    "rows_destination",
                )
            )
        ).alias("tables")
    )
    counts = (
        alerts.where(F.col("database_name").isNotNull())
        .groupBy(*DATABASE_KEY)
        .agg(
            F.count("*").alias("alerts_total"),
            F.count_if(F.col("severity") == "CRITICAL").alias("alerts_critical"),
            F.count_if(F.col("severity") == "HIGH").alias("alerts_high"),
            F.count_if(F.col("severity") == "WARNING").alias("alerts_warning"),
        )
    )
    return (
        newest.join(tables, DATABASE_KEY, "left")
        .join(counts, DATABASE_KEY, "left")
        .na.fill(0, ["alerts_total", "alerts_critical", "alerts_high", "alerts_warning"])
    )
