"""Views over the append-only ledgers.

The newest row of a key is found by aggregation, not by a window: partial
aggregates combine on the map side, so a key with a third of all runs stays one
row per task.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinkeep.functions.fixed import (
    DATABASE_HISTORY_ROWS,
    ONE_TABLE_HISTORY_ROWS,
    RECENT_SYNCS,
    TABLE_HISTORY_ROWS,
)
from twinkeep.functions.names import qualified
from twinkeep.functions.status import ever_synced, is_completed, printable
from twinkeep.operators.numbering import number_within

#: Spark prunes ranks before a shuffle up to this limit; beyond it a key's rows meet in one task.
MOST_PER_KEY = 1000

DATABASE_KEY = ["server_name", "database_name"]
TABLE_KEY = ["server_name", "database_name", "schema_name", "table_name"]
JOB_KEY = ["server_name", "job_type"]


def matching(df: DataFrame, **wanted: str | None) -> DataFrame:
    """Rows equal to every argument that is given; None means no condition."""
    given: list[Column] = [F.col(c) == F.lit(v) for c, v in wanted.items() if v is not None]
    return df.where(reduce(Column.__and__, given)) if given else df


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The newest row of each key, by the order columns, last one deciding ties."""
    rest = [c for c in df.columns if c not in keys]
    newest = F.max_by(F.struct(*rest), F.struct(*order)).alias("_newest")
    return (
        df.groupBy(*keys)
        .agg(newest)
        .select(*[F.col(c) if c in keys else F.col(f"_newest.{c}").alias(c) for c in df.columns])
    )


def newest_per_key(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int
) -> DataFrame:
    """The newest ``n`` rows of each key. Spark prunes each task to ``n`` rows
    per key before the shuffle, as long as ``n`` is at most ``MOST_PER_KEY``; beyond it rows are
    numbered over all partitions, so no key's history has to fit in one task."""
    if n > MOST_PER_KEY:
        down = [F.col(c).desc() for c in order]
        return number_within(df, keys, down, "_place").where(F.col("_place") <= n).drop("_place")
    window = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn("_place", F.row_number().over(window)).where(
        F.col("_place") <= n
    ).drop("_place")


def newest(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    return df.orderBy(*[F.col(c).desc() for c in order]).limit(n)


def database_state(runs: DataFrame) -> DataFrame:
    """One row per (server, database): a completed full run moves ``last_full_sync`` only,
    any other completed run ``last_incremental_sync`` only; a run that failed or is
    under way moves neither. Status, error and ``updated_at`` are those of the newest run."""
    full = F.col("sync_type") == "full"
    at = F.col("updated_at")
    done = is_completed(F.col("sync_status"))
    newest_run = F.max_by(F.struct("sync_status", "error"), F.struct("updated_at", "run_id"))
    return (
        runs.groupBy(*DATABASE_KEY)
        .agg(
            F.max(F.when(full & done, at)).alias("last_full_sync"),
            F.max(F.when(~full & done, at)).alias("last_incremental_sync"),
            newest_run.alias("_newest"),
            F.min(at).alias("created_at"),
            F.max(at).alias("updated_at"),
        )
        .select(
            *DATABASE_KEY,
            "last_full_sync",
            "last_incremental_sync",
            F.col("_newest.sync_status").alias("sync_status"),
            F.col("_newest.error").alias("error"),
            "created_at",
            "updated_at",
        )
    )


def table_state(runs: DataFrame) -> DataFrame:
    """One row per table: its watermark and when it last moved. Runs that hold
    no watermark do not clear it."""
    held = F.col("last_pk_value").isNotNull()
    order = F.when(held, F.struct("updated_at", "run_id"))
    values = [c for c in ("last_pk_value", "last_pk_type") if c in runs.columns]
    return (
        runs.groupBy(*TABLE_KEY)
        .agg(
            F.max_by(F.struct(*values), order).alias("_newest"),
            F.min("updated_at").alias("created_at"),
            F.max("updated_at").alias("updated_at"),
        )
        .select(
            *TABLE_KEY,
            *[F.col(f"_newest.{v}").alias(v) for v in values],
            "created_at",
            "updated_at",
        )
    )


def database_history(
    runs: DataFrame,
    server: str | None = None,
    database: str | None = None,
    n: int | None = DATABASE_HISTORY_ROWS,
) -> DataFrame:
    """The newest ``n`` runs of each (server, database), or all of them."""
    chosen = matching(runs, server_name=server, database_name=database)
    return chosen if n is None else newest_per_key(
        chosen,
        DATABASE_KEY,
        ["updated_at", "run_id"],
        n,
    )


def table_history(
    state: DataFrame,
    server: str | None = None,
    database: str | None = None,
    n: int | None = TABLE_HISTORY_ROWS,
) -> DataFrame:
    """The ``n`` most recently moved tables of each (server, database), or all of them,
    from the table state."""
    chosen = matching(state, server_name=server, database_name=database)
    if n is not None:
        chosen = newest_per_key(
            chosen, DATABASE_KEY, ["updated_at", "schema_name", "table_name"], n
        )
    return chosen.withColumn("table_fq", qualified(F.col("schema_name"), F.col("table_name")))


def table_sync_history(runs: DataFrame, n: int = ONE_TABLE_HISTORY_ROWS) -> DataFrame:
    """The newest runs of each table."""
    return newest_per_key(runs, TABLE_KEY, ["updated_at", "run_id"], n)


def last_syncs(log: DataFrame, n: int = RECENT_SYNCS) -> DataFrame:
    """The newest entries of the run log, with printable time and details."""
    return newest(log, ["sync_time", "run_id"], n).select(
        "server_name",
        printable(F.col("sync_time")).alias("time"),
        "status",
        F.coalesce("details", F.lit("-")).alias("details"),
    )


def failed_syncs(
    state: DataFrame, server: str | None = None, database: str | None = None
) -> DataFrame:
    """Databases whose newest run did not complete, newest first."""
    status = F.col("sync_status")
    chosen = matching(state, server_name=server, database_name=database)
    return (
        chosen.where(status.isNotNull() & (status != "COMPLETED"))
        .select(
            F.lit("failure").alias("type"),
            *DATABASE_KEY,
            "last_full_sync",
            "last_incremental_sync",
            status.alias("status"),
            "updated_at",
            F.lit("Database sync not completed").alias("message"),
        )
        .orderBy(F.col("updated_at").desc(), *DATABASE_KEY)
    )


def resume_points(state: DataFrame) -> DataFrame:
    """Where the next incremental run of each table continues."""
    return state.select(
        *TABLE_KEY,
        F.col("last_pk_value").alias("resume_from_last_pk"),
        F.lit("queued").alias("action"),
        F.lit("Incremental sync will continue from last_pk on next run.").alias("note"),
    )


def table_sync_status(inventory: DataFrame, state: DataFrame) -> DataFrame:
    """Sync status of every table of an inventory, whether or not it ever ran."""
    return inventory.join(state.drop("created_at"), TABLE_KEY, "left").select(
        *TABLE_KEY,
        "last_pk_value",
        F.col("updated_at").alias("last_sync_time"),
        ever_synced(F.col("updated_at")).alias("sync_status"),
    )


def job_state(runs: DataFrame) -> DataFrame:
    """The newest row of each (server, job type): a later row replaces earlier ones."""
    return latest_per_key(runs, JOB_KEY, ["created_at", "run_id"])


def live_jobs(state: DataFrame) -> DataFrame:
    """Jobs not marked deleted (a NULL status is live), newest first."""
    return (
        state.where(~F.col("status").eqNullSafe("deleted"))
        .orderBy(F.col("created_at").desc(), "server_name", "job_type")
        .select(
            F.col("server_name").alias("server"),
            F.col("job_type").alias("type"),
            F.coalesce(printable(F.col("last_run")), F.lit("-")).alias("last_run"),
            "status",
            F.coalesce("error", F.lit("-")).alias("error"),
        )
    )


def history_report(databases: DataFrame, tables: DataFrame) -> DataFrame:
    """Database and table history in one frame; columns one lacks are NULL."""
    return databases.unionByName(tables, allowMissingColumns=True)
