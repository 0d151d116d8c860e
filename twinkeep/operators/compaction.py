"""Compacted ledgers: state from a snapshot and the rows appended since.

A ledger only grows, and state is a view over all of it. A snapshot keeps the few rows
that decide the state (at most a handful per key) and the names of the ledger's files that
it covers. A row of the ledger ``snapshots``, appended last, makes it the one in force. State
then reads the snapshot and only the files that it does not cover, so a run's start costs what
was appended since the last snapshot. The ledger itself is left as it is: histories stay whole.

A compaction that dies before its last row leaves a folder that nothing points to. Two at a
time are harmless too: each snapshot covers just the files it read. Rows appended meanwhile
lie in files that it does not cover. The driver holds names of files, never rows.
"""

from __future__ import annotations

import uuid
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from twinkeep.functions.status import is_completed
from twinkeep.operators.ledger import DATABASE_KEY, JOB_KEY, TABLE_KEY
from twinkeep.session import work_path
from twinkeep.sources.ledger_tables import (
    DATABASE_RUNS,
    JOB_RUNS,
    SCHEMAS,
    SNAPSHOTS,
    TABLE_RUNS,
    append_rows,
    create_ledgers,
)


def _deciding(ledger: str, row: Column) -> tuple[list[str], list[Column]]:
    """The key of a ledger's state, and the rows per key that decide it."""
    at, order = F.col("updated_at"), F.struct("updated_at", "run_id")
    bounds = [F.min_by(row, at), F.max_by(row, at), F.any_value(row)]
    if ledger == DATABASE_RUNS:
        full, done = F.col("sync_type") == "full", is_completed(F.col("sync_status"))
        ends = [F.max_by(row, F.when(side & done, at)) for side in (full, ~full)]
        return DATABASE_KEY, [F.max_by(row, order), *ends, *bounds]
    if ledger == TABLE_RUNS:
        return TABLE_KEY, [F.max_by(row, F.when(F.col("last_pk_value").isNotNull(), order)), *bounds]
    return JOB_KEY, [F.max_by(row, F.struct("created_at", "run_id"))]


def deciding_rows(runs: DataFrame, ledger: str) -> DataFrame:
    """The rows of a ledger whose state is that of all its rows, combined per task first."""
    keys, chosen = _deciding(ledger, F.struct(*runs.columns))
    return (
        runs.groupBy(*keys)
        .agg(F.array_distinct(F.array_compact(F.array(*chosen))).alias("_rows"))
        .select(F.inline("_rows"))
    )


def _files(spark: SparkSession, namespace: str, ledger: str) -> list[str]:
    spark.catalog.refreshTable(f"`{namespace}`.`{ledger}`")
    return spark.table(f"`{namespace}`.`{ledger}`").inputFiles()


def _in_force(spark: SparkSession, namespace: str, ledger: str) -> tuple[str | None, set[str]]:
    """The folder of the snapshot in force, and the files it covers."""
    if not spark.catalog.tableExists(f"`{namespace}`.`{SNAPSHOTS}`"):
        return None, set()
    spark.catalog.refreshTable(f"`{namespace}`.`{SNAPSHOTS}`")
    own = spark.table(f"`{namespace}`.`{SNAPSHOTS}`").where(F.col("ledger") == ledger)
    path = own.agg(F.max_by("path", "run_id")).first()[0]
    covered = spark.read.schema("file string").parquet(f"{path}/files").collect() if path else []
    return path, {r.file for r in covered}


def state_rows(spark: SparkSession, namespace: str, ledger: str) -> DataFrame:
    """Rows of a ledger that give its state: of the snapshot in force, if any, and of the
    files appended since."""
    path, covered = _in_force(spark, namespace, ledger)
    if path is None:
        return spark.table(f"`{namespace}`.`{ledger}`")
    return _snapshot_and_tail(spark, ledger, path, [f for f in _files(spark, namespace, ledger) if f not in covered])


def _snapshot_and_tail(spark: SparkSession, ledger: str, path: str | None, tail: list[str]) -> DataFrame:
    found = spark.createDataFrame([], SCHEMAS[ledger])
    for paths in ([f"{path}/rows"] if path else [], [unquote(f) for f in tail]):
        if paths:
            found = found.unionByName(spark.read.schema(SCHEMAS[ledger]).parquet(*paths))
    return found


def compact_ledger(spark: SparkSession, namespace: str, ledger: str, root: str | None = None) -> int:
    """Write a new snapshot of a ledger and put it in force. Gives the number of files that
    state no longer reads; 0 where nothing was appended since the last one."""
    if ledger not in (DATABASE_RUNS, TABLE_RUNS, JOB_RUNS):
        raise ValueError(f"no state is kept of {ledger}")
    path, covered = _in_force(spark, namespace, ledger)
    files = _files(spark, namespace, ledger)
    tail = [f for f in files if f not in covered]
    if not tail:
        return 0
    folder = f"{root.rstrip('/')}/{ledger}-{uuid.uuid4().hex}" if root else work_path(spark, f"{ledger}-snapshot")
    rows = deciding_rows(_snapshot_and_tail(spark, ledger, path, tail), ledger)
    rows.write.parquet(f"{folder}/rows")
    spark.createDataFrame([(f,) for f in files], "file string").coalesce(1).write.parquet(f"{folder}/files")
    create_ledgers(spark, namespace)
    append_rows(spark, namespace, SNAPSHOTS, [{"ledger": ledger, "path": folder}])
    return len(tail)
