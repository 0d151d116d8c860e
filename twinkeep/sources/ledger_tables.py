"""Append-only ledgers. State is a view over them, so no row is ever updated."""

from __future__ import annotations

import time
from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinkeep.sources.sinks import ensure_namespace

DATABASE_RUNS = "database_runs"
TABLE_RUNS = "table_runs"
RUN_LOG = "run_log"
JOB_RUNS = "job_runs"
SNAPSHOTS = "snapshots"

SCHEMAS: dict[str, str] = {
    DATABASE_RUNS: """run_id bigint, server_name string, database_name string,
        sync_type string, sync_status string, error string, updated_at timestamp_ntz""",
    TABLE_RUNS: """run_id bigint, server_name string, database_name string,
        schema_name string, table_name string, route string, rows_written bigint,
        last_pk_value string, last_pk_type string, sync_status string, error string,
        updated_at timestamp_ntz, added_columns string""",
    RUN_LOG: """run_id bigint, server_name string, sync_time timestamp_ntz,
        status string, details string""",
    JOB_RUNS: """run_id bigint, server_name string, job_type string,
        last_run timestamp_ntz, status string, error string, created_at timestamp_ntz""",
    SNAPSHOTS: "run_id bigint, ledger string, path string",
}


def create_ledgers(spark: SparkSession, namespace: str, root: str | None = None) -> None:
    """Create the ledger tables that do not exist yet."""
    ensure_namespace(spark, namespace, root)
    for name, columns in SCHEMAS.items():
        spark.sql(f"CREATE TABLE IF NOT EXISTS `{namespace}`.`{name}` ({columns}) USING parquet")


def append_rows(
    spark: SparkSession, namespace: str, ledger: str, rows: Iterable[Mapping[str, object]]
) -> None:
    """Append ledger rows: a handful per run, one file. Order of ``run_id``
    follows the order of the rows."""
    schema = T.DataType.fromDDL(SCHEMAS[ledger])
    start = time.time_ns() // 1000
    records = [
        tuple({"run_id": start + place, **row}.get(f.name) for f in schema)
        for place, row in enumerate(rows)
    ]
    if records:
        frame = spark.createDataFrame(records, schema).coalesce(1)
        frame.write.insertInto(f"{namespace}.{ledger}")


def run_log_entries(entries: DataFrame) -> DataFrame:
    """Entries for the run log; missing details become ``-``."""
    return entries.withColumn("details", F.coalesce("details", F.lit("-")))
