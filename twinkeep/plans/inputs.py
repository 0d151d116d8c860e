"""Inputs of the registered queries, as SQL over the given tables.

Each text runs unchanged in Spark and in the SQL engine that checks the
results; ``{name}`` stands for a given table.
"""

from __future__ import annotations

import string

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

SQL: dict[str, str] = {
    "replica_src": """
        SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate,
               CASE WHEN o_orderkey % 25 = 1 THEN NULL ELSE o_orderpriority END AS o_orderpriority
        FROM {orders}
        UNION ALL
        SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority
        FROM {orders} WHERE o_orderkey % 50 IN (13, 14)""",
    "replica_dst": """
        SELECT o_orderkey, o_custkey, o_orderstatus,
               CASE WHEN o_orderkey % 10 = 7 THEN o_totalprice + 1 ELSE o_totalprice END
                   AS o_totalprice,
               o_orderdate,
               CASE WHEN o_orderkey % 25 = 1 THEN '' ELSE o_orderpriority END AS o_orderpriority
        FROM {orders} WHERE o_orderkey % 10 <> 3
        UNION ALL
        SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority
        FROM {orders} WHERE o_orderkey % 50 = 12
        UNION ALL
        SELECT o_orderkey + 10000000, o_custkey, o_orderstatus, o_totalprice, o_orderdate,
               o_orderpriority
        FROM {orders} WHERE o_orderkey % 100 = 5
        UNION ALL
        SELECT o_orderkey + 10000000, o_custkey, o_orderstatus, o_totalprice, o_orderdate,
               o_orderpriority
        FROM {orders} WHERE o_orderkey % 200 = 5""",
    "run_ledger": """
        SELECT event_id AS run_id,
               'srv_' || CAST(user_id % 5 AS VARCHAR(10)) AS server_name,
               'db_' || CAST(user_id AS VARCHAR(10)) AS database_name,
               CASE WHEN event_type = 'signup' THEN 'full' ELSE 'incremental' END AS sync_type,
               CASE WHEN event_id % 50 = 0 THEN NULL
                    WHEN event_type = 'error' THEN 'FAILED'
                    WHEN event_type = 'purchase' THEN 'WARNING_ROWS'
                    WHEN event_type = 'view' AND value > 50 THEN 'RUNNING'
                    ELSE 'COMPLETED' END AS sync_status,
               CASE WHEN event_type <> 'error' THEN NULL
                    WHEN event_id % 5 = 0 THEN 'Login timed out'
                    WHEN event_id % 5 = 1 THEN 'Connection refused by host'
                    WHEN event_id % 5 = 2 THEN 'Invalid column name c1'
                    WHEN event_id % 5 = 3 THEN 'Duplicate key value'
                    ELSE 'Disk full' END AS error,
               ts AS updated_at
        FROM {events}""",
    "table_ledger": """
        SELECT event_id AS run_id,
               'srv_' || CAST(user_id % 5 AS VARCHAR(10)) AS server_name,
               'db_' || CAST(user_id % 20 AS VARCHAR(10)) AS database_name,
               'dbo' AS schema_name,
               't_' || CAST(event_id % 7 AS VARCHAR(10)) AS table_name,
               event_id AS last_pk_value, ts AS updated_at
        FROM {events}""",
    # Rows of the replicated tables the table ledger speaks of, one per data row.
    # Tables t_3 never arrived; of t_5 one kind of row is missing.
    "snapshot_src": """
        SELECT 'srv_' || CAST(user_id % 5 AS VARCHAR(10)) AS server_name,
               'db_' || CAST(user_id % 20 AS VARCHAR(10)) AS database_name,
               'dbo' AS schema_name,
               't_' || CAST(event_id % 7 AS VARCHAR(10)) AS table_name,
               CAST(1 AS BIGINT) AS n
        FROM {events}""",
    "snapshot_dst": """
        SELECT 'srv_' || CAST(user_id % 5 AS VARCHAR(10)) AS server_name,
               'db_' || CAST(user_id % 20 AS VARCHAR(10)) AS database_name,
               'dbo' AS schema_name,
               't_' || CAST(event_id % 7 AS VARCHAR(10)) AS table_name,
               CAST(1 AS BIGINT) AS n
        FROM {events}
        WHERE event_id % 7 <> 3 AND (event_id % 7 <> 5 OR event_type <> 'click')""",
    "fleet_counts": """
        SELECT 'srv_a' AS server_name, 'sales' AS database_name, 'dbo.orders' AS table_name,
               'src' AS side, count(*) AS n FROM {orders}
        UNION ALL SELECT 'srv_a', 'sales', 'dbo.orders', 'dst', count(*) FROM {orders}
            WHERE o_orderkey % 10 <> 3
        UNION ALL SELECT 'srv_a', 'sales', 'dbo.lineitem', 'src', count(*) FROM {lineitem}
        UNION ALL SELECT 'srv_a', 'sales', 'dbo.lineitem', 'dst', count(*) FROM {lineitem}
            WHERE l_orderkey % 4 <> 0
        UNION ALL SELECT 'srv_a', 'master_data', 'dbo.customer', 'src', count(*) FROM {customer}
        UNION ALL SELECT 'srv_a', 'master_data', 'dbo.customer', 'dst', count(*) FROM {customer}
            WHERE c_custkey % 20 <> 0
        UNION ALL SELECT 'srv_a', 'master_data', 'dbo.part', 'src', count(*) FROM {part}
        UNION ALL SELECT 'srv_a', 'master_data', 'dbo.part', 'dst', count(*) FROM {part}
        UNION ALL SELECT 'srv_b', 'purchasing', 'dbo.supplier', 'src', count(*) FROM {supplier}
        UNION ALL SELECT 'srv_b', 'purchasing', 'dbo.supplier', 'dst', CAST(0 AS BIGINT)
        UNION ALL SELECT 'srv_b', 'geo', 'dbo.nation', 'src', count(*) FROM {nation}
        UNION ALL SELECT 'srv_b', 'geo', 'dbo.nation', 'dst', count(*) FROM {nation}""",
    # Watermarks of the fleet tables; supplier never ran.
    "fleet_state": """
        SELECT 'srv_a' AS server_name, 'sales' AS database_name, 'dbo' AS schema_name,
               'orders' AS table_name, CAST(max(o_orderkey) AS VARCHAR(20)) AS last_pk_value,
               max(o_orderdate) AS updated_at FROM {orders}
        UNION ALL SELECT 'srv_a', 'sales', 'dbo', 'lineitem',
               CAST(max(l_orderkey) AS VARCHAR(20)), max(l_shipdate) FROM {lineitem}
        UNION ALL SELECT 'srv_a', 'master_data', 'dbo', 'customer',
               CAST(max(c_custkey) AS VARCHAR(20)), CAST('2024-01-01 00:00:00' AS TIMESTAMP_NTZ)
               FROM {customer}""",
    "log_lines": """
        SELECT event_id AS line_no, CAST(ts AS VARCHAR(30)) ||
               CASE WHEN event_type = 'signup' THEN ' - INFO - Added columns on dbo.t'
                         || CAST(user_id % 7 AS VARCHAR(10)) || ': [''c'
                         || CAST(event_id % 3 AS VARCHAR(10)) || ''', ''d'']'
                    WHEN event_type = 'error' THEN ' - ERROR - Failed to sync/load dbo.t'
                         || CAST(user_id % 7 AS VARCHAR(10)) || ': Login timed out'
                    ELSE ' - INFO - Completed srv_' || CAST(user_id % 5 AS VARCHAR(10)) END AS line
        FROM {events}""",
    "job_ledger": """
        SELECT event_id AS run_id,
               'srv_' || CAST(user_id % 5 AS VARCHAR(10)) AS server_name,
               'interval_' || CAST(user_id % 30 AS VARCHAR(10)) || 'm' AS job_type,
               CASE WHEN event_type = 'view' THEN NULL ELSE ts END AS last_run,
               CASE WHEN event_type = 'error' THEN 'failed'
                    WHEN event_type = 'click' THEN 'deleted'
                    WHEN event_type = 'view' THEN NULL
                    ELSE 'success' END AS status,
               CASE WHEN event_type = 'error' AND event_id % 2 = 0 THEN 'Login timed out' END
                   AS error,
               ts AS created_at
        FROM {events}""",
    "run_log": """
        SELECT event_id AS run_id, 'srv_' || CAST(user_id % 5 AS VARCHAR(10)) AS server_name,
               ts AS sync_time,
               CASE WHEN event_type = 'error' THEN 'failed' ELSE 'success' END AS status,
               CASE WHEN event_type = 'error' THEN 'Disk full' END AS details
        FROM {events}""",
    "listing": """
        SELECT 'srv_' || CAST(user_id % 5 AS VARCHAR(10)) AS server_name,
               CASE event_type WHEN 'click' THEN 'master' WHEN 'error' THEN 'tempdb'
                    ELSE 'db_' || CAST(user_id % 20 AS VARCHAR(10)) END AS database_name,
               CASE WHEN event_id % 11 = 0 THEN 'SYS' ELSE 'dbo' END AS schema_name,
               't_' || CAST(event_id % 7 AS VARCHAR(10)) AS table_name
        FROM {events}""",
    "evolved_src": """
        SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority,
               CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice * 0.5 END AS o_discounted
        FROM {orders}""",
}


def tables_in(text: str) -> list[str]:
    """The given tables a text reads."""
    names = [name for _, name, _, _ in string.Formatter().parse(text) if name]
    return list(dict.fromkeys(names))


_SCHEMAS: dict[str, StructType] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table. Its schema is inferred once per path: every inference is a
    small job over file footers."""
    path = f"{sf_dir}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def derived(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived input as a DataFrame."""
    text = SQL[name]
    return spark.sql(text, **{t: table(spark, sf_dir, t) for t in tables_in(text)})


def as_ctes(*names: str) -> str:
    """The same inputs as common table expressions for the checking engine."""
    parts = []
    for name in names:
        text = SQL[name].replace("TIMESTAMP_NTZ", "TIMESTAMP")
        parts.append(f"{name} AS ({text.format(**{t: t for t in tables_in(text)})})")
    return "WITH " + ",\n".join(parts) + "\n"
