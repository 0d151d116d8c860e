"""SQL counterparts of the registered queries, for an independent engine."""

from __future__ import annotations

from twinkeep.plans.inputs import as_ctes
from twinkeep.plans.registry import AS_OF, CUT_DATE, DROP_END, DROP_START

_CUT = f"TIMESTAMP '{CUT_DATE} 00:00:00'"
_FILTER = "o_orderdate >= TIMESTAMP '1995-01-01 00:00:00' AND o_orderstatus <> 'F'"
_ORDER_COLUMNS = (
    "o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority"
)
_FOLDED = _ORDER_COLUMNS.replace(
    "o_orderpriority", "coalesce(o_orderpriority, '') AS o_orderpriority"
)

# The comparison pair, its folded form, and copies per different row.
_PAIR = as_ctes("replica_src", "replica_dst")
_PAIR_COUNTS = (
    _PAIR
    + f""", folded AS (
    SELECT {_FOLDED}, 1 AS s, 0 AS d FROM replica_src
    UNION ALL SELECT {_FOLDED}, 0 AS s, 1 AS d FROM replica_dst),
per_row AS (SELECT {_ORDER_COLUMNS}, sum(s) AS s, sum(d) AS d FROM folded GROUP BY ALL)
"""
)
_MATCH = """x.o_orderkey = y.o_orderkey AND x.o_custkey = y.o_custkey
    AND x.o_orderstatus = y.o_orderstatus AND x.o_totalprice = y.o_totalprice
    AND x.o_orderdate = y.o_orderdate
    AND coalesce(x.o_orderpriority, '') = coalesce(y.o_orderpriority, '')"""


def _anti(left: str, right: str) -> str:
    return f"SELECT * FROM {left} x WHERE NOT EXISTS (SELECT 1 FROM {right} y WHERE {_MATCH})"


_COUNTS = """
    CAST(sum(s) AS BIGINT) AS rows_source,
    CAST(sum(d) AS BIGINT) AS rows_destination,
    CAST(sum(greatest(s - 1, 0)) AS BIGINT) AS duplicate_source_rows,
    CAST(sum(greatest(d - 1, 0)) AS BIGINT) AS duplicate_destination_rows,
    CAST(coalesce(sum(CASE WHEN d = 0 THEN s END), 0) AS BIGINT) AS missing_rows,
    CAST(coalesce(sum(CASE WHEN s = 0 THEN d END), 0) AS BIGINT) AS extra_rows,
    count(CASE WHEN d = 0 THEN 1 END) AS missing_distinct,
    count(CASE WHEN s = 0 THEN 1 END) AS extra_distinct,
    count(CASE WHEN s > 0 AND d > 0 THEN 1 END) AS both_distinct"""

_SQL: dict[str, str] = {}

_SQL["compare_missing_rows"] = _PAIR + _anti("replica_src", "replica_dst")
_SQL["compare_extra_rows"] = _PAIR + _anti("replica_dst", "replica_src")
_SQL["compare_counts"] = _PAIR_COUNTS + f"SELECT {_COUNTS} FROM per_row"
_SQL["compare_heads"] = (
    _PAIR
    + f"""
SELECT * FROM (SELECT *, 'source' AS side FROM replica_src ORDER BY {_ORDER_COLUMNS} LIMIT 10)
UNION ALL
SELECT * FROM (SELECT *, 'destination' AS side FROM replica_dst
               ORDER BY {_ORDER_COLUMNS} LIMIT 10)"""
)
_SQL["compare_wide_rows"] = """
SELECT x.* FROM documents x WHERE NOT EXISTS (
    SELECT 1 FROM documents y WHERE y.lang <> 'en' AND x.doc_id = y.doc_id AND x.text = y.text
      AND x.lang = y.lang AND x.source = y.source AND x.n_chars = y.n_chars)"""
_SQL["delta_rows"] = _SQL["compare_missing_rows"]
_SQL["delta_summary"] = (
    _PAIR_COUNTS
    + """SELECT CAST(coalesce(sum(CASE WHEN d = 0 THEN s END), 0) AS BIGINT) AS delta_count,
    CAST(sum(s) AS BIGINT) AS total_source_rows,
    CAST(sum(d) AS BIGINT) AS total_destination_rows FROM per_row"""
)
_SQL["validate_table"] = (
    _PAIR_COUNTS
    + f"""SELECT rows_source, rows_destination, duplicate_source_rows, duplicate_destination_rows,
    missing_distinct AS delta_missing, extra_distinct AS delta_extra
FROM (SELECT {_COUNTS} FROM per_row)"""
)
_SQL["validate_self"] = """
WITH per_row AS (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_partkey, l_suppkey,
    l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus,
    l_shipdate)
SELECT CAST(sum(n) AS BIGINT) AS rows_source, CAST(sum(n) AS BIGINT) AS rows_destination,
    CAST(sum(n - 1) AS BIGINT) AS duplicate_source_rows,
    CAST(sum(n - 1) AS BIGINT) AS duplicate_destination_rows,
    CAST(0 AS BIGINT) AS delta_missing, CAST(0 AS BIGINT) AS delta_extra
FROM per_row"""
_SQL["verify_consistency"] = (
    _PAIR
    + """, n AS (SELECT (SELECT count(*) FROM replica_src) AS rows_source,
    (SELECT count(*) FROM replica_dst) AS rows_destination)
SELECT *, CASE WHEN rows_source = rows_destination THEN 'ok'
    WHEN rows_destination > 0 THEN 'warning' ELSE 'error' END AS status FROM n"""
)
_SQL["partial_preview"] = (
    _PAIR
    + f""", l AS (SELECT o_orderkey, o_totalprice FROM replica_src WHERE {_FILTER}),
r AS (SELECT o_orderkey, o_totalprice FROM replica_dst)
SELECT (SELECT count(*) FROM l) AS rows_source, (SELECT count(*) FROM r) AS rows_destination,
    (SELECT count(*) FROM (SELECT * FROM l EXCEPT SELECT * FROM r)) AS would_insert,
    (SELECT count(*) FROM (SELECT * FROM l INTERSECT SELECT * FROM r)) AS already_synced"""
)
_SQL["debug_new_rows"] = (
    _PAIR
    + f""", missing AS ({_anti("replica_src", "replica_dst")})
SELECT {_FOLDED}, (SELECT count(*) FROM missing) AS missing_total
FROM missing ORDER BY {_ORDER_COLUMNS} LIMIT 100"""
)
_SQL["duplicate_rows"] = (
    as_ctes("replica_dst")
    + f"""SELECT {_ORDER_COLUMNS}, count(*) - 1 AS later_copies
FROM (SELECT {_FOLDED} FROM replica_dst) GROUP BY ALL HAVING count(*) > 1"""
)
_SQL["duplicate_counts"] = as_ctes("replica_dst") + """
SELECT copies, count(*) AS different_rows FROM (
    SELECT count(*) AS copies FROM replica_dst GROUP BY o_orderkey, o_custkey, o_orderstatus,
        o_totalprice, o_orderdate, o_orderpriority)
GROUP BY copies"""

_KEYS = """SELECT '{0}' AS table_name, '{1}' AS key, CAST(sum(n) AS BIGINT) AS total_rows,
    count(*) FILTER (WHERE n > 1 AND NOT bad) AS repeated_keys,
    CAST(coalesce(sum(n) FILTER (WHERE bad), 0) AS BIGINT) AS null_rows,
    count(*) FILTER (WHERE bad OR n > 1) = 0 AS is_key
FROM (SELECT {1}, bool_or({2}) AS bad, count(*) AS n FROM {3} GROUP BY {1})"""
_SQL["verified_keys"] = (
    as_ctes("replica_src")
    + """, undated AS (SELECT * REPLACE (CASE WHEN o_orderkey % 30 <> 0 THEN o_custkey END AS o_custkey) FROM replica_src)
"""
    + "\nUNION ALL ".join(
        [
            _KEYS.format("orders", "o_orderkey", "o_orderkey IS NULL", "orders"),
            _KEYS.format("lineitem", "l_orderkey", "l_orderkey IS NULL", "lineitem"),
            _KEYS.format("replica", "o_orderkey,o_custkey", "o_orderkey IS NULL OR o_custkey IS NULL", "undated"),
        ]
    )
)
_SQL["marked_copies"] = as_ctes("replica_dst") + f"""
SELECT {_ORDER_COLUMNS}, row_number() OVER (PARTITION BY {_ORDER_COLUMNS}) AS copy_number FROM replica_dst"""
_SQL["marked_statuses"] = """
SELECT o_orderkey, o_orderstatus, o_totalprice, row_number() OVER (
    PARTITION BY o_orderstatus ORDER BY o_totalprice DESC, o_orderkey) AS copy_number FROM orders"""
_VALUES = {
    "o_orderkey": "CAST({0}.o_orderkey AS VARCHAR)",
    "o_custkey": "CAST({0}.o_custkey AS VARCHAR)",
    "o_orderstatus": "{0}.o_orderstatus",
    "o_totalprice": "CAST({0}.o_totalprice AS VARCHAR)",
    "o_orderdate": "CAST({0}.o_orderdate AS VARCHAR)",
    "o_orderpriority": "coalesce({0}.o_orderpriority, '')",
}
# Keys that are alike in both tables have one differing row at most on each side here.
_ALIGNED = (
    _PAIR
    + f""", left_rows AS (SELECT *, row_number() OVER (PARTITION BY o_orderkey) AS copy FROM ({_anti("replica_src", "replica_dst")})),
right_rows AS (SELECT *, row_number() OVER (PARTITION BY o_orderkey) AS copy FROM ({_anti("replica_dst", "replica_src")})),
aligned AS (
  SELECT CASE WHEN r.o_orderkey IS NULL THEN 'inserted' WHEN l.o_orderkey IS NULL THEN 'deleted' ELSE 'changed' END AS kind,
         coalesce(l.o_orderkey, r.o_orderkey) AS o_orderkey, coalesce(l.copy, r.copy) AS copy,
         CASE WHEN l.o_orderkey IS NULL OR r.o_orderkey IS NULL THEN [] ELSE list_filter(["""
    + ", ".join(
        f"CASE WHEN {v.format('l')} IS DISTINCT FROM {v.format('r')} THEN {{'name': '{c}', 'source': {v.format('l')}}} END"
        for c, v in _VALUES.items()
    )
    + """], lambda x: x IS NOT NULL) END AS changes
  FROM left_rows l FULL JOIN right_rows r ON l.o_orderkey = r.o_orderkey AND l.copy = r.copy)
"""
)
_SQL["changed_rows"] = _ALIGNED + """SELECT kind, o_orderkey, copy,
    array_to_string(list_transform(changes, lambda c: c.name || ':' || c.source), ',') AS changes FROM aligned"""
_SQL["changed_row_counts"] = _ALIGNED + """SELECT kind,
    array_to_string(list_transform(changes, lambda c: c.name), ',') AS columns, count(*) AS n FROM aligned GROUP BY ALL"""
_SQL["compare_by_tree"] = _SQL["compare_missing_rows"]

_SQL["bucket_check"] = (
    _PAIR_COUNTS
    + """SELECT o_orderkey % 64 AS bucket, CAST(sum(s) AS BIGINT) AS rows_source,
    CAST(sum(d) AS BIGINT) AS rows_destination, bool_and(s = d) AS is_equal
FROM per_row GROUP BY 1"""
)
_SQL["compare_by_buckets"] = """
SELECT * FROM orders WHERE o_orderdate = (SELECT max(o_orderdate) FROM orders)"""

# Many tables.
_DELTAS = (
    _PAIR
    + f""", deltas AS (
SELECT 'orders' AS table_name,
    (SELECT count(*) FROM ({_anti("replica_src", "replica_dst")})) AS delta_count,
    (SELECT count(*) FROM replica_src) AS total_source_rows,
    (SELECT count(*) FROM replica_dst) AS total_destination_rows
UNION ALL SELECT 'lineitem', (SELECT count(*) FROM lineitem x WHERE l_orderkey % 4 = 0),
    (SELECT count(*) FROM lineitem), (SELECT count(*) FROM lineitem WHERE l_orderkey % 4 <> 0)
UNION ALL SELECT 'customer', (SELECT count(*) FROM customer WHERE c_custkey % 20 = 0),
    (SELECT count(*) FROM customer), (SELECT count(*) FROM customer WHERE c_custkey % 20 <> 0)
UNION ALL SELECT 'part', 0, (SELECT count(*) FROM part), (SELECT count(*) FROM part)
UNION ALL SELECT 'supplier', (SELECT count(*) FROM supplier), (SELECT count(*) FROM supplier), 0)
"""
)
_SQL["top_changed_tables"] = (
    _DELTAS
    + """, ranked AS (SELECT *,
    CAST(row_number() OVER (ORDER BY delta_count DESC, table_name) AS INTEGER) AS rank FROM deltas)
SELECT *, rank <= 3 AS is_top FROM ranked"""
)
_SQL["top_changed_totals"] = (
    _DELTAS
    + """SELECT count(*) AS tables, CAST(sum(delta_count) AS BIGINT) AS delta_count,
    CAST(sum(total_source_rows) AS BIGINT) AS total_source_rows,
    CAST(sum(total_destination_rows) AS BIGINT) AS total_destination_rows FROM deltas"""
)
_SQL["top_changed_with_errors"] = (
    _DELTAS
    + """, listed AS (SELECT *, false AS failed FROM deltas UNION ALL SELECT 'absent', 0, 0, 0, true),
ranked AS (SELECT *, CAST(row_number() OVER (ORDER BY delta_count DESC, table_name) AS INTEGER) AS rank
    FROM listed)
SELECT *, rank <= 3 AS is_top FROM ranked"""
)
_SQL["fleet_counts_of_tables"] = (
    _DELTAS
    + """SELECT 'srv_' || (k % 2) AS server_name, 'db_' || (k % 3) AS database_name, table_name,
    total_source_rows AS rows_source, total_destination_rows AS rows_destination, false AS failed
FROM deltas JOIN (VALUES ('orders', 0), ('lineitem', 1), ('customer', 2), ('part', 3), ('supplier', 4))
    AS n(table_name, k) USING (table_name)
UNION ALL SELECT 'srv_0', 'db_0', 'absent', 0, 0, true"""
)
_BADGE = """CASE WHEN total_source_rows = total_destination_rows THEN 'Synced'
    WHEN total_destination_rows = 0 THEN 'Not Synced' ELSE 'Partial' END AS badge"""
_FLEET = (
    as_ctes("fleet_counts", "fleet_state")
    + """, paired AS (
SELECT server_name, database_name, table_name,
    CAST(sum(CASE WHEN side = 'src' THEN n ELSE 0 END) AS BIGINT) AS s,
    CAST(sum(CASE WHEN side = 'dst' THEN n ELSE 0 END) AS BIGINT) AS d
FROM fleet_counts GROUP BY ALL)
"""
)
_SQL["table_metrics"] = (
    _FLEET
    + """SELECT p.server_name, p.database_name, p.table_name, s AS rows_source,
    d AS rows_destination, t.last_pk_value AS last_pk, t.updated_at AS last_sync_time,
    greatest(s - d, 0) AS delta_count, s - d AS row_difference,
    CASE WHEN s > d THEN '+' WHEN s < d THEN '-' ELSE '0' END AS difference_sign,
    CASE WHEN t.updated_at IS NULL THEN 'never_synced' ELSE 'synced' END AS sync_status
FROM paired p LEFT JOIN fleet_state t ON p.server_name = t.server_name
    AND p.database_name = t.database_name
    AND p.table_name = t.schema_name || '.' || t.table_name"""
)


def _fleet_totals(keys: str, databases: bool) -> str:
    extra = "count(DISTINCT database_name) AS total_databases," if databases else ""
    return (
        _FLEET
        + f""", totals AS (SELECT {keys}, {extra} count(*) AS total_tables,
    CAST(sum(s) AS BIGINT) AS total_source_rows, CAST(sum(d) AS BIGINT) AS total_destination_rows
FROM paired GROUP BY {keys})
SELECT *, total_source_rows - total_destination_rows AS row_difference, {_BADGE} FROM totals"""
    )


_SQL["database_metrics"] = _fleet_totals("server_name, database_name", False)
_SQL["server_metrics"] = _fleet_totals("server_name", True)
_SQL["sync_summary"] = (
    _FLEET
    + f""", rolled AS (SELECT server_name, database_name, table_name,
    grouping(server_name, database_name, table_name) AS g,
    count(DISTINCT p.server_name) AS total_servers,
    count(DISTINCT (p.server_name, p.database_name)) AS total_databases,
    count(*) AS total_tables, CAST(sum(s) AS BIGINT) AS total_source_rows,
    CAST(sum(d) AS BIGINT) AS total_destination_rows
FROM paired p GROUP BY GROUPING SETS ((server_name, database_name, table_name),
    (server_name, database_name), (server_name), ()))
SELECT server_name, database_name, table_name,
    CASE g WHEN 0 THEN 'table' WHEN 1 THEN 'database' WHEN 3 THEN 'server' ELSE 'fleet' END
        AS level,
    total_servers, total_databases, total_tables, total_source_rows, total_destination_rows,
    total_source_rows - total_destination_rows AS row_difference, {_BADGE}
FROM rolled"""
)
_SQL["metrics_documents"] = (
    _FLEET
    + """SELECT server_name, database_name, CAST(to_json(list(struct_pack(
    table_name := table_name, rows_source := s, rows_destination := d) ORDER BY table_name))
    AS VARCHAR) AS document FROM paired GROUP BY server_name, database_name"""
)

# Ledgers.
_STATE_TAIL = """, newest_run AS (SELECT * FROM (SELECT *, row_number() OVER (
        PARTITION BY server_name, database_name ORDER BY updated_at DESC, run_id DESC) AS place
    FROM run_ledger) WHERE place = 1),
state AS (SELECT a.server_name, a.database_name, a.last_full_sync, a.last_incremental_sync,
    n.sync_status, n.error, a.created_at, a.updated_at
FROM (SELECT server_name, database_name,
        max(CASE WHEN sync_type = 'full' AND (coalesce(sync_status, '') IN ('', 'COMPLETED')
            OR upper(sync_status) LIKE '%WARNING%' AND upper(sync_status) NOT LIKE '%FAILED%')
            THEN updated_at END) AS last_full_sync,
        max(CASE WHEN sync_type <> 'full' AND (coalesce(sync_status, '') IN ('', 'COMPLETED')
            OR upper(sync_status) LIKE '%WARNING%' AND upper(sync_status) NOT LIKE '%FAILED%')
            THEN updated_at END) AS last_incremental_sync,
        min(updated_at) AS created_at, max(updated_at) AS updated_at
    FROM run_ledger GROUP BY server_name, database_name) a
JOIN newest_run n USING (server_name, database_name))
"""
_TABLE_TAIL = """, table_now AS (SELECT server_name, database_name, schema_name, table_name,
    max(CASE WHEN place = 1 THEN last_pk_value END) AS last_pk_value,
    min(updated_at) AS created_at, max(updated_at) AS updated_at
FROM (SELECT *, row_number() OVER (
        PARTITION BY server_name, database_name, schema_name, table_name
        ORDER BY updated_at DESC, run_id DESC) AS place FROM table_ledger)
GROUP BY server_name, database_name, schema_name, table_name)
"""
_STATE = as_ctes("run_ledger") + _STATE_TAIL
_TABLES = as_ctes("table_ledger") + _TABLE_TAIL
_SQL["database_state"] = _STATE + "SELECT * FROM state"
_SQL["table_state"] = _TABLES + "SELECT * FROM table_now"


def _newest(source: str, keys: str, order: str, n: int) -> str:
    return f"""SELECT * EXCLUDE (place) FROM (SELECT *, row_number() OVER (
        PARTITION BY {keys} ORDER BY {order}) AS place FROM {source}) WHERE place <= {n}"""


_RUN_ORDER = "updated_at DESC, run_id DESC"
_DATABASE = "server_name, database_name"
_MOVED_ORDER = "updated_at DESC, schema_name DESC, table_name DESC"
_SQL["database_history"] = as_ctes("run_ledger") + _newest(
    "run_ledger", _DATABASE, _RUN_ORDER, 50
)
_SQL["table_history"] = (
    _TABLES
    + "SELECT *, schema_name || '.' || table_name AS table_fq FROM ("
    + _newest("table_now", _DATABASE, _MOVED_ORDER, 200)
    + ")"
)
_SQL["table_sync_history"] = as_ctes("table_ledger") + _newest(
    "table_ledger", _DATABASE + ", schema_name, table_name", _RUN_ORDER, 10
)
_SQL["last_syncs"] = (
    as_ctes("run_log")
    + """SELECT server_name, strftime(sync_time, '%Y-%m-%d %H:%M:%S') AS "time", status,
    coalesce(details, '-') AS details FROM run_log ORDER BY sync_time DESC, run_id DESC LIMIT 10"""
)
_SQL["last_sync"] = _SQL["last_syncs"].replace("LIMIT 10", "LIMIT 1")
_FAILED = """SELECT 'failure' AS type, server_name, database_name, last_full_sync,
    last_incremental_sync, sync_status AS status, updated_at,
    'Database sync not completed' AS message
FROM state WHERE sync_status IS NOT NULL AND sync_status <> 'COMPLETED'"""
_SQL["failed_syncs"] = _STATE + _FAILED
_SQL["failed_syncs_of_server"] = (
    _STATE + f"SELECT * FROM ({_FAILED}) WHERE server_name = 'srv_1'"
)
_SQL["history_of_server"] = (
    "SELECT * FROM (" + _SQL["database_history"] + ") WHERE server_name = 'srv_2'"
)
_SEVERITY = """CASE WHEN sync_status IS NULL OR sync_status IN ('', 'COMPLETED') THEN 'INFO'
    WHEN upper(sync_status) LIKE '%FAILED%' THEN 'CRITICAL'
    WHEN upper(sync_status) LIKE '%WARNING%' THEN 'WARNING' ELSE 'HIGH' END"""
_SQL["severity_counts"] = (
    _STATE + f"SELECT {_SEVERITY} AS severity, count(*) AS databases FROM state GROUP BY 1"
)
_SQL["resume_points"] = (
    _TABLES
    + """SELECT server_name, database_name, schema_name, table_name,
    last_pk_value AS resume_from_last_pk, 'queued' AS action,
    'Incremental sync will continue from last_pk on next run.' AS note FROM table_now"""
)
_SQL["table_sync_status"] = (
    as_ctes("table_ledger", "listing")
    + _TABLE_TAIL
    + """SELECT i.*, t.last_pk_value, t.updated_at AS last_sync_time,
    CASE WHEN t.updated_at IS NULL THEN 'never_synced' ELSE 'synced' END AS sync_status
FROM (SELECT DISTINCT * FROM listing) i
LEFT JOIN table_now t USING (server_name, database_name, schema_name, table_name)"""
)
_JOBS = """, jobs AS (SELECT * FROM (SELECT *, row_number() OVER (
        PARTITION BY server_name, job_type ORDER BY created_at DESC, run_id DESC) AS place
    FROM job_ledger) WHERE place = 1)
"""
_SQL["live_jobs"] = (
    as_ctes("job_ledger")
    + _JOBS
    + """SELECT server_name AS server, job_type AS "type",
    coalesce(strftime(last_run, '%Y-%m-%d %H:%M:%S'), '-') AS last_run, status,
    coalesce(error, '-') AS error FROM jobs WHERE status IS DISTINCT FROM 'deleted'"""
)
_SQL["run_log_details"] = (
    as_ctes("run_log")
    + "SELECT run_id, server_name, sync_time, status, coalesce(details, '-') AS details FROM run_log"
)
_SQL["report_union"] = (
    as_ctes("run_ledger", "table_ledger")
    + _TABLE_TAIL
    + """SELECT run_id, server_name, database_name, sync_type, sync_status, error, updated_at,
    NULL AS schema_name, NULL AS table_name, NULL AS last_pk_value, NULL AS created_at,
    NULL AS table_fq
FROM run_ledger
UNION ALL
SELECT NULL, server_name, database_name, NULL, NULL, NULL, updated_at, schema_name, table_name,
    last_pk_value, created_at, schema_name || '.' || table_name
FROM table_now"""
)
_SQL["report_csv_export"] = _SQL["report_union"]
_SQL["report_json_export"] = _SQL["report_union"]

# Sync.
_SQL["full_sync"] = "SELECT * FROM lineitem"
_SQL["incremental_range"] = (
    _PAIR
    + f""", older AS (SELECT * FROM replica_dst WHERE o_orderdate < {_CUT})
SELECT * FROM older UNION ALL
SELECT * FROM replica_src WHERE o_orderdate > (SELECT max(o_orderdate) FROM older)"""
)
_SQL["batched_range"] = _SQL["incremental_range"]
_SQL["left_behind"] = (
    _PAIR
    + f""", older AS (SELECT * FROM replica_dst WHERE o_orderdate < {_CUT}),
dated AS (SELECT * REPLACE (CASE WHEN o_orderkey % 40 <> 0 THEN o_orderdate END AS o_orderdate) FROM replica_src)
SELECT count(*) FILTER (WHERE o_orderdate IS NULL) AS null_rows,
    count(*) FILTER (WHERE o_orderdate <= (SELECT max(o_orderdate) FROM older)
        AND NOT EXISTS (SELECT 1 FROM older y WHERE {_MATCH})) AS late_rows FROM dated x"""
)
_SQL["incremental_digest"] = (
    _PAIR + "SELECT * FROM replica_dst UNION ALL " + _anti("replica_src", "replica_dst")
)
_SQL["sync_then_compare"] = (
    _PAIR
    + f""", target AS (SELECT * FROM replica_dst UNION ALL {_anti("replica_src", "replica_dst")}),
folded AS (SELECT {_FOLDED}, 1 AS s, 0 AS d FROM replica_src
    UNION ALL SELECT {_FOLDED}, 0 AS s, 1 AS d FROM target),
per_row AS (SELECT {_ORDER_COLUMNS}, sum(s) AS s, sum(d) AS d FROM folded GROUP BY ALL)
SELECT {_COUNTS} FROM per_row"""
)
_SQL["empty_source_guard"] = "SELECT * FROM orders"
_SQL["evolve_append"] = (
    as_ctes("evolved_src")
    + """SELECT *, CAST(NULL AS DOUBLE) AS o_discounted FROM orders
UNION ALL SELECT * FROM evolved_src"""
)
_SQL["sync_outcomes"] = f"""
WITH o1 AS (SELECT count(*) AS n, max(o_orderdate) AS top FROM orders WHERE o_orderdate < {_CUT}),
l1 AS (SELECT count(*) AS n, max(l_shipdate) AS top FROM lineitem WHERE l_shipdate < {_CUT}),
o2 AS (SELECT count(*) AS n, max(o_orderdate) AS top FROM orders
    WHERE o_orderdate > (SELECT top FROM o1)),
l2 AS (SELECT count(*) AS n, max(l_shipdate) AS top FROM lineitem
    WHERE l_shipdate > (SELECT top FROM l1))
SELECT 'sales' AS database_name, 'dbo' AS schema_name, 'orders' AS table_name, 'full' AS route,
    n AS rows_written, CAST(top AS VARCHAR) AS last_pk_value, 'timestamp_ntz' AS last_pk_type,
    'COMPLETED' AS sync_status FROM o1
UNION ALL SELECT 'sales', 'dbo', 'lineitem', 'full', n, CAST(top AS VARCHAR), 'timestamp_ntz',
    'COMPLETED' FROM l1
UNION ALL SELECT 'sales', 'dbo', 'customer', 'full', count(*), NULL, NULL, 'COMPLETED'
    FROM customer
UNION ALL SELECT 'sales', 'dbo', 'orders', 'range', n, CAST(top AS VARCHAR), 'timestamp_ntz',
    'COMPLETED' FROM o2
UNION ALL SELECT 'sales', 'dbo', 'lineitem', 'range', n, CAST(top AS VARCHAR), 'timestamp_ntz',
    'COMPLETED' FROM l2
UNION ALL SELECT 'sales', 'dbo', 'customer', 'digest', 0, NULL, NULL, 'COMPLETED'
UNION ALL SELECT 'sales', 'dbo', 'events', 'load', count(*), CAST(max(event_id) AS VARCHAR),
    'bigint', 'COMPLETED' FROM events"""
_SQL["tables_processed"] = f"""
SELECT 'sales' AS database_name,
    CAST((EXISTS (SELECT 1 FROM orders WHERE o_orderdate >= {_CUT}))::INT
       + (EXISTS (SELECT 1 FROM lineitem WHERE l_shipdate >= {_CUT}))::INT
       + (EXISTS (SELECT 1 FROM events))::INT AS BIGINT) AS processed,
    CAST(4 AS BIGINT) AS tables"""
_SQL["catalog_sync"] = f"""
SELECT table_name, 'full' AS route, rows_written, 'COMPLETED' AS sync_status,
    '{_ORDER_COLUMNS.replace(" ", "")}' AS orders_header
FROM (SELECT 'orders' AS table_name, count(*) AS rows_written FROM orders
      UNION ALL SELECT 'supplier', count(*) FROM supplier)"""
_SQL["formatted_totals"] = """
SELECT table_name, format('{:,}', n) AS "rows" FROM (SELECT 'orders' AS table_name, count(*) AS n FROM orders
    UNION ALL SELECT 'lineitem', count(*) FROM lineitem UNION ALL SELECT 'events', count(*) FROM events)"""
_SQL["added_columns_ledger"] = """
SELECT * FROM (VALUES ('orders', 'full', NULL, 'COMPLETED'), ('orders', 'range', 'o_discounted', 'COMPLETED'))
    AS t(table_name, route, added_columns, sync_status)"""
_SQL["fleet_outcomes"] = """
SELECT server, database_name, table_name, 'full' AS route, rows_written, 'COMPLETED' AS sync_status
FROM (VALUES ('one', 'sales'), ('one', 'stock'), ('two', 'sales')) AS d(server, database_name),
    (SELECT 'orders' AS table_name, count(*) AS rows_written FROM orders
     UNION ALL SELECT 'customer', count(*) FROM customer)"""
_SQL["csv_tree_load"] = "SELECT * FROM customer"
_SQL["csv_documents_load"] = "SELECT * FROM documents"
_SQL["csv_pages_load"] = "SELECT * FROM pages"
_SQL["csv_conversations_load"] = "SELECT * FROM conversations"
_SQL["header_export"] = f"""SELECT '{_ORDER_COLUMNS.replace(" ", "")}' AS header,
    count(*) AS total_rows FROM orders"""

# Alerts and sessions.
_SNAPSHOTS = """, snapshots AS (SELECT t.server_name, t.database_name, t.schema_name, t.table_name,
    coalesce(s.n, 0) AS rows_source, coalesce(d.n, 0) AS rows_destination,
    t.last_pk_value AS last_pk, t.updated_at
FROM table_now t
LEFT JOIN (SELECT server_name, database_name, schema_name, table_name, count(*) AS n
    FROM snapshot_src GROUP BY ALL) s USING (server_name, database_name, schema_name, table_name)
LEFT JOIN (SELECT server_name, database_name, schema_name, table_name, count(*) AS n
    FROM snapshot_dst GROUP BY ALL) d USING (server_name, database_name, schema_name, table_name))
"""
_ALL = (
    as_ctes(
        "run_ledger", "table_ledger", "snapshot_src", "snapshot_dst", "job_ledger", "log_lines"
    )
    + _STATE_TAIL
    + _TABLE_TAIL
    + _SNAPSHOTS
    + _JOBS
)
_SQL["table_snapshots"] = _ALL + "SELECT * FROM snapshots"
_STALE = f"""SELECT server_name, database_name,
    coalesce(last_incremental_sync, last_full_sync) AS last_sync,
    date_sub('hour', coalesce(last_incremental_sync, last_full_sync), TIMESTAMP '{AS_OF}')
        AS age_hours
FROM state WHERE coalesce(last_incremental_sync, last_full_sync)
    < TIMESTAMP '{AS_OF}' - INTERVAL 24 HOURS"""
_SQL["stale_syncs"] = _STATE + _STALE
_ALERTS = f""", stale AS ({_STALE}), alerts AS (
SELECT {_SEVERITY} AS severity, 'Database sync status not completed' AS message, server_name,
    database_name, NULL AS table_name, updated_at AS occurred_at, 'status' AS category
FROM state WHERE {_SEVERITY} <> 'INFO'
UNION ALL SELECT CASE WHEN rows_destination = 0 THEN 'HIGH' ELSE 'WARNING' END,
    CASE WHEN rows_destination = 0 THEN 'Destination empty but source has rows'
        ELSE 'Row counts differ' END,
    server_name, database_name, schema_name || '.' || table_name, NULL, 'consistency'
FROM snapshots WHERE rows_source <> rows_destination
UNION ALL SELECT 'WARNING', 'Stale sync (' || CAST(age_hours AS VARCHAR) || 'h)', server_name,
    database_name, NULL, NULL, 'stale' FROM stale
UNION ALL SELECT 'HIGH', 'Schedule failed (' || job_type || '): ' || coalesce(error, ''),
    server_name, NULL, NULL, NULL, 'schedule' FROM jobs WHERE status = 'failed'
UNION ALL SELECT 'CRITICAL', trim(line), NULL, NULL, NULL, NULL, 'log'
FROM log_lines WHERE (line LIKE '%Error processing%' OR line LIKE '%Failed to sync/load%')
    AND CAST(split_part(line, ' - ', 1) AS TIMESTAMP)
        BETWEEN TIMESTAMP '{AS_OF}' - INTERVAL 24 HOURS AND TIMESTAMP '{AS_OF}')
"""
_SQL["alerts_with_severity"] = _ALL + _ALERTS + "SELECT * FROM alerts"
_SQL["alert_counts"] = (
    _ALL
    + _ALERTS
    + """SELECT count(*) AS total, count(CASE WHEN severity = 'CRITICAL' THEN 1 END) AS critical,
    count(CASE WHEN severity = 'HIGH' THEN 1 END) AS high,
    count(CASE WHEN severity = 'WARNING' THEN 1 END) AS warning FROM alerts"""
)
_SQL["alerts_basic"] = (
    _ALL
    + """SELECT 'failures' AS kind, server_name, database_name, NULL AS table_name,
    'Database sync not completed' AS message
FROM state WHERE sync_status IS NOT NULL AND sync_status <> 'COMPLETED'
UNION ALL SELECT CASE WHEN rows_destination > 0 THEN 'warnings' ELSE 'failures' END,
    server_name, database_name, schema_name || '.' || table_name,
    CASE WHEN rows_destination > 0 THEN 'Row counts differ' ELSE 'Destination empty' END
FROM snapshots WHERE rows_source <> rows_destination"""
)
_SQL["alert_list_counts"] = (
    "SELECT kind, count(*) AS alerts FROM (" + _SQL["alerts_basic"] + ") GROUP BY kind"
)
_SQL["history_counts"] = (
    as_ctes("run_ledger", "table_ledger")
    + _STATE_TAIL
    + _TABLE_TAIL
    + """SELECT 'databases' AS list, count(*) AS n FROM state
UNION ALL SELECT 'failed', count(*) FROM state
    WHERE sync_status IS NOT NULL AND sync_status <> 'COMPLETED'
UNION ALL SELECT 'tables', count(*) FROM table_now"""
)
_STARTED = "coalesce(last_full_sync, last_incremental_sync, updated_at)"
_SESSIONS = f""", totals AS (SELECT server_name, database_name, count(*) AS total_tables,
    CAST(sum(rows_source) AS BIGINT) AS total_rows_source,
    CAST(sum(rows_destination) AS BIGINT) AS total_rows_destination
FROM snapshots GROUP BY server_name, database_name),
sessions AS (SELECT server_name || ':' || database_name || ':'
        || CAST(epoch_us(updated_at) // 1000 AS VARCHAR) AS session_id,
    server_name, database_name, {_STARTED} AS started_at, updated_at AS finished_at,
    date_sub('millisecond', {_STARTED}, updated_at) AS duration_ms,
    coalesce(total_tables, 0) AS total_tables,
    coalesce(total_rows_source, 0) AS total_rows_source,
    coalesce(total_rows_destination, 0) AS total_rows_destination,
    CASE WHEN {_SEVERITY} <> 'INFO' THEN 'Database status: ' || sync_status ELSE '' END
        AS warnings,
    CASE WHEN {_SEVERITY} = 'CRITICAL' THEN 'Status ' || sync_status ELSE '' END AS errors
FROM state LEFT JOIN totals USING (server_name, database_name))
"""
_SQL["recent_sessions"] = _ALL + _SESSIONS + "SELECT * FROM sessions"
_SQL["run_sessions"] = as_ctes("run_ledger") + """, marked AS (
  SELECT *, coalesce(sync_status = 'COMPLETED' OR sync_status LIKE 'WARNING%', true) AS done,
    CASE WHEN updated_at - lag(updated_at) OVER w <= INTERVAL 4 HOURS THEN 0 ELSE 1 END AS begins
  FROM run_ledger WINDOW w AS (PARTITION BY server_name, database_name ORDER BY updated_at, run_id)),
numbered AS (
  SELECT *, sum(begins) OVER (PARTITION BY server_name, database_name ORDER BY updated_at, run_id) AS s FROM marked),
found AS (
  SELECT server_name, database_name, min(updated_at) AS started_at, max(updated_at) AS finished_at, count(*) AS runs,
    count(*) FILTER (WHERE NOT done) AS runs_not_completed,
    list(struct_pack(d := done, s := sync_status, e := error) ORDER BY updated_at DESC, run_id DESC)[1] AS newest
  FROM numbered GROUP BY server_name, database_name, s)
SELECT server_name || ':' || database_name || ':' || CAST(epoch_us(started_at) // 1000 AS VARCHAR) AS session_id,
    server_name, database_name, started_at, finished_at, date_sub('millisecond', started_at, finished_at) AS duration_ms,
    runs, runs_not_completed, CASE WHEN NOT newest.d THEN 'unfinished' WHEN runs_not_completed > 0 THEN 'recovered'
        ELSE 'completed' END AS outcome, newest.s AS sync_status, newest.e AS error
FROM found QUALIFY row_number() OVER (PARTITION BY server_name, database_name ORDER BY finished_at DESC) <= 3"""
_SQL["long_histories"] = as_ctes("run_ledger") + """
SELECT run_id, server_name, sync_status, updated_at FROM run_ledger
QUALIFY row_number() OVER (PARTITION BY server_name ORDER BY updated_at DESC, run_id DESC) <= 5000"""
_SQL["session_report"] = (
    _ALL
    + _ALERTS
    + _SESSIONS
    + """SELECT session_id, duration_ms, total_tables, coalesce(a.n, 0) AS alerts_total,
    coalesce(a.c, 0) AS alerts_critical, coalesce(a.h, 0) AS alerts_high,
    coalesce(a.w, 0) AS alerts_warning, t.tables
FROM sessions LEFT JOIN (SELECT server_name, database_name, CAST(to_json(list(struct_pack(
        table_name := schema_name || '.' || table_name, rows_source := rows_source,
        rows_destination := rows_destination) ORDER BY table_name)) AS VARCHAR) AS tables
    FROM snapshots GROUP BY server_name, database_name) t USING (server_name, database_name)
LEFT JOIN (SELECT server_name, database_name, count(*) AS n,
        count(CASE WHEN severity = 'CRITICAL' THEN 1 END) AS c,
        count(CASE WHEN severity = 'HIGH' THEN 1 END) AS h,
        count(CASE WHEN severity = 'WARNING' THEN 1 END) AS w
    FROM alerts WHERE database_name IS NOT NULL GROUP BY server_name, database_name) a
    USING (server_name, database_name)"""
)

# Logs.
_LOG = as_ctes("log_lines")
_SQL["schema_events"] = (
    _LOG
    + """, found AS (SELECT split_part(line, ' - ', 1) AS "timestamp",
    regexp_extract(line, 'Added columns on ([^:]*):', 1) AS object,
    replace(replace(regexp_extract(line, '\\[(.*)\\]', 1), '''', ''), ' ', '') AS added_columns,
    regexp_extract(line, '\\[.*\\]') AS shown
FROM log_lines WHERE line LIKE '%Added columns on %')
SELECT "timestamp", object, added_columns,
    'Columns added to ' || object || ': ' || shown AS message FROM found"""
)
_SQL["schema_events_of_table"] = (
    "SELECT * FROM (" + _SQL["schema_events"] + ") WHERE object LIKE '%t3%'"
)
_SQL["primary_key_columns"] = """
SELECT * FROM (VALUES ('orders', 'o_orderkey', CAST(1 AS INTEGER)), ('lineitem', 'l_orderkey', 1),
    ('lineitem', 'l_partkey', 3), ('lineitem', 'l_suppkey', 2)) AS k(table_name, column_name, pk_position)"""
_CATEGORY = """CASE WHEN lower({0}) LIKE '%timeout%' OR lower({0}) LIKE '%timed out%'
        THEN 'connection_timeout'
    WHEN lower({0}) LIKE '%could not connect%' OR lower({0}) LIKE '%connection refused%'
        THEN 'connection'
    WHEN lower({0}) LIKE '%schema%' OR lower({0}) LIKE '%column%' OR lower({0}) LIKE '%type%'
        THEN 'schema_mismatch'
    WHEN lower({0}) LIKE '%duplicate key%' OR lower({0}) LIKE '%conflict%' THEN 'data_conflict'
    ELSE 'unknown' END"""
_SQL["sync_errors"] = (
    _LOG
    + f"""SELECT split_part(line, ' - ', 1) AS "timestamp", trim(line) AS message,
    {_CATEGORY.format("line")} AS category
FROM log_lines WHERE line LIKE '%Error processing%' OR line LIKE '%Failed to sync/load%'"""
)
_SQL["error_categories"] = (
    as_ctes("run_ledger")
    + f"""SELECT {_CATEGORY.format("error")} AS category, count(*) AS errors
FROM run_ledger WHERE error IS NOT NULL GROUP BY 1"""
)
_SQL["log_tail"] = (
    _LOG
    + """SELECT line FROM log_lines
ORDER BY CAST(split_part(line, ' - ', 1) AS TIMESTAMP) DESC, line DESC LIMIT 200"""
)

# Schemas. Types come from the engine's own typeof, mapped to the names we use.
_TYPE_NAMES = """CASE typeof({0}) WHEN 'BIGINT' THEN 'bigint' WHEN 'DOUBLE' THEN 'double'
    WHEN 'VARCHAR' THEN 'string' WHEN 'TIMESTAMP' THEN 'timestamp_ntz'
    WHEN 'INTEGER' THEN 'int' ELSE typeof({0}) END"""


def _drift(
    table: str, name: str, column: str, in_destination: bool, as_text: bool = False
) -> str:
    kind = f"max({_TYPE_NAMES.format(column)})"
    other = "'string'" if as_text else (kind if in_destination else "NULL")
    return f"""SELECT '{name}' AS table_name, '{column}' AS column_name, {kind} AS source_type,
    {other} AS destination_type, {str(not in_destination).lower()} AS missing_in_destination,
    {str(as_text).lower()} AS type_differs, count({column}) AS source_values FROM {table}"""


_SQL["schema_drift"] = as_ctes("evolved_src") + "\nUNION ALL ".join(
    [
        _drift("orders", "orders", c, c != "o_orderpriority", c == "o_custkey")
        for c in _ORDER_COLUMNS.split(", ")
    ]
    + [
        _drift("evolved_src", "evolved", c, c != "o_discounted")
        for c in [*_ORDER_COLUMNS.split(", "), "o_discounted"]
    ]
)


def _profile(table: str, column: str, kind: str) -> str:
    if kind == "text":
        return f"""SELECT '{table}' AS table_name, '{column}' AS column_name,
    CASE WHEN bool_and(length({column}) = 36
            AND length({column}) - length(replace({column}, '-', '')) = 4) THEN 'UUID'
        WHEN coalesce(max(length({column})), 0) <= 255 THEN 'VARCHAR(255)' ELSE 'TEXT' END
        AS suggested_type,
    count({column}) AS filled_rows, count(*) - count({column}) AS null_rows,
    CAST(max(length({column})) AS BIGINT) AS max_length,
    coalesce(bool_and(length({column}) = 36
        AND length({column}) - length(replace({column}, '-', '')) = 4), false) AS looks_like_uuid,
    coalesce(bool_and(regexp_full_match({column}, '-?[0-9]+')), false) AS all_integers
FROM {table}"""
    whole = f"count({column}) > 0" if kind == "BIGINT" else "false"
    return f"""SELECT '{table}', '{column}', '{kind}', count({column}),
    count(*) - count({column}), CAST(NULL AS BIGINT), false, {whole} FROM {table}"""


_PROFILED = (
    ("documents", "text", "text"),
    ("documents", "lang", "text"),
    ("documents", "source", "text"),
    ("documents", "doc_id", "BIGINT"),
    ("documents", "n_chars", "BIGINT"),
    ("orders", "o_orderkey", "BIGINT"),
    ("orders", "o_custkey", "BIGINT"),
    ("orders", "o_orderstatus", "text"),
    ("orders", "o_totalprice", "DOUBLE PRECISION"),
    ("orders", "o_orderdate", "TIMESTAMP"),
    ("orders", "o_orderpriority", "text"),
    ("events", "event_id", "BIGINT"),
    ("events", "ts", "TIMESTAMP"),
    ("events", "user_id", "BIGINT"),
    ("events", "event_type", "text"),
    ("events", "value", "DOUBLE PRECISION"),
    ("events", "props", "text"),
    ("pages", "page_id", "BIGINT"),
    ("pages", "url", "text"),
    ("pages", "html", "text"),
)
_SQL["type_profile"] = "\nUNION ALL ".join(_profile(*p) for p in _PROFILED)
_SQL["sync_columns"] = "\nUNION ALL ".join(
    f"""SELECT '{table}' AS table_name, '{column}' AS sync_column, '{rule}' AS rule,
    count(*) AS total_rows, count(*) - count({column}) AS null_rows,
    count(DISTINCT {column}) AS distinct_values,
    count(CASE WHEN {column} = (SELECT max({column}) FROM {table}) THEN 1 END) AS ties_at_max,
    count(DISTINCT {column}) = count(*) AS is_unique FROM {table}"""
    for table, column, rule in (
        ("orders", "o_orderkey", "key"),
        ("lineitem", "l_orderkey", "key"),
        ("events", "ts", "time"),
        ("labels", "doc_id", "id"),
        ("benchmark", "item_id", "id"),
    )
)
_SQL["sync_columns_sketched"] = "\nUNION ALL ".join(
    f"""SELECT '{table}' AS table_name, '{column}' AS column_name,
    count(*) AS total_rows, count(*) - count({column}) AS null_rows,
    count(CASE WHEN {column} = (SELECT max({column}) FROM {table}) THEN 1 END) AS ties_at_max,
    count(DISTINCT {column}) = count(*) AS may_be_unique FROM {table}"""
    for table, columns in (
        ("orders", ("o_orderkey", "o_custkey", "o_orderdate")),
        ("lineitem", ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate")),
        ("events", ("event_id", "ts", "user_id")),
        ("labels", ("doc_id", "toxic", "quality")),
        ("benchmark", ("item_id",)),
    )
    for column in columns
)

# Scans.
_SQL["subset_scan"] = f"SELECT o_orderkey, o_totalprice FROM orders WHERE {_FILTER}"
_SQL["range_scan"] = f"SELECT * FROM orders WHERE o_orderdate > {_CUT}"
_SQL["sample_scan"] = "SELECT * FROM events ORDER BY ts, event_id LIMIT 50"
_SQL["row_counts"] = "\nUNION ALL ".join(
    f"SELECT '{t}' AS table_name, count(*) AS n FROM {t}"
    for t in ("customer", "supplier", "part", "orders", "lineitem", "events", "documents")
)
_SQL["new_rows_probe"] = """
SELECT 'orders' AS table_name, false AS has_new_rows
UNION ALL SELECT 'lineitem',
    (SELECT max(l_shipdate) FROM lineitem) > (SELECT max(o_orderdate) FROM orders)
UNION ALL SELECT 'unknown', true"""
_SQL["user_tables"] = (
    as_ctes("listing")
    + """SELECT server_name, database_name, schema_name, table_name, count(*) AS seen
FROM listing WHERE lower(schema_name) <> 'sys' AND database_name NOT IN ('master', 'tempdb')
    AND NOT (server_name = 'srv_1' AND database_name = 'db_1')
    AND NOT (server_name = 'srv_2' AND database_name = 'db_12') GROUP BY ALL"""
)
_SQL["requested_databases"] = (
    as_ctes("listing", "run_ledger")
    + """SELECT DISTINCT l.server_name, l.database_name FROM listing l
JOIN run_ledger r USING (server_name, database_name)"""
)
_SQL["clean_names"] = """
SELECT c_custkey, replace(c_name, '#', '') AS cleaned,
    replace(replace(replace(c_name, '#', '') || '_' || c_mktsegment, '-', '_'), ' ', '_')
        AS namespace,
    lower(c_mktsegment) AS schema_name, c_name || '.x y' AS table_name,
    'dbo' AS default_schema, c_name AS plain_table
FROM customer"""

# Streams.
_SQL["stream_append"] = f"""
SELECT * FROM events WHERE ts < TIMESTAMP '{DROP_END}'
UNION ALL SELECT * FROM events WHERE ts >= TIMESTAMP '{DROP_START}'"""
_SQL["stream_incremental"] = "SELECT * FROM events"
_SQL["stream_by_filters"] = _SQL["stream_incremental"]
_SQL["stream_second_checkpoint"] = _SQL["stream_incremental"]
_SQL["stream_live_status"] = (
    _STATE
    + """SELECT s.server_name, s.database_name, s.sync_status, s.updated_at, n.runs
FROM state s JOIN (SELECT server_name, database_name, count(*) AS runs FROM run_ledger
    GROUP BY ALL) n USING (server_name, database_name)"""
)


# What a snapshot and the rows after it give is what all rows give.
for _name in ("table_state", "database_state"):
    _SQL[f"compacted_{_name}"] = _SQL[_name]
_SQL["compacted_job_state"] = _SQL["live_jobs"]


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
