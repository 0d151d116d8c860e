"""Fixed values that results depend on."""

# Schema used when a table name has none, and the system schema.
DEFAULT_SCHEMA = "dbo"
SYSTEM_SCHEMA = "sys"

# System databases that are never replicated.
SYSTEM_DATABASES = (
    "master",
    "tempdb",
    "model",
    "msdb",
    "distribution",
    "ReportServer",
    "ReportServerTempDB",
)

# System tables that can leak into a target namespace.
SYSTEM_TABLES = ("sys.trace_xe_event_map", "sys.trace_xe_action_map")

# Source data types that can serve as a sync column.
TIME_TYPES = ("datetime", "datetime2", "smalldatetime", "timestamp")
ID_TYPES = ("uniqueidentifier", "int", "bigint")

# Default sizes of top-k reports.
DATABASE_HISTORY_ROWS = 50
TABLE_HISTORY_ROWS = 200
ONE_TABLE_HISTORY_ROWS = 10
RECENT_SYNCS = 10
RECENT_SESSIONS = 10
DEBUG_ROWS = 100
SAMPLE_ROWS = 50
HEAD_ROWS = 10
LOG_TAIL_LINES = 200

# Fixed value: hours after which a sync counts as stale.
STALE_HOURS = 24

# Log phrases.
ADDED_COLUMNS = "Added columns on "
ERROR_PHRASES = ("Error processing", "Failed to sync/load")
