"""User-level operators: compare, sync, ledger views, metrics, alerts, schema, logs."""
