"""Scans and sinks: tables, catalog listings, CSV trees, text logs, ledgers."""
