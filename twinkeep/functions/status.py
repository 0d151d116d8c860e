"""Statuses, severities and derived measures as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def severity(status: Column) -> Column:
    text = F.upper(status)
    return (
        F.when(status.isNull() | (status == "") | (text == "COMPLETED"), "INFO")
        .when(text.contains("FAILED"), "CRITICAL")
        .when(text.contains("WARNING"), "WARNING")
        .otherwise("HIGH")
    )


# Error category and the phrases that select it, first match wins.
ERROR_CATEGORIES = (
    ("connection_timeout", ("timeout", "timed out")),
    ("connection", ("could not connect", "connection refused", "login timeout")),
    ("schema_mismatch", ("schema", "column", "type")),
    ("data_conflict", ("duplicate key", "conflict")),
)


def error_category(message: Column) -> Column:
    text = F.lower(message)
    chain = F
    for category, phrases in ERROR_CATEGORIES:
        hit = F.lit(False)
        for phrase in phrases:
            hit = hit | text.contains(phrase)
        chain = chain.when(hit, F.lit(category))
    return chain.otherwise(F.lit("unknown"))


def delta_count(source: Column, destination: Column) -> Column:
    return F.greatest(F.lit(0).cast("bigint"), source - destination)


def count_status(source: Column, destination: Column) -> Column:
    return (
        F.when(source == destination, "ok").when(destination > 0, "warning").otherwise("error")
    )


def sync_badge(source: Column, destination: Column) -> Column:
    return (
        F.when(source == destination, "Synced")
        .when(destination == 0, "Not Synced")
        .otherwise("Partial")
    )


def difference_sign(source: Column, destination: Column) -> Column:
    return F.when(source > destination, "+").when(source < destination, "-").otherwise("0")


def ever_synced(last_sync: Column) -> Column:
    return F.when(last_sync.isNotNull(), "synced").otherwise("never_synced")


def _whole(unit: str, span: Column) -> Column:
    return F.extract(F.lit(unit), span).cast("bigint")


def hours_between(later: Column, earlier: Column) -> Column:
    """Whole hours between times without zone, cut towards zero."""
    span = later - earlier
    return _whole("DAY", span) * 24 + _whole("HOUR", span)


def millis_between(later: Column, earlier: Column) -> Column:
    """Whole milliseconds between times without zone, cut towards zero."""
    span = later - earlier
    minutes = hours_between(later, earlier) * 60 + _whole("MINUTE", span)
    return minutes * 60_000 + (F.extract(F.lit("SECOND"), span) * 1000).cast("bigint")


def epoch_millis(at: Column) -> Column:
    return millis_between(at, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))


def printable(at: Column) -> Column:
    """A time without zone to the second, as text."""
    return F.substring(at.cast("string"), 1, 19)


def is_completed(status: Column) -> Column:
    """Whether a run came to its end, with or without warnings; one without a status did."""
    return severity(status).isin("INFO", "WARNING")


def thousands(number: Column) -> Column:
    """A whole number with a comma between groups of three digits."""
    return F.format_number(number, 0)
