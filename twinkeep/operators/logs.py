"""Events and errors extracted from text logs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinkeep.functions.fixed import ADDED_COLUMNS, ERROR_PHRASES
from twinkeep.functions.status import error_category
from twinkeep.sources.text_log import logged_at_text


def is_error_line(line: Column) -> Column:
    return reduce(Column.__or__, [line.contains(p) for p in ERROR_PHRASES])


def _after(text: Column, mark: str) -> Column:
    """What follows the first occurrence of a mark."""
    return F.substring(text, F.instr(text, mark) + len(mark), F.length(text))


def _listed(text: Column) -> Column:
    """A printed list of names as an array: as JSON after turning the quotes, or
    else cut at commas."""
    parsed = F.from_json(F.translate(text, "'", '"'), "array<string>")
    pieces = F.split(F.regexp_replace(text, r"^[\[\]\s]+|[\[\]\s]+$", ""), ",")
    return F.coalesce(parsed, F.filter(F.transform(pieces, lambda c: F.trim(c)), lambda c: c != ""))


def schema_change_events(
    lines: DataFrame, server: str | None = None, database: str | None = None
) -> DataFrame:
    """Columns that loads added, one row per log line. ``server`` and ``database``
    keep lines that mention them."""
    line = F.col("line")
    found = lines.where(line.contains(ADDED_COLUMNS))
    for wanted in (server, database):
        if wanted is not None:
            found = found.where(line.contains(wanted))
    tail = _after(F.trim(line), ADDED_COLUMNS)
    target = F.trim(F.substring_index(tail, ":", 1))
    columns = F.when(tail.contains(":"), _listed(F.trim(_after(tail, ":")))).otherwise(
        F.array().cast("array<string>")
    )
    shown = F.when(F.size(columns) == 0, "[]").otherwise(
        F.concat(F.lit("['"), F.concat_ws("', '", columns), F.lit("']"))
    )
    return found.select(
        logged_at_text(line).alias("timestamp"),
        target.alias("object"),
        columns.alias("added_columns"),
        F.concat(F.lit("Columns added to "), target, F.lit(": "), shown).alias("message"),
    )


def sync_errors(lines: DataFrame) -> DataFrame:
    """Error lines of a log with their category."""
    line = F.col("line")
    return lines.where(is_error_line(line)).select(
        logged_at_text(line).alias("timestamp"),
        F.trim(line).alias("message"),
        error_category(line).alias("category"),
    )


def error_categories(errors: DataFrame, message: str = "error") -> DataFrame:
    """How many errors fall into each category."""
    return (
        errors.where(F.col(message).isNotNull())
        .groupBy(error_category(F.col(message)).alias("category"))
        .agg(F.count("*").alias("errors"))
    )
