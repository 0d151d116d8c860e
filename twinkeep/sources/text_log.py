"""Scan of text logs with lines ``<time> - <level> - <message>``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from twinkeep.functions.fixed import LOG_TAIL_LINES

_SEPARATOR = " - "


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """The lines of one log file or of a folder of them."""
    return spark.read.text(path).withColumnRenamed("value", "line")


def logged_at_text(line: Column) -> Column:
    """What stands before the first separator; empty where there is none."""
    return F.when(line.contains(_SEPARATOR), F.substring_index(line, _SEPARATOR, 1)).otherwise("")


def logged_at(line: Column) -> Column:
    """The time of a line, NULL where it has none. A comma may precede the
    fraction of the second."""
    text = F.translate(logged_at_text(line), ",", ".")
    return text.try_cast("timestamp_ntz")


def log_tail(lines: DataFrame, n: int = LOG_TAIL_LINES) -> DataFrame:
    """The newest lines. A distributed text scan has no line numbers, so newest
    means by time, then by text; lines without a time come last."""
    timed = lines.withColumn("_at", logged_at(F.col("line")))
    newest = timed.orderBy(F.col("_at").desc_nulls_last(), F.col("line").desc()).limit(n)
    return newest.drop("_at")
