"""Table scans and catalog listings."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinkeep.functions.fixed import (
    SAMPLE_ROWS,
    SYSTEM_DATABASES,
    SYSTEM_SCHEMA,
    SYSTEM_TABLES,
)
from twinkeep.functions.names import identifier, qualified


def jdbc_table(
    spark: SparkSession,
    url: str,
    table: str,
    *,
    partition_column: str | None = None,
    bounds: tuple[str, str] | None = None,
    partitions: int | None = None,
    fetch_rows: int = 10_000,
    **options: str,
) -> DataFrame:
    """A JDBC table. Give a column, its bounds and a partition count for any
    table that does not fit one task: without them JDBC reads in one task."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table)
    for key, value in jdbc_options(partition_column, bounds, partitions, fetch_rows).items():
        reader = reader.option(key, value)
    return reader.options(**options).load()


def jdbc_options(
    partition_column: str | None,
    bounds: tuple[str, str] | None,
    partitions: int | None,
    fetch_rows: int,
) -> dict[str, str]:
    split = (partition_column, bounds, partitions)
    if any(part is not None for part in split) and None in split:
        raise ValueError("a partitioned read needs the column, its bounds and the count")
    options = {"fetchsize": str(fetch_rows)}
    if partition_column is not None and bounds is not None:
        options |= {
            "partitionColumn": partition_column,
            "lowerBound": str(bounds[0]),
            "upperBound": str(bounds[1]),
            "numPartitions": str(partitions),
        }
    return options


def table_or_empty(spark: SparkSession, name: str, like: T.StructType) -> DataFrame:
    """A catalog table, or no rows of the given schema where it does not exist.
    A table that exists but cannot be read raises."""
    if spark.catalog.tableExists(name):
        return spark.table(name)
    return spark.createDataFrame([], like)


def subset(
    df: DataFrame, columns: Sequence[str] | None = None, filter_sql: str | None = None
) -> DataFrame:
    """Chosen columns of the rows a SQL predicate keeps. The predicate may use
    columns that are not kept."""
    rows = df.where(F.expr(filter_sql)) if filter_sql else df
    return rows.select(*columns) if columns else rows


def after_watermark(df: DataFrame, column: str, last_value: object) -> DataFrame:
    """Rows strictly beyond the watermark; the literal takes the column's type,
    so the filter reaches the scan."""
    kind = df.schema[column].dataType
    return df.where(F.col(column) > F.lit(last_value).cast(kind))


def has_rows_after(df: DataFrame, column: str, last_value: object | None) -> bool:
    if last_value is None:
        return True
    return not after_watermark(df, column, last_value).limit(1).isEmpty()


def new_rows_probe(probes: Mapping[str, tuple[DataFrame, str, Column | None]]) -> DataFrame:
    """Per table whether it has rows after a value, as one lazy frame; without a value
    it has. Each probe stops at its first row."""
    parts = []
    for name, (df, column, last) in probes.items():
        if last is None:
            probe = df.sparkSession.range(1).select(F.lit(True).alias("has_new_rows"))
        else:
            first = df.where(F.col(identifier(column)) > last).limit(1)
            probe = first.agg((F.count("*") > 0).alias("has_new_rows"))
        parts.append(probe.select(F.lit(name).alias("table_name"), "has_new_rows"))
    return reduce(DataFrame.unionByName, parts)


def sample_rows(df: DataFrame, order_by: Sequence[str], n: int = SAMPLE_ROWS) -> DataFrame:
    """The first rows in a stated order, so two runs give the same sample."""
    return df.orderBy(*order_by).limit(n)


def row_counts(tables: Mapping[str, DataFrame], label: str = "table_name") -> DataFrame:
    """One row per table: its name and its row count."""
    counts = [
        df.agg(F.count("*").alias("n")).select(F.lit(name).alias(label), "n")
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, counts)


def catalog_listing(spark: SparkSession, namespaces: Sequence[str]) -> DataFrame:
    """(schema_name, table_name) of the catalog tables in the namespaces."""
    rows = [
        (namespace, table.name)
        for namespace in namespaces
        for table in spark.catalog.listTables(namespace)
        if not table.isTemporary
    ]
    return spark.createDataFrame(rows, "schema_name string, table_name string")


def is_user_table(schema: Column, table: Column) -> Column:
    return (F.lower(schema) != SYSTEM_SCHEMA) & ~qualified(schema, table).isin(*SYSTEM_TABLES)


def user_tables(listing: DataFrame) -> DataFrame:
    """Drop system tables from a listing with ``schema_name`` and ``table_name``."""
    return listing.where(is_user_table(F.col("schema_name"), F.col("table_name")))


def user_databases(listing: DataFrame, skip: DataFrame | None = None) -> DataFrame:
    """Drop system databases, and per-server skips given as
    (``server_name``, ``database_name``)."""
    kept = listing.where(~F.col("database_name").isin(*SYSTEM_DATABASES))
    if skip is None:
        return kept
    return kept.join(skip.distinct(), ["server_name", "database_name"], "left_anti")


def requested_databases(listing: DataFrame, requested: DataFrame) -> DataFrame:
    """Databases that were asked for and exist."""
    return listing.join(requested.distinct(), ["server_name", "database_name"], "left_semi")


def column_metadata(spark: SparkSession, tables: Mapping[str, DataFrame]) -> DataFrame:
    """(table_name, column_name, ordinal, data_type) of tables, from their schemas."""
    rows = [
        (name, field.name, place, field.dataType.simpleString())
        for name, df in tables.items()
        for place, field in enumerate(df.schema, start=1)
    ]
    return spark.createDataFrame(
        rows, "table_name string, column_name string, ordinal int, data_type string"
    )
