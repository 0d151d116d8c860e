"""Sinks: append with added columns, replace, header files, report files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinkeep.functions.names import clean_text, identifier


def ensure_namespace(spark: SparkSession, namespace: str, root: str | None = None) -> None:
    location = f" LOCATION '{root.rstrip('/')}/{namespace}'" if root else ""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{namespace}`{location}")


def with_clean_columns(df: DataFrame) -> DataFrame:
    """One rename map for creating, widening and inserting."""
    names = [clean_text(c) for c in df.columns]
    if "" in names or len(set(names)) != len(names):
        raise ValueError(f"column names are not distinct after cleaning: {df.columns}")
    return df.toDF(*names)


def _columns_by_name(names: list[str], case_sensitive: bool) -> dict[str, str]:
    return {name if case_sensitive else name.lower(): name for name in names}


def append_evolving(spark: SparkSession, df: DataFrame, table: str) -> list[str]:
    """Append to a catalog table; the first append defines its columns, later
    ones may only add some. Returns the added columns.

    The widened schema lives in the catalog, so readers need no footer merge:
    files written before a column existed give NULL for it.
    """
    rows = with_clean_columns(df)
    if not spark.catalog.tableExists(table):
        rows.write.format("parquet").saveAsTable(table)
        return []
    exact = spark.conf.get("spark.sql.caseSensitive") == "true"
    given = _columns_by_name(rows.columns, exact)
    present = _columns_by_name(spark.table(table).columns, exact)
    added = [rows.schema[given[key]] for key in given if key not in present]
    if added:
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in added)
        spark.sql(f"ALTER TABLE {table} ADD COLUMNS ({columns})")
        present = _columns_by_name(spark.table(table).columns, exact)
    aligned = [
        F.col(identifier(given[key])) if key in given else F.lit(None).alias(name)
        for key, name in present.items()
    ]
    rows.select(*aligned).write.insertInto(table)
    return [f.name for f in added]


def replace_table(df: DataFrame, table: str) -> None:
    with_clean_columns(df).write.mode("overwrite").format("parquet").saveAsTable(table)


def write_header(df: DataFrame, path: str) -> None:
    """A header-only CSV as evidence of which columns were loaded."""
    df.limit(0).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


# The writers' own default keeps milliseconds only.
TIME_FORMATS = {
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
}


#: How CSV files are written and read: quotes are doubled, blanks stay. NULL is nothing
#: between the commas, the empty text a pair of quotes.
CSV_FORMAT = {
    "escape": '"',
    "quote": '"',
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
    "nullValue": "",
    "emptyValue": '""',
}


def export_report(rows: DataFrame, path: str, fmt: str = "csv") -> None:
    """Write report rows as CSV with a header or as JSON lines, times in full.

    A NULL and an empty text stay apart, but for a table of one text column: a line
    with nothing on it is no row to any reader of CSV."""
    writer = rows.write.mode("overwrite").options(**TIME_FORMATS)
    if fmt == "csv":
        writer.options(**CSV_FORMAT).option("header", True).csv(path)
    elif fmt == "json":
        writer.option("ignoreNullFields", False).json(path)
    else:
        raise ValueError(f"unknown report format: {fmt}")


def as_document(rows: DataFrame) -> DataFrame:
    """Each row as one JSON text."""
    everything = F.struct(*[F.col(identifier(c)) for c in rows.columns])
    return rows.select(F.to_json(everything, {"ignoreNullFields": "false"}).alias("document"))
