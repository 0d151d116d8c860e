"""Load a tree of CSV exports: one folder per namespace, one file per table."""

from __future__ import annotations

from collections import Counter
from collections.abc import Mapping
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinkeep.functions.names import clean_name, identifier
from twinkeep.sources.sinks import CSV_FORMAT, ensure_namespace, replace_table


#: What the parser puts where there is nothing between two commas; no text is equal to it.
_NOTHING = "\0nothing\0"


def list_exports(spark: SparkSession, root: str) -> DataFrame:
    """(namespace, table_name, path) of every ``<folder>/<table>.csv``, which may
    be a file or a folder of part files. Only the listing is read."""
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.csv")
        .load(root)
        .select(F.regexp_extract("path", r"^(.*?/[^/]+/[^/]+\.csv)(/[^/]*)?$", 1).alias("path"))
    )
    parts = F.split("path", "/")
    return files.select(
        F.translate(F.element_at(parts, -2), "- ", "__").alias("namespace"),
        F.translate(
            clean_name(F.regexp_replace(F.element_at(parts, -1), r"\.csv$", "")), "-", "_"
        ).alias("table_name"),
        "path",
    ).distinct()


def read_export(
    spark: SparkSession,
    path: str,
    schema: str | T.StructType | None = None,
    line_breaks: bool = True,
) -> DataFrame:
    """One exported table. Types are inferred from the whole file unless a
    schema is given, which also saves a pass over large exports.

    Quoted values may hold line breaks, so a file is read by one task. Files known to
    have none can be split with ``line_breaks=False``. A file that does not fit
    its schema or its header raises when it is read.
    """
    reader = (
        spark.read.options(**CSV_FORMAT)
        .option("emptyValue", "")
        .option("nullValue", _NOTHING)
        .option("header", True)
        .option("multiLine", line_breaks)
        .option("mode", "FAILFAST")
    )
    return reader.schema(schema).csv(path) if schema else reader.csv(path, inferSchema=True)


def load_csv_tree(
    spark: SparkSession,
    root: str,
    target_root: str | None = None,
    schemas: Mapping[str, str] | None = None,
    line_breaks: bool = True,
    at_once: int = 4,
) -> DataFrame:
    """Replace one catalog table per export, ``at_once`` at a time. Gives an outcome row
    per table: namespace, table_name, status, error. A table that fails does not stop
    the others; two exports of one target both fail. Table names are collected, never rows."""
    items = list_exports(spark, root).orderBy("namespace", "table_name", "path").collect()
    targets = Counter((i.namespace.lower(), i.table_name.lower()) for i in items)
    for namespace in sorted({i.namespace for i in items}):
        ensure_namespace(spark, namespace, target_root)

    @inheritable_thread_target(spark)
    def load(item: Row) -> tuple[str, str, str, str | None]:
        error = None
        try:
            if targets[(item.namespace.lower(), item.table_name.lower())] > 1:
                raise ValueError(f"several exports have this target, one is {item.path}")
            schema = (schemas or {}).get(item.table_name)
            replace_table(
                read_export(spark, item.path, schema, line_breaks),
                identifier(item.namespace, item.table_name),
            )
        except Exception as problem:  # the outcome row carries it
            error = str(problem)
        return item.namespace, item.table_name, "failed" if error else "success", error

    with ThreadPoolExecutor(max_workers=at_once) as pool:
        outcomes = list(pool.map(load, items))
    return spark.createDataFrame(
        outcomes, "namespace string, table_name string, status string, error string"
    )
