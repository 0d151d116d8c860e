"""Row-count metrics of tables, rolled up to databases, servers and the fleet."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from twinkeep.functions.names import qualified
from twinkeep.functions.status import delta_count, difference_sign, ever_synced, sync_badge
from twinkeep.operators.changes import TablePair, opened

FLEET_KEY = ["server_name", "database_name", "table_name"]


def _total(column: Column) -> Column:
    return F.coalesce(F.sum(column), F.lit(0)).cast("bigint")


def counts_of_tables(pairs: Mapping[tuple[str, str, str], TablePair]) -> DataFrame:
    """Long-form counts of table pairs by (server, database, table): a row per side with
    ``n`` rows, or with its ``error`` where the pair can't be opened. One job counts all."""
    keys = {f"{k}": key for k, key in enumerate(pairs)}
    good, errors = opened({k: pairs[key] for k, key in keys.items()})
    parts = [
        df.agg(F.count("*").alias("n")).select(
            *[F.lit(v).alias(c) for c, v in zip(FLEET_KEY, keys[k])],
            F.lit(side).alias("side"), "n", F.lit(None).cast("string").alias("error"),
        )
        for k, pair in good.items()
        for side, df in zip(("src", "dst"), pair)
    ]
    if errors:
        spark = SparkSession.active()
        rows = [(*keys[k], side, 0, e) for k, e in errors.items() for side in ("src", "dst")]
        schema = ", ".join(f"{c} string" for c in FLEET_KEY)
        parts.append(spark.createDataFrame(rows, f"{schema}, side string, n bigint, error string"))
    return reduce(DataFrame.unionByName, parts)


def paired_counts(counts: DataFrame) -> DataFrame:
    """Long-form counts (``side`` is src or dst, ``n`` rows) as one row per table."""
    side, n = F.col("side"), F.col("n")
    return counts.groupBy(*FLEET_KEY).agg(
        _total(F.when(side == "src", n)).alias("rows_source"),
        _total(F.when(side == "dst", n)).alias("rows_destination"),
    )


def table_metrics(counts: DataFrame, state: DataFrame) -> DataFrame:
    """Per table: counts, difference, watermark and status. ``state`` is the
    table state; its size follows the number of tables."""
    watermarks = state.select(
        "server_name",
        "database_name",
        qualified(F.col("schema_name"), F.col("table_name")).alias("table_name"),
        F.col("last_pk_value").alias("last_pk"),
        F.col("updated_at").alias("last_sync_time"),
    )
    src, dst = F.col("rows_source"), F.col("rows_destination")
    return paired_counts(counts).join(watermarks, FLEET_KEY, "left").select(
        *FLEET_KEY,
        "rows_source",
        "rows_destination",
        "last_pk",
        "last_sync_time",
        delta_count(src, dst).alias("delta_count"),
        (src - dst).alias("row_difference"),
        difference_sign(src, dst).alias("difference_sign"),
        ever_synced(F.col("last_sync_time")).alias("sync_status"),
    )


def _rolled(level: Column) -> list[Column]:
    src, dst = F.col("rows_source"), F.col("rows_destination")
    return [
        level.alias("level"),
        F.col("total_servers"),
        F.col("total_databases"),
        F.col("total_tables"),
        src.alias("total_source_rows"),
        dst.alias("total_destination_rows"),
        (src - dst).alias("row_difference"),
        sync_badge(src, dst).alias("badge"),
    ]


def sync_summary(counts: DataFrame) -> DataFrame:
    """All levels in one pass. The long-form counts are first reduced to one row
    per table, so the rollup multiplies tables, not data rows."""
    rolled = (
        paired_counts(counts)
        .rollup(*FLEET_KEY)
        .agg(
            F.grouping_id().alias("_gid"),
            F.count_distinct("server_name").alias("total_servers"),
            F.count_distinct("server_name", "database_name").alias("total_databases"),
            F.count("*").alias("total_tables"),
            F.sum("rows_source").alias("rows_source"),
            F.sum("rows_destination").alias("rows_destination"),
        )
    )
    level = (
        F.when(F.col("_gid") == 0, "table")
        .when(F.col("_gid") == 1, "database")
        .when(F.col("_gid") == 3, "server")
        .otherwise("fleet")
    )
    return rolled.select(*FLEET_KEY, *_rolled(level))


def _totals(counts: DataFrame, keys: list[str]) -> DataFrame:
    src, dst = F.col("total_source_rows"), F.col("total_destination_rows")
    return (
        paired_counts(counts)
        .groupBy(*keys)
        .agg(
            F.count_distinct("database_name").alias("total_databases"),
            F.count("*").alias("total_tables"),
            F.sum("rows_source").alias("total_source_rows"),
            F.sum("rows_destination").alias("total_destination_rows"),
        )
        .withColumn("row_difference", src - dst)
        .withColumn("badge", sync_badge(src, dst))
    )


def database_metrics(counts: DataFrame) -> DataFrame:
    return _totals(counts, ["server_name", "database_name"]).drop("total_databases")


def server_metrics(counts: DataFrame) -> DataFrame:
    return _totals(counts, ["server_name"])


def table_snapshots(state: DataFrame, source: DataFrame, destination: DataFrame) -> DataFrame:
    """Per ledger table, its rows on both sides. ``source`` and ``destination``
    hold one row per data row, or per count, with the four key columns and ``n``."""
    key = ["server_name", "database_name", "schema_name", "table_name"]

    def counted(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(*key).agg(F.sum("n").cast("bigint").alias(name))

    return (
        state.join(counted(source, "rows_source"), key, "left")
        .join(counted(destination, "rows_destination"), key, "left")
        .select(
            *key,
            F.coalesce("rows_source", F.lit(0)).cast("bigint").alias("rows_source"),
            F.coalesce("rows_destination", F.lit(0)).cast("bigint").alias("rows_destination"),
            F.col("last_pk_value").alias("last_pk"),
            "updated_at",
        )
    )


def metrics_documents(summary: DataFrame) -> DataFrame:
    """One JSON document per database with its tables nested, for export. What
    is nested is one small struct per table."""
    tables = summary.where(F.col("level") == "table")
    entry = F.struct(
        F.col("table_name"),
        F.col("total_source_rows").alias("rows_source"),
        F.col("total_destination_rows").alias("rows_destination"),
    )
    nested = tables.groupBy("server_name", "database_name").agg(
        F.array_sort(F.collect_list(entry)).alias("tables")
    )
    return nested.select("server_name", "database_name", F.to_json("tables").alias("document"))
