"""Live view of run statuses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinkeep.session import delete_path

KEY = ["server_name", "database_name"]


def latest_status(runs: DataFrame) -> DataFrame:
    """The newest status of each database; works on a stream and on a table.
    The state holds one row per database, however many runs pass."""
    newest = F.max_by(F.struct("sync_status", "updated_at"), F.struct("updated_at", "run_id"))
    return (
        runs.groupBy(*KEY)
        .agg(newest.alias("newest"), F.count("*").alias("runs"))
        .select(*KEY, "newest.sync_status", "newest.updated_at", "runs")
    )


def follow_status(
    spark: SparkSession, source: str, schema: T.StructType, target: str, checkpoint: str
) -> None:
    """Fold the run files that arrived since the last call into the view. Every
    batch writes the whole view to its own folder ``view=<id>``; readers take
    the highest. The one before stays for readers under way, older ones go."""

    def put(view: DataFrame, batch: int) -> None:
        view.write.mode("overwrite").parquet(f"{target}/view={batch}")
        delete_path(spark, f"{target}/view={batch - 2}")

    (
        latest_status(spark.readStream.schema(schema).parquet(source))
        .writeStream.outputMode("complete")
        .foreachBatch(put)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )


def current_view(spark: SparkSession, target: str) -> DataFrame:
    views = spark.read.parquet(target)
    newest = views.agg(F.max("view")).first()[0]
    return views.where(F.col("view") == newest).drop("view")
