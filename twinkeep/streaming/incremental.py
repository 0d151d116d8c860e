"""Incremental append as a stream that drains what is there and stops."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinkeep.functions.digest import DIGEST, only_digest, own_columns, with_digest
from twinkeep.operators.compare import differences_from_few
from twinkeep.session import work_path
from twinkeep.streaming.known import BATCH, RUN, batches_to_probe, write_filter

#: Folders that are named in a filter; more are joined.
NAMED_FOLDERS = 1000
#: What every target holds from the start: no rows.
_FIRST = ("none", -1)


def read_target(spark: SparkSession, target: str, schema: T.StructType) -> DataFrame:
    """Everything batches wrote, with the checkpoint and the number of the batch."""
    keys = [T.StructField(RUN, T.StringType()), T.StructField(BATCH, T.LongType())]
    return spark.read.schema(T.StructType([*schema.fields, *keys])).parquet(target)


def append_new_files(
    spark: SparkSession,
    source: str,
    schema: T.StructType,
    target: str,
    checkpoint: str,
    drop_known: bool = False,
    range_column: str | None = None,
    files_per_batch: int | None = None,
) -> None:
    """Append the files that arrived since the last call; the checkpoint is the
    resume point. ``files_per_batch`` cuts a backlog into batches. Each batch overwrites its own
    ``run=<checkpoint>/batch=<id>`` folder, so a replay after a crash writes the same rows
    again instead of more. A new checkpoint counts from 0 again but has an identity of its
    own (Spark gives it one), so it never touches what another one wrote.

    With ``drop_known`` copies inside a batch collapse and rows that any other
    batch of the target holds are left out. Each batch then keeps a Bloom filter of its rows in
    ``<target>_filters``, and only folders whose filter a batch hits are read (see ``known``).
    ``range_column`` limits what is read of them to the values the batch has: equal rows have
    equal values, and file statistics skip the rest.
    """

    empty = spark.createDataFrame([], schema)
    empty.write.mode("ignore").parquet(f"{target}/{RUN}={_FIRST[0]}/{BATCH}={_FIRST[1]}")
    if drop_known:
        write_filter(only_digest(empty, own_columns(empty)), 0, target, schema, *_FIRST)

    def put(rows: DataFrame, batch: int) -> None:
        run = spark.read.json(f"{checkpoint}/metadata").first().id
        if drop_known:
            rows = _unknown_rows(spark, rows, target, (run, batch), schema, range_column)
        rows.write.mode("overwrite").parquet(f"{target}/{RUN}={run}/{BATCH}={batch}")

    reader = spark.readStream.schema(schema)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    (
        reader.parquet(source)
        .writeStream.foreachBatch(put)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )


def _read_folders(spark: SparkSession, target: str, schema: T.StructType, folders: DataFrame) -> DataFrame | None:
    """The rows of some batches; None without any batch."""
    few = folders.limit(NAMED_FOLDERS + 1).collect()
    if not few:
        return None
    rows = read_target(spark, target, schema)
    if len(few) > NAMED_FOLDERS:
        return rows.join(folders, [RUN, BATCH], "left_semi").drop(RUN, BATCH)
    runs: dict[str, list[int]] = {}
    for folder in few:
        runs.setdefault(folder[RUN], []).append(folder[BATCH])
    named = [(F.col(RUN) == run) & F.col(BATCH).isin(batches) for run, batches in runs.items()]
    return rows.where(reduce(Column.__or__, named)).drop(RUN, BATCH)


def _unknown_rows(
    spark: SparkSession,
    rows: DataFrame,
    target: str,
    own: tuple[str, int],
    schema: T.StructType,
    range_column: str | None,
) -> DataFrame:
    """The rows that no other batch holds; their filter is written on the way."""
    path = work_path(spark, "batch")
    digested = with_digest(rows, own_columns(rows))
    digested.dropDuplicates(DIGEST).write.parquet(path)
    staged = spark.read.schema(digested.schema).parquet(path)
    fresh, count = staged.drop(*DIGEST), staged.count()
    folders = batches_to_probe(staged.select(*DIGEST), count, target, schema, [own, _FIRST])
    others = _read_folders(spark, target, schema, folders)
    if others is not None:
        if range_column is not None:
            others = others.where(_within(fresh, range_column))
        fresh = differences_from_few(fresh, others).missing()
    write_filter(only_digest(fresh, own_columns(fresh)), count, target, schema, *own)
    return fresh


def _within(fresh: DataFrame, range_column: str) -> Column:
    value, kind = F.col(range_column), fresh.schema[range_column].dataType
    low, high = fresh.agg(F.min(value).cast("string"), F.max(value).cast("string")).first()
    inside = (value >= F.lit(low).cast(kind)) & (value <= F.lit(high).cast(kind))
    return value.isNull() if low is None else inside | value.isNull()
