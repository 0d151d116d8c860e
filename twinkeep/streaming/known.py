"""Which batches of a target may hold given rows: a Bloom filter per batch.

Beside a target, each batch that drops known rows writes a filter of its rows' digests, about
32 bits per row, in blocks of 16 words: a row sets one bit in each word of one block, so a
filter is an aggregation by block, and a look-up is a join by block. A batch then reads only
folders whose filter it hits, and folders that have none (written without ``drop_known``, or under
another schema, whose digests differ). A filter has no false negatives, so leaving
folders out changes no result; a wrong hit (some 1 in 10^6 per row and folder) only
costs reading a folder. Look-ups grow with rows times folders, at 4 bytes per row of the target.

A filter is written before its batch: whoever finds rows without a filter reads them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinkeep.functions.digest import DIGEST, H1, H2
from twinkeep.operators.compare import BROADCAST_DIGESTS
from twinkeep.operators.numbering import stored

#: A batch is known by the checkpoint that counts it and by its number there.
RUN, BATCH = "run", "batch"
#: Rows per block on average, words of a block.
ROWS_PER_BLOCK, WORDS = 32, 16

_WORDS = [f"w{i}" for i in range(WORDS)]
_FILTER = f"schema string, blocks bigint, block bigint, {', '.join(f'{w} bigint' for w in _WORDS)}, {RUN} string, {BATCH} bigint"
_BITS, _FROM_H2 = 6, 10


def filters_path(target: str) -> str:
    return f"{target.rstrip('/')}_filters"


def _schema_key(schema: T.StructType) -> str:
    return hashlib.sha256(schema.json().encode()).hexdigest()


def _bits() -> list[Column]:
    """Per word the bit that a digest sets there."""
    halves = [F.col(H2)] * _FROM_H2 + [F.xxhash64(H2, H1)] * (WORDS - _FROM_H2)
    shifts = [_BITS * (i % _FROM_H2) for i in range(WORDS)]
    return [
        F.shiftrightunsigned(half, shift).bitwiseAND(F.lit((1 << _BITS) - 1)).cast("int")
        for half, shift in zip(halves, shifts)
    ]


def write_filter(
    digests: DataFrame, rows: int, target: str, schema: T.StructType, run: str, batch: int
) -> None:
    """The filter of a batch of at most ``rows`` digests."""
    blocks = 1 << max(0, (rows - 1) // ROWS_PER_BLOCK).bit_length()
    # Digests move once, 16 bytes each, not half-filled blocks.
    laid = digests.select(*DIGEST, F.pmod(H1, F.lit(blocks)).alias("block")).repartition("block")
    words = [
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), bit)).alias(word)
        for word, bit in zip(_WORDS, _bits())
    ]
    built = laid.groupBy("block").agg(*words)
    built.select(
        F.lit(_schema_key(schema)).alias("schema"), F.lit(blocks).cast("bigint").alias("blocks"), "block", *_WORDS
    ).write.mode("overwrite").parquet(f"{filters_path(target)}/{RUN}={run}/{BATCH}={batch}")


def read_filters(spark: SparkSession, target: str, schema: T.StructType) -> DataFrame:
    filters = spark.read.schema(_FILTER).parquet(filters_path(target))
    return filters.where(F.col("schema") == _schema_key(schema)).drop("schema")


def _hit(digests: DataFrame, count: int, filters: DataFrame) -> DataFrame:
    sizes = [r.blocks for r in filters.select("blocks").distinct().collect()]  # powers of two
    if not sizes:
        return filters.select(RUN, BATCH).limit(0)
    size = F.explode(F.array(*[F.lit(s).cast("bigint") for s in sizes])).alias("blocks")
    probes = digests.select(*DIGEST, size).withColumn("block", F.pmod(F.col(H1), F.col("blocks")))
    if count <= BROADCAST_DIGESTS:
        probes = F.broadcast(probes)
    inside = [
        F.call_function("shiftright", F.col(word), bit).bitwiseAND(F.lit(1)) == 1
        for word, bit in zip(_WORDS, _bits())
    ]
    met = filters.join(probes, ["blocks", "block"])
    return met.where(reduce(Column.__and__, inside)).select(RUN, BATCH).distinct()


def _folders(spark: SparkSession, target: str) -> DataFrame:
    """Batches of the target, from the listing of its files alone."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(target)
    return files.select(F.col(RUN).cast("string"), F.col(BATCH).cast("bigint")).distinct()


def batches_to_probe(
    digests: DataFrame, count: int, target: str, schema: T.StructType, leave_out: Sequence[tuple[str, int]]
) -> DataFrame:
    """``run`` and ``batch`` of the folders that may hold one of the ``count`` digests."""
    spark = digests.sparkSession
    filters = read_filters(spark, target, schema)
    named = filters.select(RUN, BATCH).distinct()
    bare = _folders(spark, target).join(named, [RUN, BATCH], "left_anti")
    others = [~((F.col(RUN) == run) & (F.col(BATCH) == batch)) for run, batch in leave_out]
    found = bare.unionByName(_hit(digests, count, filters))
    return stored(reduce(DataFrame.where, others, found), "folders")
