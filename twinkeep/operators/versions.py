"""Versions of a table with a tree of fingerprints, compared from the root down.

A version is the table's rows laid out by a hash of their key: ``FANOUT ** DEPTH`` leaf
buckets, folders by the first level, files sorted by bucket. Beside the rows, every
level of the tree is stored: per node its number of rows and a fingerprint of them. Two versions
are compared level by level; only children of nodes that differ are looked at, and only
the rows of leaf buckets that differ are read: whole folders are skipped by name, row
groups by the bucket's bounds. A version is written once and compared with any other that
has the same shape, so a chain of versions costs one pass per version, not two per pair.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinkeep.functions.digest import (
    DIGEST,
    H1,
    H2,
    SharedColumn,
    comparison_type,
    digest,
    normalised,
    shared_columns,
)
from twinkeep.operators.compare import Differences, find_differences
from twinkeep.operators.numbering import stored

FANOUT, DEPTH = 64, 3
#: Nodes of one level that are named in a filter; a level with more differing nodes is joined.
NAMED_NODES = 1000

_PIECE = 21
_PRINT = ["n", "p0", "p1", "p2", "x"]
_NODE = ", ".join(f"{c} bigint" for c in ("node", *_PRINT, "parent"))
_SHAPE = "fanout int, depth int, schema string"


@dataclass(frozen=True)
class Version:
    """A written version: its rows (with ``_top`` and ``_bucket``) and its levels."""

    path: str
    fanout: int
    depth: int
    schema: str

    def rows(self, spark: SparkSession) -> DataFrame:
        schema = T.StructType.fromJson(json.loads(self.schema))
        return spark.read.schema(schema).parquet(f"{self.path}/rows")

    def level(self, spark: SparkSession, number: int) -> DataFrame:
        return spark.read.schema(_NODE).parquet(f"{self.path}/level_{number}")


def open_version(spark: SparkSession, path: str) -> Version:
    """A version written earlier. Its shape is written last, so one that is not whole cannot be opened."""
    found = spark.read.schema(_SHAPE).parquet(f"{path}/shape").first()
    return Version(path, *found)


def _bucket(df: DataFrame, keys: Sequence[SharedColumn], buckets: int) -> Column:
    parts = ", ".join(f"coalesce(CAST({normalised(df, k)} AS STRING), '')" for k in keys)
    return F.pmod(F.expr(f"xxhash64({parts})"), F.lit(buckets))


def _fingerprint() -> list[Column]:
    """Of a set of rows with copies: its size, sums of three pieces of one half of the
    digests, xor of the other. All of them combine from children to parents."""
    pieces = [F.sum(F.shiftright(H1, _PIECE * i).bitwiseAND(F.lit((1 << _PIECE) - 1))) for i in range(3)]
    return [c.alias(n) for n, c in zip(_PRINT, [F.count("*"), *pieces, F.bit_xor(H2)])]


def write_version(
    df: DataFrame,
    path: str,
    keys: Sequence[str],
    like: DataFrame | None = None,
    fanout: int = FANOUT,
    depth: int = DEPTH,
) -> Version:
    """Write ``df`` as a version. ``like`` is the table it will be compared with, where that
    stores its values in other types; digests are then taken in the common types."""
    other = df if like is None else like
    shared = shared_columns(df, other)
    by_name = {c.name: c for c in shared}
    key_columns = [by_name.get(k) or SharedColumn(k, comparison_type(df.schema[k].dataType, df.schema[k].dataType)) for k in keys]
    spark = df.sparkSession
    laid = df.selectExpr("*", *digest(df, shared)).withColumn("_bucket", _bucket(df, key_columns, fanout**depth))
    laid = laid.withColumn("_top", F.floor(F.col("_bucket") / fanout ** (depth - 1)).cast("int"))
    version = Version(path, fanout, depth, laid.schema.json())
    (
        laid.repartition("_top", F.floor(F.col("_bucket") / max(1, fanout ** (depth - 2))))
        .sortWithinPartitions("_top", "_bucket")
        .write.partitionBy("_top")
        .parquet(f"{path}/rows")
    )
    nodes = version.rows(spark).groupBy(F.col("_bucket").alias("node")).agg(*_fingerprint())
    for number in range(depth, -1, -1):
        parent = F.floor(F.col("node") / fanout).cast("bigint")
        (
            nodes.withColumn("parent", parent)
            .repartitionByRange("node")
            .sortWithinPartitions("node")
            .write.parquet(f"{path}/level_{number}")
        )
        sums = [F.sum(c).alias(c) for c in _PRINT[:-1]]
        nodes = version.level(spark, number).groupBy(F.col("parent").alias("node")).agg(*sums, F.bit_xor("x").alias("x"))
    spark.createDataFrame([(fanout, depth, version.schema)], _SHAPE).write.parquet(f"{path}/shape")
    return version


def _children(level: DataFrame, parents: DataFrame, named: list[int] | None) -> DataFrame:
    if named is not None:
        return level.where(F.col("parent").isin(named))
    return level.join(parents.withColumnRenamed("node", "parent"), "parent", "left_semi")


def differing_nodes(spark: SparkSession, left: Version, right: Version) -> tuple[DataFrame, list[int] | None]:
    """Leaf buckets whose rows differ, as a frame and, while they are few, by name."""
    if (left.fanout, left.depth) != (right.fanout, right.depth):
        raise ValueError("versions of different shapes cannot be compared")
    found: DataFrame | None = None
    named: list[int] | None = [0]
    for number in range(left.depth + 1):
        sides = [v.level(spark, number) for v in (left, right)]
        if number:
            sides = [_children(s, found, named) for s in sides]
        own, other = (s.select("node", F.struct(*_PRINT).alias(n)) for s, n in zip(sides, ("l", "r")))
        unlike = own.join(other, "node", "full_outer").where(~F.col("l").eqNullSafe(F.col("r")))
        found = stored(unlike.select("node"), "nodes")
        few = found.limit(NAMED_NODES + 1).collect()
        named = [r.node for r in few] if len(few) <= NAMED_NODES else None
    return found, named


def _changed(spark: SparkSession, version: Version, found: DataFrame, named: list[int] | None) -> DataFrame:
    rows = version.rows(spark)
    if named is None:
        rows = rows.join(found.withColumnRenamed("node", "_bucket"), "_bucket", "left_semi")
    else:
        tops = sorted({n // version.fanout ** (version.depth - 1) for n in named})
        rows = rows.where(F.col("_top").isin(tops) & F.col("_bucket").isin(named))
    return rows.drop("_top", "_bucket", *DIGEST)


def changed_rows_of(spark: SparkSession, left: Version, right: Version) -> tuple[DataFrame, DataFrame]:
    """The rows of both versions that lie in buckets that differ."""
    found, named = differing_nodes(spark, left, right)
    return _changed(spark, left, found, named), _changed(spark, right, found, named)


def compare_versions(spark: SparkSession, left: Version, right: Version) -> Differences:
    """What ``find_differences`` finds for the two tables, from the changed buckets alone."""
    return find_differences(*changed_rows_of(spark, left, right))
