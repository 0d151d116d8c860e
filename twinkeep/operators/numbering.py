"""Places of rows within groups of any size.

A window function brings each group into one task. Here rows are sorted by group and order
over all partitions (a range shuffle that breaks ties, so a group with a third of all
rows spans as many partitions as it fills); a row's place is its place in its partition,
and per partition and group one count is added up.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinkeep.functions.names import identifier
from twinkeep.session import work_path

_ROW, _PART, _NTH = "_num_row", "_num_part", "_num_nth"


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read again."""
    path = work_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def placed(df: DataFrame, by: Sequence[str], order: Sequence[Column] = ()) -> DataFrame:
    """``df`` stored in the order of groups and ``order``, with its partitions and places in them."""
    keys = [F.col(identifier(c)) for c in by]
    # The order is given as columns, so that no name is needed for an expression.
    sort = [*[k.asc_nulls_first() for k in keys], *order, F.col(_ROW).asc()]
    ranged = (
        df.withColumn(_ROW, F.monotonically_increasing_id())
        .repartitionByRange(*sort)
        .sortWithinPartitions(*sort)
        .withColumn(_PART, F.spark_partition_id())
        .withColumn(_NTH, F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    )
    return stored(ranged.drop(_ROW), "placed")


def number_within(
    df: DataFrame, by: Sequence[str], order: Sequence[Column] = (), name: str = "number"
) -> DataFrame:
    """``df`` with ``name``: a row's place, from 1, among the rows with equal ``by`` (NULL equals
    NULL) in the given order. Equal places are broken arbitrarily, as ``row_number`` does."""
    rows = placed(df, by, order)
    keys = [F.col(identifier(c)) for c in by]
    heads = rows.groupBy(*keys, _PART).agg(F.min(_NTH).alias("_low"), F.count("*").alias("_n"))
    earlier = (
        Window.partitionBy(*keys).orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    )  # one row per partition that holds the group
    before = F.coalesce(F.sum("_n").over(earlier), F.lit(0).cast("bigint"))
    # Only a group's later partitions need more than the place of its first row there.
    names = {c: f"_of_{k}" for k, c in enumerate(by)}
    starts = heads.withColumn("_start", before - F.col("_low") + 1).select(
        *[F.col(identifier(c)).alias(n) for c, n in names.items()], F.col(_PART).alias("_of_part"), "_start"
    )
    same = [F.col(identifier(c)).eqNullSafe(F.col(n)) for c, n in names.items()]
    on = reduce(Column.__and__, same, F.col(_PART) == F.col("_of_part"))
    number = (F.col(_NTH) + F.col("_start")).alias(name)
    return rows.join(starts, on).select(*[F.col(identifier(c)) for c in df.columns], number)
