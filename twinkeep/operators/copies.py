"""Copies of rows, marked one by one."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinkeep.functions.digest import DIGEST, only_digest, own_columns, with_digest
from twinkeep.operators.compare import BROADCAST_DIGESTS
from twinkeep.operators.numbering import number_within, stored


def mark_copies(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    order: Sequence[Column] = (),
    broadcast_digests: int = BROADCAST_DIGESTS,
    name: str = "copy_number",
) -> DataFrame:
    """Every row with its number, from 1, among the rows that are the same in ``columns`` (all
    by default): 2 and more are later copies.

    Digests are counted first (16 bytes per row, combined per task). Rows that occur once
    stay where they are; only rows with copies are shuffled and numbered, and a row with
    very many copies spans many tasks.
    """
    shared = own_columns(df, columns)
    counted = only_digest(df, shared).groupBy(*DIGEST).agg(F.count("*").alias("n"))
    several = stored(counted.where("n > 1").select(*DIGEST), "several")
    if several.count() <= broadcast_digests:
        several = F.broadcast(several)
    marked = with_digest(df, shared)
    single = marked.join(several, DIGEST, "left_anti").withColumn(name, F.lit(1).cast("bigint"))
    copied = number_within(marked.join(several, DIGEST, "left_semi"), DIGEST, order, name)
    return single.unionByName(copied).drop(*DIGEST)
