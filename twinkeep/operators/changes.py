"""Deltas of one table and the ranking of many."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinkeep.functions.digest import DIGEST, digest, normalised, only_digest, shared_columns
from twinkeep.functions.names import identifier, literal
from twinkeep.operators.compare import Differences, compare_counts, find_differences, missing_rows
from twinkeep.operators.numbering import number_within

TOP_MARKED = 3


def delta_rows(source: DataFrame, destination: DataFrame) -> DataFrame:
    """Rows an incremental run would add: those the destination lacks."""
    return missing_rows(source, destination)


def delta_summary(source: DataFrame, destination: DataFrame) -> DataFrame:
    """Preview of an incremental run, in numbers."""
    return compare_counts(source, destination).select(
        F.col("missing_rows").alias("delta_count"),
        F.col("rows_source").alias("total_source_rows"),
        F.col("rows_destination").alias("total_destination_rows"),
    )


INSERTED, CHANGED, DELETED = "inserted", "changed", "deleted"


def changed_rows(
    source: DataFrame, destination: DataFrame, keys: Sequence[str], found: Differences | None = None
) -> DataFrame:
    """What happened to each row that differs: ``kind`` (inserted, changed, deleted), the key
    columns, ``copy`` and, of a changed row, ``changes``: the columns that differ, with both values as text.

    Only rows that one side lacks are aligned (``found``, or a fresh comparison): by key, NULL
    equal to ``''``. Where a key occurs more than once its differing rows are numbered on each side, in the order
    of their digests, and paired by number; what finds no partner was inserted or deleted. Numbering
    works for a key of any size. Rows that both sides have, in whatever number, are no change.
    """
    found = found or find_differences(source, destination)
    shared = shared_columns(source, destination)
    by_key = [c for c in shared if c.name in set(keys)]
    if len(by_key) != len(set(keys)):
        raise ValueError(f"both tables need the key columns {list(keys)}")

    def side(df: DataFrame) -> DataFrame:
        # A key meets by its digest: types and foldings are those of the comparison.
        ids = [t.replace(f" AS {half}", f" AS _k{i}") for i, (half, t) in enumerate(zip(DIGEST, digest(df, by_key)))]
        values = ", ".join(f"CAST({normalised(df, c)} AS STRING)" for c in shared)
        own = [identifier(c.name) for c in by_key]
        rows = df.selectExpr(*own, *ids, *digest(df, shared), f"array({values}) AS _values")
        numbered = number_within(rows, ["_k0", "_k1"], [F.col(h) for h in DIGEST], "copy")
        return numbered.drop(*DIGEST)

    names = [c.name for c in by_key]
    left, right = (side(df).select(*["_k0", "_k1", "copy"], F.struct(*map(identifier, names), "_values").alias(n))
                   for df, n in ((found.missing(), "l"), (found.extra(), "r")))
    kind = F.when(F.col("r").isNull(), INSERTED).when(F.col("l").isNull(), DELETED).otherwise(CHANGED)
    both = ", ".join(
        f"struct({literal(c.name)} AS name, l._values[{k}] AS source, r._values[{k}] AS destination)"
        for k, c in enumerate(shared)
    )
    unlike = F.expr(f"filter(array({both}), c -> NOT (c.source <=> c.destination))")
    key: list[Column] = [F.coalesce(F.col("l")[n], F.col("r")[n]).alias(n) for n in names]
    return left.join(right, ["_k0", "_k1", "copy"], "full_outer").select(
        kind.alias("kind"), *key, "copy", F.when(kind == CHANGED, unlike).alias("changes")
    )


TablePair = tuple[DataFrame, DataFrame] | Callable[[], tuple[DataFrame, DataFrame]]


def opened(
    pairs: Mapping[str, TablePair],
) -> tuple[dict[str, tuple[DataFrame, DataFrame]], dict[str, str]]:
    """Pairs whose two sides can be opened and give a row, and the errors of the others.
    A pair may be given as a function, so that what fails in it is its own error."""
    good, errors = {}, {}
    for name, given in pairs.items():
        try:
            pair = given() if callable(given) else given
            for side in pair:
                side.limit(1).isEmpty()
            good[name] = pair
        except Exception as problem:  # the row of the table carries it
            errors[name] = str(problem)
    return good, errors


def with_errors(found: DataFrame, errors: Mapping[str, str]) -> DataFrame:
    """``found`` with the column ``error`` and a row of zeros per failed table."""
    spark = found.sparkSession
    failed = spark.createDataFrame(list(errors.items()), "table_name string, error string")
    rest = [F.lit(0).cast(t).alias(c) for c, t in found.dtypes if c != "table_name"]
    whole = found.withColumn("error", F.lit(None).cast("string"))
    return whole.unionByName(failed.select("table_name", *rest, "error"))


def table_deltas_or_errors(pairs: Mapping[str, TablePair]) -> DataFrame:
    """``table_deltas`` of the tables that open, and a row with its error for each other."""
    good, errors = opened(pairs)
    if not good:
        raise RuntimeError(f"no table could be opened: {errors}")
    return with_errors(table_deltas(good), errors)


def table_deltas(pairs: Mapping[str, tuple[DataFrame, DataFrame]]) -> DataFrame:
    """Deltas of many tables in one job: the digests of all tables in long form,
    counted per (table, digest) in one shuffle, then per table."""
    sides = []
    for place, (source, destination) in enumerate(pairs.values(), start=1):
        shared = shared_columns(source, destination)
        for df, s, d in ((source, 1, 0), (destination, 0, 1)):
            sides.append(
                only_digest(df, shared, f"{place} AS place", f"{s}L AS s", f"{d}L AS d")
            )
    per_digest = (
        reduce(DataFrame.unionAll, sides)
        .groupBy("place", *DIGEST)
        .agg(F.sum("s").alias("s"), F.sum("d").alias("d"))
    )
    found = per_digest.groupBy("place").agg(
        F.expr("coalesce(sum(s) FILTER (WHERE d = 0), 0L) AS delta_count"),
        F.sum("s").alias("total_source_rows"),
        F.sum("d").alias("total_destination_rows"),
    )
    names = F.array(*[F.lit(name) for name in pairs])
    named = found.select(F.element_at(names, F.col("place")).alias("table_name"), "*")
    return _with_empty_tables(named.drop("place"), list(pairs))


def _with_empty_tables(deltas: DataFrame, names: list[str]) -> DataFrame:
    """Tables without a row on either side count as zero."""
    every = deltas.sparkSession.createDataFrame([(n,) for n in names], "table_name string")
    return every.join(deltas, "table_name", "left").na.fill(0)


def top_changed_tables(deltas: DataFrame) -> DataFrame:
    """Rank tables by delta, ties by name, and mark the first three. The window
    orders one row per table, not data rows."""
    order = Window.orderBy(F.col("delta_count").desc(), F.col("table_name"))
    return deltas.withColumn("rank", F.row_number().over(order)).withColumn(
        "is_top", F.col("rank") <= TOP_MARKED
    )


def changed_totals(deltas: DataFrame) -> DataFrame:
    return deltas.agg(
        F.count("*").alias("tables"),
        *[
            F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c)
            for c in ("delta_count", "total_source_rows", "total_destination_rows")
        ],
    )
