"""Schema drift, type profiles and the choice of a sync column."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinkeep.functions.fixed import ID_TYPES, TIME_TYPES
from twinkeep.functions.names import identifier, literal
from twinkeep.operators.numbering import stored
from twinkeep.sources.tables import column_metadata

SHORT_TEXT = 255
UUID_LENGTH = 36
UUID_DASHES = 4
#: Size of a distinct-count sketch (2 ** LG_K buckets), and how many standard errors a claim allows.
LG_K, SIGMAS = 14, 4


def stored_type(kind: T.DataType) -> str | None:
    """Replica type of a Spark type; None for text, which its values decide."""
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "BIGINT"
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return "DOUBLE PRECISION"
    if isinstance(kind, T.BooleanType):
        return "BOOLEAN"
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return "TIMESTAMP"
    if isinstance(kind, T.DateType):
        return "DATE"
    if isinstance(kind, T.DecimalType):
        return f"NUMERIC({kind.precision},{kind.scale})"
    return None if isinstance(kind, T.StringType) else "TEXT"


def _column_profile(df: DataFrame, name: str) -> str:
    """Profile of one column, as SQL text of one struct of aggregates."""
    column = identifier(name)
    kind = df.schema[name].dataType
    fixed = stored_type(kind)
    filled = f"count({column})"
    longest, uuid, whole = "CAST(NULL AS BIGINT)", "false", "false"
    suggested = literal(fixed or "")
    if fixed is None:
        dashes = f"length({column}) - length(translate({column}, '-', ''))"
        longest = f"CAST(max(length({column})) AS BIGINT)"
        uuid = f"""coalesce(bool_and(length({column}) = {UUID_LENGTH}
            AND {dashes} = {UUID_DASHES}), false)"""
        whole = f"coalesce(bool_and({column} RLIKE '^-?[0-9]+$'), false)"
        suggested = f"""CASE WHEN {uuid} THEN 'UUID'
            WHEN coalesce({longest}, 0) <= {SHORT_TEXT} THEN 'VARCHAR({SHORT_TEXT})'
            ELSE 'TEXT' END"""
    elif fixed == "BIGINT":
        whole = f"{filled} > 0"
    return f"""struct({literal(name)} AS column_name, {suggested} AS suggested_type,
        {filled} AS filled_rows, count(*) - {filled} AS null_rows, {longest} AS max_length,
        {uuid} AS looks_like_uuid, {whole} AS all_integers)"""


def profile_types(df: DataFrame) -> DataFrame:
    """Suggested type of every column: one pass over the table, one row per
    column. UUID and integer tests look at every value, not at a sample."""
    profiles = ", ".join(_column_profile(df, f.name) for f in df.schema)
    return df.selectExpr(f"inline(array({profiles}))")


def profile_tables(tables: Mapping[str, DataFrame]) -> DataFrame:
    parts = [
        profile_types(df).select(F.lit(name).alias("table_name"), "*")
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def schema_drift(source: DataFrame, destination: DataFrame) -> DataFrame:
    """Columns of two listings (table_name, column_name, data_type) side by side.
    Either side's type is NULL where it lacks the column."""
    key = ["table_name", "column_name"]
    left = source.select(*key, F.col("data_type").alias("source_type"))
    right = destination.select(*key, F.col("data_type").alias("destination_type"))
    src, dst = F.col("source_type"), F.col("destination_type")
    return left.join(right, key, "full").select(
        *key,
        src,
        dst,
        dst.isNull().alias("missing_in_destination"),
        (src.isNotNull() & dst.isNotNull() & (src != dst)).alias("type_differs"),
    )


def missing_columns(source: DataFrame, destination: DataFrame) -> DataFrame:
    """Columns of the source listing that the destination listing lacks."""
    key = ["table_name", "column_name"]
    return source.join(destination.select(*key), key, "left_anti")


def drift_of_tables(pairs: Mapping[str, tuple[DataFrame, DataFrame]]) -> DataFrame:
    """Drift of table pairs, with the number of source rows that hold a value in
    each column: what a load would lose where the column is missing."""
    spark = next(iter(pairs.values()))[0].sparkSession
    drift = schema_drift(
        column_metadata(spark, {name: pair[0] for name, pair in pairs.items()}),
        column_metadata(spark, {name: pair[1] for name, pair in pairs.items()}),
    )
    filled = reduce(
        DataFrame.unionByName, [_filled_rows(name, pair[0]) for name, pair in pairs.items()]
    )
    return drift.join(filled, ["table_name", "column_name"], "left")


def _filled_rows(table: str, df: DataFrame) -> DataFrame:
    counts = ", ".join(
        f"struct({literal(c)} AS column_name, count({identifier(c)}) AS source_values)"
        for c in df.columns
    )
    found = df.selectExpr(f"inline(array({counts}))")
    return found.select(F.lit(table).alias("table_name"), "*")


def primary_keys(usage: DataFrame) -> DataFrame:
    """Key columns in key order, from a listing of constraint columns with
    ``constraint_name`` and ``ordinal_position``. In ``PK_%`` the ``_`` stands
    for any one character, as it does in SQL."""
    order = Window.partitionBy("table_name").orderBy("ordinal_position")
    return usage.where(F.col("constraint_name").like("PK_%")).select(
        "table_name", "column_name", F.row_number().over(order).alias("pk_position")
    )


def verified_keys(tables: Mapping[str, DataFrame], keys: Mapping[str, Sequence[str]]) -> DataFrame:
    """Whether each listed key is one: rows, keys that occur more than once, rows whose key holds a
    NULL. Rows are combined per key and task before they shuffle, so a repeated key stays small."""
    parts = []
    for name, columns in keys.items():
        values = [F.col(identifier(c)) for c in columns]
        incomplete = reduce(lambda a, b: a | b, [v.isNull() for v in values]).alias("incomplete")
        per_key = tables[name].groupBy(*values, incomplete).agg(F.count("*").alias("n"))
        found = per_key.agg(
            F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("total_rows"),
            F.count_if((F.col("n") > 1) & ~F.col("incomplete")).alias("repeated_keys"),
            F.coalesce(F.sum(F.when(F.col("incomplete"), F.col("n"))), F.lit(0)).cast("bigint").alias("null_rows"),
        )
        holds = (F.col("repeated_keys") == 0) & (F.col("null_rows") == 0)
        parts.append(found.select(F.lit(name).alias("table_name"), F.lit(",".join(columns)).alias("key"), "*", holds.alias("is_key")))
    return reduce(DataFrame.unionByName, parts)


def sync_candidates(metadata: DataFrame) -> DataFrame:
    """Columns that could drive an incremental sync, with their rank class: key
    columns in key order, then times by name, then identifiers by name."""
    kind = F.regexp_replace(F.lower("data_type"), "_(ntz|ltz)$", "")
    rank = (
        F.when(F.col("pk_position").isNotNull(), 1)
        .when(kind.isin(*TIME_TYPES), 2)
        .when(kind.isin(*ID_TYPES), 3)
    )
    return metadata.withColumn("rank", rank).where(F.col("rank").isNotNull())


def choose_sync_column(metadata: DataFrame) -> DataFrame:
    """The sync column of each table that has one, and why it was chosen."""
    order = F.struct("rank", F.when(F.col("rank") == 1, F.col("pk_position")), "column_name")
    picked = F.min_by(F.struct("column_name", "rank"), order).alias("picked")
    reason = (
        F.when(F.col("picked.rank") == 1, "key")
        .when(F.col("picked.rank") == 2, "time")
        .otherwise("id")
    )
    return (
        sync_candidates(metadata)
        .groupBy("table_name")
        .agg(picked)
        .select("table_name", F.col("picked.column_name").alias("sync_column"), reason.alias("rule"))
    )


def profile_candidate(df: DataFrame, column: str) -> DataFrame:
    """Rows, NULLs, distinct values and ties at the maximum of one column, read
    alone. A column with ties cannot drive a client-side batch loop safely."""
    value = F.col(identifier(column))
    per_value = df.groupBy(value.alias("v")).agg(F.count("*").alias("n"))
    filled = F.col("v").isNotNull()
    return per_value.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("total_rows"),
        F.coalesce(F.sum(F.when(~filled, F.col("n"))), F.lit(0)).cast("bigint").alias("null_rows"),
        F.count("v").alias("distinct_values"),
        F.coalesce(F.max_by("n", F.col("v")), F.lit(0)).cast("bigint").alias("ties_at_max"),
    ).withColumn(
        "is_unique", (F.col("distinct_values") == F.col("total_rows"))
    )


def profile_candidates(
    tables: Mapping[str, DataFrame], candidates: Sequence[tuple[str, str]]
) -> DataFrame:
    """Profiles of (table, column) pairs in one job."""
    parts = [
        profile_candidate(tables[table], column).select(
            F.lit(table).alias("table_name"), F.lit(column).alias("column_name"), "*"
        )
        for table, column in candidates
    ]
    return reduce(DataFrame.unionByName, parts)


def sketch_error(lg_k: int = LG_K) -> float:
    """Relative standard error of the distinct values that a sketch estimates."""
    return 1.04 / 2 ** (lg_k / 2)


def _as_exact_text(value: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.BinaryType):
        return F.hex(value)
    if isinstance(kind, T.TimestampType):  # a point in time needs its zone as text
        return F.date_format(value, "yyyy-MM-dd HH:mm:ss.SSSSSSXXX")
    return value.cast("string")


def _from_exact_text(text: str | None, kind: T.DataType) -> Column:
    return F.unhex(F.lit(text)) if isinstance(kind, T.BinaryType) else F.lit(text).cast(kind)


def sketch_columns(df: DataFrame, columns: Sequence[str], lg_k: int = LG_K) -> DataFrame:
    """What ``profile_candidate`` tells of each column, for all columns in one pass: no value is
    shuffled, every task sends one sketch of at most 2 ** ``lg_k`` bytes per column.

    ``distinct_estimate`` is within ``SIGMAS`` times ``sketch_error`` of the distinct values but
    for one case in ten thousand; ``may_be_unique`` is false only where it tells that values repeat.
    ``sketch`` merges with those of other parts of the table by ``hll_union_agg``. The ties are
    counted by a second read; the maxima are pushed into its scan, whose statistics skip the rest.
    """
    values = [F.col(identifier(c)) for c in columns]
    aggregates = [F.count("*").alias("n")]
    for i, value in enumerate(values):
        hashed = F.when(value.isNotNull(), F.xxhash64(value))
        aggregates += [
            F.count(value).alias(f"n{i}"),
            F.hll_sketch_agg(hashed, F.lit(lg_k)).alias(f"s{i}"),
            _as_exact_text(F.max(value), df.schema[columns[i]].dataType).alias(f"m{i}"),
        ]
    first = stored(df.agg(*aggregates), "sketches")
    tops = first.select([f"m{i}" for i in range(len(columns))]).first()
    at_top = [v == _from_exact_text(top, df.schema[c].dataType) for c, v, top in zip(columns, values, tops)]
    ties = df.where(reduce(lambda a, b: a | b, at_top)).agg(
        *[F.count_if(top).alias(f"t{i}") for i, top in enumerate(at_top)]
    )

    def long_form(wide: DataFrame, *fields: str) -> DataFrame:
        rows = [f"struct({i} AS place, {literal(c)} AS column_name, {', '.join(fields).format(i=i)})" for i, c in enumerate(columns)]
        return wide.selectExpr(f"inline(array({', '.join(rows)}))")

    counts = long_form(first, "n AS total_rows", "n - n{i} AS null_rows", "s{i} AS sketch")
    found = counts.join(long_form(ties, "t{i} AS ties_at_max").drop("column_name"), "place")
    estimate = F.hll_sketch_estimate("sketch")
    return found.select(
        "column_name",
        "total_rows",
        "null_rows",
        estimate.alias("distinct_estimate"),
        "ties_at_max",
        (estimate >= F.col("total_rows") * (1 - SIGMAS * sketch_error(lg_k))).alias("may_be_unique"),
        "sketch",
    )


def sketch_candidates(
    tables: Mapping[str, DataFrame], candidates: Sequence[tuple[str, str]], lg_k: int = LG_K
) -> DataFrame:
    """``sketch_columns`` of (table, column) pairs, one pass per table."""
    wanted: dict[str, list[str]] = {}
    for table, column in candidates:
        wanted.setdefault(table, []).append(column)
    parts = [
        sketch_columns(tables[table], columns, lg_k).select(F.lit(table).alias("table_name"), "*")
        for table, columns in wanted.items()
    ]
    return reduce(DataFrame.unionByName, parts)
