"""Row-level comparison of a source table and its replica.

Counts and differences come from one shuffle of 16-byte digests: both sides are
stacked, counted per digest with map-side combining, and reduced. A digest that
a third of all rows share is one partial count per task, so it is not skew.

Rows are fetched in a second step. The digests that differ are written to the
shared folder, so their number is a fact. Up to ``BROADCAST_DIGESTS`` of them
are broadcast and the full rows never shuffle. Beyond that the rows take a
shuffled semi join, but rows with many copies do not: their digests are few
whatever the table size (a digest counts as hot from a share of all rows that
bounds how many there can be), so those are broadcast and bypass the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from functools import cached_property

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from twinkeep.functions.digest import (
    DIGEST,
    H1,
    H2,
    SharedColumn,
    normalised,
    only_digest,
    own_columns,
    shared_columns,
    with_digest,
)
from twinkeep.functions.fixed import DEBUG_ROWS, HEAD_ROWS
from twinkeep.functions.names import identifier
from twinkeep.functions.status import count_status
from twinkeep.session import delete_path, work_path
from twinkeep.sources.tables import subset

MISSING, EXTRA, BOTH = "missing", "extra", "both"
_STORED = f"{H1} bigint, {H2} bigint, n_source bigint, n_destination bigint, kind string"

# At most this many digests are broadcast, some 50 MB in memory.
BROADCAST_DIGESTS = 500_000
# From this many copies on, a row is kept out of shuffles.
HOT_COPIES = 100_000


def digest_counts(
    source: DataFrame, destination: DataFrame, shared: Sequence[SharedColumn] | None = None
) -> DataFrame:
    """Per digest, the number of rows on each side."""
    shared = shared_columns(source, destination) if shared is None else shared
    left = only_digest(source, shared, "1L AS s", "0L AS d")
    right = only_digest(destination, shared, "0L AS s", "1L AS d")
    return (
        left.unionAll(right)
        .groupBy(*DIGEST)
        .agg(F.sum("s").alias("n_source"), F.sum("d").alias("n_destination"))
    )


def _total(column: Column) -> Column:
    return F.coalesce(F.sum(column), F.lit(0)).cast("bigint")


def compare_counts(
    source: DataFrame, destination: DataFrame, columns: Sequence[str] | None = None
) -> DataFrame:
    """One row with every count of a comparison. ``*_rows`` count copies,
    ``*_distinct`` count different rows, duplicates are all copies but the first."""
    shared = shared_columns(source, destination, columns)
    totals = {
        "rows_source": "sum(n_source)",
        "rows_destination": "sum(n_destination)",
        "duplicate_source_rows": "sum(greatest(n_source - 1, 0))",
        "duplicate_destination_rows": "sum(greatest(n_destination - 1, 0))",
        "missing_rows": "sum(n_source) FILTER (WHERE n_destination = 0)",
        "extra_rows": "sum(n_destination) FILTER (WHERE n_source = 0)",
        "missing_distinct": "count_if(n_destination = 0)",
        "extra_distinct": "count_if(n_source = 0)",
        "both_distinct": "count_if(n_source > 0 AND n_destination > 0)",
    }
    return digest_counts(source, destination, shared).selectExpr(
        *[f"coalesce({total}, 0L) AS {name}" for name, total in totals.items()]
    )


def validate_table(source: DataFrame, destination: DataFrame) -> DataFrame:
    """Counts, duplicates and distinct differences."""
    return compare_counts(source, destination).select(
        "rows_source",
        "rows_destination",
        "duplicate_source_rows",
        "duplicate_destination_rows",
        F.col("missing_distinct").alias("delta_missing"),
        F.col("extra_distinct").alias("delta_extra"),
    )


def verify_consistency(source: DataFrame, destination: DataFrame) -> DataFrame:
    """Row counts of both sides and their status; reads no column."""
    stacked = source.selectExpr("1L AS s", "0L AS d").unionAll(
        destination.selectExpr("0L AS s", "1L AS d")
    )
    return stacked.agg(
        _total(F.col("s")).alias("rows_source"), _total(F.col("d")).alias("rows_destination")
    ).withColumn("status", count_status(F.col("rows_source"), F.col("rows_destination")))


def partial_preview(
    source: DataFrame,
    destination: DataFrame,
    columns: Sequence[str] | None = None,
    filter_sql: str | None = None,
) -> DataFrame:
    """What a partial sync would insert. The predicate applies to the source only."""
    counts = compare_counts(subset(source, columns, filter_sql), subset(destination, columns))
    return counts.select(
        "rows_source",
        "rows_destination",
        F.col("missing_distinct").alias("would_insert"),
        F.col("both_distinct").alias("already_synced"),
    )


@dataclass(frozen=True)
class Differences:
    """Digests that only one side has, and digests with many copies, stored with
    their numbers of copies."""

    source: DataFrame
    destination: DataFrame
    shared: list[SharedColumn]
    path: str
    broadcast_digests: int = BROADCAST_DIGESTS
    hot_copies: int = HOT_COPIES
    one_sided: bool = False

    def release(self) -> None:
        """Delete the stored digests; rows can't be fetched afterwards."""
        delete_path(self.source.sparkSession, self.path)

    @cached_property
    def digests(self) -> DataFrame:
        return self.source.sparkSession.read.schema(_STORED).parquet(self.path)

    @cached_property
    def _sizes(self) -> dict[str, Row]:
        """Per kind, how many digests and copies are stored: at most three rows."""
        many = self.hot_copies
        sizes = self.digests.groupBy("kind").agg(
            F.expr("count(*) AS digests"),
            F.expr("sum(n_source + n_destination) AS copies"),
            F.expr(f"coalesce(sum(n_source) FILTER (WHERE n_source >= {many}), 0) AS hot_source"),
            F.expr(
                f"""coalesce(sum(n_destination) FILTER (WHERE n_destination >= {many}), 0)
                    AS hot_destination"""
            ),
        )
        return {row.kind: row for row in sizes.collect()}

    def copies(self, kind: str) -> int:
        """Number of missing or extra rows."""
        return self._sizes[kind].copies if kind in self._sizes else 0

    def _hot_from(self, side: str) -> int | None:
        """Copies from which a digest is hot, or None where none is. The copies
        of hot digests add up to ``total``, so at most ``broadcast_digests``
        digests can have ``total / broadcast_digests`` copies each."""
        total = sum(row[f"hot_{side}"] for row in self._sizes.values())
        if total == 0:
            return None
        return max(self.hot_copies, -(-total // self.broadcast_digests))

    def _rows(self, df: DataFrame, kind: str, side: str) -> DataFrame:
        rows = with_digest(df, self.shared)
        wanted = self.digests.where(F.col("kind") == kind)
        if kind not in self._sizes:
            return df.limit(0)
        names = [F.col(identifier(c)) for c in df.columns]
        if self._sizes[kind].digests <= self.broadcast_digests:
            few = F.broadcast(wanted.select(*DIGEST))
            return rows.join(few, DIGEST, "left_semi").select(*names)
        hot_from = self._hot_from(side)
        if hot_from is None:
            return rows.join(wanted.select(*DIGEST), DIGEST, "left_semi").select(*names)
        is_hot = F.col(f"n_{side}") >= hot_from
        hot = self.digests.where(is_hot)
        hot_wanted = F.broadcast(hot.where(F.col("kind") == kind).select(*DIGEST))
        cold_wanted = wanted.where(~is_hot).select(*DIGEST)
        cold = rows.join(F.broadcast(hot.select(*DIGEST)), DIGEST, "left_anti")
        return (
            rows.join(hot_wanted, DIGEST, "left_semi")
            .unionAll(cold.join(cold_wanted, DIGEST, "left_semi"))
            .select(*names)
        )

    def missing(self) -> DataFrame:
        """Source rows, copies included, that the destination lacks."""
        return self._rows(self.source, MISSING, "source")

    def extra(self) -> DataFrame:
        """Destination rows, copies included, that the source lacks. A comparison of few
        rows with a large table never looked for them."""
        if self.one_sided:
            raise ValueError("a comparison from few rows finds missing rows only")
        return self._rows(self.destination, EXTRA, "destination")


def _store(
    counts: DataFrame,
    source: DataFrame,
    destination: DataFrame,
    shared: list[SharedColumn],
    hot_copies: int = HOT_COPIES,
    broadcast_digests: int = BROADCAST_DIGESTS,
) -> Differences:
    """Keep what differs, and what has many copies on either side."""
    path = work_path(source.sparkSession, "differences")
    (
        counts.where(
            f"n_source = 0 OR n_destination = 0 OR greatest(n_source, n_destination) >= {hot_copies}"
        )
        .selectExpr(
            *DIGEST,
            "n_source",
            "n_destination",
            f"""CASE WHEN n_destination = 0 THEN '{MISSING}'
                     WHEN n_source = 0 THEN '{EXTRA}' ELSE '{BOTH}' END AS kind""",
        )
        .hint("rebalance", "kind")
        .write.partitionBy("kind")
        .parquet(path)
    )
    return Differences(source, destination, shared, path, broadcast_digests, hot_copies)


def find_differences(
    source: DataFrame,
    destination: DataFrame,
    columns: Sequence[str] | None = None,
    bucket: Column | None = None,
    buckets: int = 65_536,
    hot_copies: int = HOT_COPIES,
    broadcast_digests: int = BROADCAST_DIGESTS,
) -> Differences:
    """Run the comparison and store the digests that differ.

    With ``bucket`` (a column computed alike on both sides, say a key), first
    fingerprint the table per bucket without shuffling rows, and compare only
    buckets that differ. That pays when few rows changed. Choose ``buckets`` so that one
    holds some 100,000 rows: their number bounds what is written in between.
    """
    shared = shared_columns(source, destination, columns)
    if not shared:
        raise ValueError("source and destination share no column")
    left, right = source, destination
    if bucket is not None:
        numbered = _bucket_number(bucket, buckets)
        path = work_path(source.sparkSession, "buckets")
        (
            bucket_fingerprints(source, destination, numbered, shared)
            .where(~F.col("is_equal"))
            .select("bucket")
            .hint("rebalance")
            .write.parquet(path)
        )
        changed = source.sparkSession.read.schema("bucket bigint").parquet(path)
        few = changed.count() <= broadcast_digests
        left = _in_buckets(source, numbered, changed, few)
        right = _in_buckets(destination, numbered, changed, few)
    return _store(
        digest_counts(left, right, shared),
        left,
        right,
        shared,
        hot_copies,
        broadcast_digests,
    )


def differences_from_few(
    rows: DataFrame,
    existing: DataFrame,
    hot_copies: int = HOT_COPIES,
    broadcast_digests: int = BROADCAST_DIGESTS,
) -> Differences:
    """The comparison for a small table against a much larger one; only what the
    large one lacks is found.

    The distinct digests of the rows are stored and counted first. When they are
    few, the large side is probed where it lies and only its hits shuffle;
    otherwise its digests are combined per task before they shuffle.
    """
    shared = shared_columns(rows, existing)
    if not shared:
        raise ValueError("the two tables share no column")
    spark = rows.sparkSession
    path = work_path(spark, "digests")
    (
        only_digest(rows, shared)
        .groupBy(*DIGEST)
        .agg(F.count("*").alias("n_source"))
        .write.parquet(path)
    )
    wanted = spark.read.schema(f"{H1} bigint, {H2} bigint, n_source bigint").parquet(path)
    large = only_digest(existing, shared)
    keys = wanted.select(*DIGEST)
    if wanted.count() <= broadcast_digests:
        hits = large.join(F.broadcast(keys), DIGEST, "left_semi").distinct()
    else:
        hits = large.distinct().join(keys, DIGEST, "left_semi")
    found = F.when(F.col("_hit"), F.lit(1)).otherwise(F.lit(0)).cast("bigint")
    counts = wanted.join(hits.withColumn("_hit", F.lit(True)), DIGEST, "left").select(
        *DIGEST, "n_source", found.alias("n_destination")
    )
    found = _store(counts, rows, existing, shared, hot_copies, broadcast_digests)
    return replace(found, one_sided=True)


def missing_rows(source: DataFrame, destination: DataFrame) -> DataFrame:
    return find_differences(source, destination).missing()


def extra_rows(source: DataFrame, destination: DataFrame) -> DataFrame:
    return find_differences(source, destination).extra()


def compare_heads(
    source: DataFrame, destination: DataFrame, order_by: Sequence[str], n: int = HEAD_ROWS
) -> DataFrame:
    """The first rows of each side in key order, labelled by side."""

    def head(df: DataFrame, side: str) -> DataFrame:
        top = df.orderBy(*order_by, *[c for c in df.columns if c not in order_by]).limit(n)
        return top.withColumn("side", F.lit(side))

    return head(source, "source").unionByName(
        head(destination, "destination"), allowMissingColumns=True
    )


def debug_new_rows(
    source: DataFrame, destination: DataFrame, order_by: Sequence[str], limit: int = DEBUG_ROWS
) -> DataFrame:
    """A sample of missing rows in key order, NULL text shown as ``''``, with the
    full number of missing rows beside each."""
    found = find_differences(source, destination)
    shown = found.missing().na.fill("")
    rest = [c for c in shown.columns if c not in order_by]
    total = F.lit(found.copies(MISSING)).cast("bigint")
    return shown.orderBy(*order_by, *rest).limit(limit).withColumn("missing_total", total)


def duplicate_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(copies, different_rows): how many rows occur how often."""
    per_row = only_digest(df, own_columns(df, columns)).groupBy(*DIGEST).agg(
        F.count("*").alias("copies")
    )
    return per_row.groupBy("copies").agg(F.count("*").alias("different_rows"))


def later_copies(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Every different row that occurs more than once, with the number of its
    second and later copies. Copies are counted, not numbered: numbering would
    bring all copies of a row into one task."""
    values = [F.expr(normalised(df, c)).alias(c.name) for c in own_columns(df, columns)]
    return df.groupBy(*values).agg((F.count("*") - 1).alias("later_copies")).where(
        "later_copies > 0"
    )


def _bucket_number(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets))


def _in_buckets(df: DataFrame, number: Column, changed: DataFrame, few: bool) -> DataFrame:
    """Rows of the changed buckets; one small row per bucket is broadcast while they are few."""
    numbered = df.withColumn("_bucket", number)
    wanted = changed.withColumnRenamed("bucket", "_bucket")
    if few:
        wanted = F.broadcast(wanted)
    return numbered.join(wanted, "_bucket", "left_semi").drop("_bucket")


_PIECE = 21


def bucket_fingerprints(
    source: DataFrame,
    destination: DataFrame,
    bucket: Column,
    shared: Sequence[SharedColumn] | None = None,
) -> DataFrame:
    """Per bucket: rows on each side and whether both hold the same rows.

    The fingerprint of a set of rows with copies is its size, the sums of three
    21-bit pieces of the first digest half and the xor of the second. The sums
    stay below 2^63 for 2^42 rows per bucket. Only one row per bucket and task
    is shuffled.
    """
    shared = shared_columns(source, destination) if shared is None else shared

    def side(df: DataFrame, is_source: bool) -> DataFrame:
        return only_digest(
            df.withColumn("_bucket", bucket),
            shared,
            "_bucket AS bucket",
            f"{str(is_source).lower()} AS is_source",
        )

    def parts(is_source: bool) -> list[Column]:
        mine = f"FILTER (WHERE is_source = {str(is_source).lower()})"
        mask = (1 << _PIECE) - 1
        sums = [f"sum(shiftright({H1}, {_PIECE * i}) & {mask}L) {mine}" for i in range(3)]
        return [F.expr(t) for t in (f"count(*) {mine}", *sums, f"bit_xor({H2}) {mine}")]

    names = ["n", "p0", "p1", "p2", "x"]
    return (
        side(source, True)
        .unionAll(side(destination, False))
        .groupBy("bucket")
        .agg(
            *[c.alias(f"s_{n}") for n, c in zip(names, parts(True))],
            *[c.alias(f"d_{n}") for n, c in zip(names, parts(False))],
        )
        .select(
            "bucket",
            F.col("s_n").alias("rows_source"),
            F.col("d_n").alias("rows_destination"),
            _all_equal(names).alias("is_equal"),
        )
    )


def _all_equal(names: Sequence[str]) -> Column:
    equal = F.lit(True)
    for name in names:
        equal = equal & F.col(f"s_{name}").eqNullSafe(F.col(f"d_{name}"))
    return equal
