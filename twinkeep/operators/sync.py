"""Full and incremental loads of tables, databases and servers.

Order of writes: data first, ledger row second. A run that dies in between is
repaired by the next one, which compares what lies beyond the watermark on both
sides before it appends.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor, as_completed
from dataclasses import dataclass, field
from datetime import datetime, timezone
from functools import partial

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinkeep.functions.digest import shared_columns
from twinkeep.functions.fixed import (
    DEFAULT_SCHEMA,
    ID_TYPES,
    SYSTEM_DATABASES,
    SYSTEM_SCHEMA,
    SYSTEM_TABLES,
    TIME_TYPES,
)
from twinkeep.functions.names import (
    clean_text,
    identifier,
    namespace_text,
    shared_targets,
    split_text,
    target_table,
)
from twinkeep.operators.compare import MISSING, Differences, differences_from_few, find_differences
from twinkeep.operators.compaction import state_rows
from twinkeep.operators.ledger import TABLE_KEY, database_state, matching, table_state
from twinkeep.sources.ledger_tables import DATABASE_RUNS, JOB_RUNS, RUN_LOG, TABLE_RUNS, append_rows
from twinkeep.sources.sinks import append_evolving, ensure_namespace, write_header
from twinkeep.sources.tables import catalog_listing, table_or_empty, user_tables

#: Outcomes appended to the ledger at once.
LEDGER_BATCH = 50

SourceTable = DataFrame | Callable[[], DataFrame]


#: Types whose values have an exact text.
_TEXT_TYPES = (
    T.NumericType, T.StringType, T.DateType, T.TimestampType, T.TimestampNTZType, T.BinaryType
)


@dataclass(frozen=True)
class Watermark:
    """The last value of a sync column, as text with its type, so it comes back
    as the value it was. Binary values are written in hexadecimal digits."""

    text: str
    type: str

    def column(self, kind: T.DataType):
        text = F.lit(self.text)
        stored = F.unhex(text) if self.type == "binary" else text.cast(self.type)
        return stored if kind.simpleString() == self.type else stored.cast(kind)


@dataclass
class Outcome:
    """What one table run did."""

    route: str
    rows_written: int = 0
    watermark: Watermark | None = None
    added_columns: list[str] = field(default_factory=list)
    #: Rows of batches that were committed before this outcome.
    rows_before: int = 0


def is_system_table(table: str) -> bool:
    return split_text(table)[0].lower() == SYSTEM_SCHEMA or table in SYSTEM_TABLES


def _highest(column: str, kind: T.DataType):
    """The highest value of a sync column as exact text; NaN is above everything and
    would end all syncs, so it does not count."""
    if not isinstance(kind, _TEXT_TYPES):
        raise ValueError(f"{column} cannot be a sync column: {kind.simpleString()} has no exact text")
    value = F.col(identifier(column))
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        value = F.when(~F.isnan(value), value)
    highest = F.max(value)
    if isinstance(kind, T.BinaryType):
        return F.hex(highest)
    if isinstance(kind, T.TimestampType):  # a point in time needs its zone as text
        return F.date_format(highest, "yyyy-MM-dd HH:mm:ss.SSSSSSXXX")
    return highest.cast("string")


def _top(df: DataFrame, column: str | None) -> Watermark | None:
    """The highest sync value before a comparison, read from one column. Rows that arrive
    meanwhile may be compared too; the next run then finds them in the target."""
    if column is None:
        return None
    kind = df.schema[column].dataType
    top = df.agg(_highest(column, kind)).first()[0]
    return None if top is None else Watermark(top, kind.simpleString())


class _Watched:
    """Rows to write that are counted, and their highest sync value taken, by the very job that
    writes them: what is reported is what was written, and no pass is added."""

    def __init__(self, df: DataFrame, column: str | None):
        kind = None if column is None else df.schema[column].dataType
        self._type = None if kind is None else kind.simpleString()
        top = F.max(F.lit(None).cast("string")) if kind is None else _highest(column, kind)
        self._seen = Observation(f"sync_{uuid.uuid4().hex}")
        self.rows = df.observe(self._seen, F.count(F.lit(1)).alias("n"), top.alias("top"))

    def count(self) -> int:
        return self._seen.get["n"]

    def watermark(self) -> Watermark | None:
        top = self._seen.get["top"]
        return None if top is None else Watermark(top, self._type)


def full_sync(
    spark: SparkSession, source: DataFrame, target: str, sync_column: str | None = None
) -> Outcome:
    """Append the whole source and note the watermark."""
    column = sync_column if sync_column in source.columns else None
    if source.limit(1).isEmpty():
        return Outcome("full")
    return _load(spark, source, target, column, "full")


def _load(
    spark: SparkSession, source: DataFrame, target: str, column: str | None, route: str
) -> Outcome:
    watched = _Watched(source, column)
    added = append_evolving(spark, watched.rows, target)
    return Outcome(route, watched.count(), watched.watermark(), added)


def incremental_sync(
    spark: SparkSession,
    source: DataFrame,
    target: str,
    sync_column: str | None = None,
    last: Watermark | None = None,
    batch_rows: int | None = None,
    commit: Callable[[Outcome], None] | None = None,
) -> Outcome:
    """Append what is new, by one of three routes.

    * sync column and watermark: rows strictly beyond the watermark;
    * no watermark, or no sync column: rows whose digest the target lacks, or
      everything where the target is empty.

    A known watermark over an empty source changes nothing: the source may have
    been truncated, and the target is kept. A source that cannot be read raises.

    With ``batch_rows`` the range route appends a backlog in batches of about that many rows, in
    the order of the sync column; ``commit`` is given the outcome of every batch but the last, which is
    returned. Whoever stores their watermarks goes on after the last one when a run dies.
    """
    column = sync_column if sync_column in source.columns else None
    if last is not None and source.limit(1).isEmpty():
        return Outcome("empty_source", 0, last)
    if column is not None and last is not None:
        if batch_rows:
            return _batched_range(spark, source, target, column, last, batch_rows, commit)
        return _range_route(spark, source, target, column, last)
    return _digest_route(spark, source, target, column)


def _range_route(
    spark: SparkSession, source: DataFrame, target: str, column: str, last: Watermark
) -> Outcome:
    value = F.col(identifier(column))
    fresh = source.where(value > last.column(source.schema[column].dataType))
    if fresh.limit(1).isEmpty():
        return Outcome("range", 0, last)
    present = table_or_empty(spark, target, source.schema)
    target_column = clean_text(column)
    if target_column in present.columns:
        beyond = present.where(
            F.col(identifier(target_column)) > last.column(present.schema[target_column].dataType)
        )
        if not beyond.limit(1).isEmpty():
            top = _top(fresh, column) or last
            found = differences_from_few(fresh, beyond)
            return _append_missing(spark, found, target, "range", top)
    done = _load(spark, fresh.hint("rebalance"), target, column, "range")
    done.watermark = done.watermark or last
    return done


#: Types whose cut points come from a quantile sketch; others take those of a range shuffle.
_SKETCHED = (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType)
#: Accuracy of the sketch: ranks are off by at most 1 / ACCURACY of all rows.
ACCURACY = 10_000


def cut_points(fresh: DataFrame, column: str, batches: int) -> list[Watermark]:
    """Values that cut the rows into about equal batches, ascending, the highest last: equal values
    are never parted, so a batch is whatever lies after one value up to the next."""
    kind = fresh.schema[column].dataType
    value = F.col(identifier(column)).alias("v")
    if isinstance(kind, _SKETCHED):
        shares = [(k + 1) / batches for k in range(batches - 1)]
        real = ~F.isnan("v") if isinstance(kind, (T.FloatType, T.DoubleType)) else F.lit(True)
        sketch = F.percentile_approx("v", shares, ACCURACY) if shares else F.array().cast(T.ArrayType(kind))
        points = fresh.select(value).where(real).agg(sketch.alias("q")).select(F.explode("q").alias("v"))
    else:
        # A range shuffle of this one column; its partitions never part equal values.
        ranged = fresh.select(value).repartitionByRange(batches, "v")
        points = ranged.groupBy(F.spark_partition_id()).agg(F.max("v").alias("v")).select("v")
    # Each point as the exact text of its own value: at most ``batches`` rows.
    found = points.where("v IS NOT NULL").groupBy("v").agg(_highest("v", kind).alias("text")).orderBy("v").collect()
    texts = [r.text for r in found if r.text is not None]
    top = _top(fresh, column)
    if top is None:
        return []
    return [Watermark(t, top.type) for t in texts if t != top.text] + [top]


def _batched_range(
    spark: SparkSession,
    source: DataFrame,
    target: str,
    column: str,
    last: Watermark,
    batch_rows: int,
    commit: Callable[[Outcome], None] | None,
) -> Outcome:
    """The range route in batches. A batch that an earlier run wrote without committing is
    compared with the target before it is appended, as any range run is."""
    kind = source.schema[column].dataType
    value = F.col(identifier(column))
    backlog = source.where(value > last.column(kind))
    total = backlog.count()
    if not total:
        return Outcome("range", 0, last)
    before, done, added = 0, Outcome("range", 0, last), []
    points = cut_points(backlog, column, -(-total // batch_rows))
    for place, point in enumerate(points):
        batch = source.where(value <= point.column(kind))
        done = _range_route(spark, batch, target, column, done.watermark)
        done.watermark = point
        added += done.added_columns
        if place < len(points) - 1:
            before += done.rows_written
            if commit:
                commit(done)
    done.rows_before, done.added_columns = before, added
    return done


def left_behind(
    spark: SparkSession, source: DataFrame, target: str, column: str, last: Watermark
) -> DataFrame:
    """What a range sync up to ``last`` does not bring over, in one row: ``null_rows`` without a sync
    value, and ``late_rows`` that arrived at or below the watermark and that the target lacks."""
    kind = source.schema[column].dataType
    value = F.col(identifier(column))
    present = table_or_empty(spark, target, source.schema)
    behind = source.where(value <= last.column(kind))
    clean = clean_text(column)
    if clean in present.columns:
        present = present.where(F.col(identifier(clean)) <= last.column(present.schema[clean].dataType))
    late = find_differences(behind, present).copies(MISSING)
    nulls = source.agg(F.count_if(value.isNull()).alias("null_rows"))
    return nulls.withColumn("late_rows", F.lit(late).cast("bigint"))


def _append_missing(
    spark: SparkSession, found: Differences, target: str, route: str, top: Watermark | None
) -> Outcome:
    missing = found.copies(MISSING)
    added = append_evolving(spark, found.missing().hint("rebalance"), target) if missing else []
    return Outcome(route, missing, top, added)


def _digest_route(
    spark: SparkSession, source: DataFrame, target: str, column: str | None
) -> Outcome:
    if source.limit(1).isEmpty():
        return Outcome("digest")
    present = table_or_empty(spark, target, source.schema)
    if present.limit(1).isEmpty():
        return _load(spark, source, target, column, "load")
    if not shared_columns(source, present):
        return Outcome("no_shared_column")
    top = _top(source, column)
    return _append_missing(spark, find_differences(source, present), target, "digest", top)


def last_watermarks(state: DataFrame, server: str, database: str) -> dict[str, Watermark]:
    """Watermark per ``schema.table`` of one database: one small row per table."""
    rows = (
        matching(state, server_name=server, database_name=database)
        .where(F.col("last_pk_value").isNotNull())
        .select("schema_name", "table_name", "last_pk_value", "last_pk_type")
        .collect()
    )
    return {
        f"{r.schema_name}.{r.table_name}": Watermark(r.last_pk_value, r.last_pk_type)
        for r in rows
    }


def sync_database(
    spark: SparkSession,
    ledger: str,
    server: str,
    database: str,
    tables: Mapping[str, SourceTable],
    sync_columns: Mapping[str, str] | None = None,
    target_root: str | None = None,
    at_once: int = 4,
    keys: DataFrame | None = None,
    header_root: str | None = None,
    batch_rows: int | None = None,
) -> DataFrame:
    """Bring every table of a database up to date: in full the first time, then
    incrementally. Gives one outcome row per table, as appended to the ledger.

    With ``batch_rows`` a table's backlog is appended in batches, each with a ledger row of
    its own, so a run that dies goes on after the last batch.

    Without ``sync_columns`` each table's own columns decide, by the rule of
    ``choose_sync_column``; ``keys`` lists key columns (table_name, column_name,
    pk_position) with tables named as in ``tables``. Two tables with one target both fail.
    With ``header_root`` a header-only file per table shows which columns were seen.
    Outcomes are appended ``LEDGER_BATCH`` at a time as tables finish; one that a crash
    loses is found again by the next run, which compares before it appends.

    Tables are independent Spark jobs, ``at_once`` of them at a time; one that
    fails leaves an outcome with its error and does not stop the others. A table
    given as a function is opened inside its own job, so a source that cannot be
    opened is such a failure too.
    """
    source = SourceDatabase(server, database, tables, sync_columns, keys)
    prepared = _prepared(spark, ledger, source, target_root, header_root, batch_rows)
    return _outcome_frame(spark, _run_all(spark, ledger, [prepared], at_once))


@dataclass
class _Prepared:
    """A database whose tables are ready to run."""

    source: SourceDatabase
    sync_type: str
    run: Callable[[str], dict[str, object]]
    #: Tables to run, with how many rows the last run of each wrote.
    tables: dict[str, int]
    outcomes: list[dict[str, object]] = field(default_factory=list)

    def database_row(self) -> dict[str, object]:
        failed = [o for o in self.outcomes if o["sync_status"] == "FAILED"]
        return _database_row(self.source, self.sync_type, str(failed[0]["error"]) if failed else None, bool(failed))

    def log_row(self) -> dict[str, object]:
        good = sum(o["sync_status"] != "FAILED" for o in self.outcomes)
        status = "COMPLETED" if good == len(self.outcomes) else "FAILED"
        details = f"{self.source.database}: {good} of {len(self.outcomes)} tables"
        return {"server_name": self.source.server, "sync_time": _now(), "status": status, "details": details}


def _database_row(source: SourceDatabase, sync_type: str | None, error: str | None, failed: bool) -> dict[str, object]:
    return {
        "server_name": source.server,
        "database_name": source.database,
        "sync_type": sync_type,
        "sync_status": "FAILED" if failed else "COMPLETED",
        "error": error,
        "updated_at": _now(),
    }


def _prepared(
    spark: SparkSession,
    ledger: str,
    source: SourceDatabase,
    target_root: str | None,
    header_root: str | None,
    batch_rows: int | None,
) -> _Prepared:
    server, database, tables = source.server, source.database, source.tables
    ensure_namespace(spark, namespace_text(server, database), target_root)
    known = matching(
        database_state(state_rows(spark, ledger, DATABASE_RUNS)),
        server_name=server,
        database_name=database,
    )
    sync_type = "full" if known.isEmpty() else "incremental"
    runs = matching(state_rows(spark, ledger, TABLE_RUNS), server_name=server, database_name=database)
    last = last_watermarks(table_state(runs), server, database)
    sizes = runs.groupBy(*TABLE_KEY).agg(F.max_by("rows_written", "updated_at").alias("n")).collect()
    moved = {f"{r.schema_name}.{r.table_name}": r.n or 0 for r in sizes}
    chosen = [name for name in tables if not is_system_table(name)]

    clashes = {
        name: target
        for target, names in shared_targets(server, database, chosen).items()
        for name in names
    }
    pk = {} if source.keys is None else _key_columns(source.keys)

    def run(name: str) -> dict[str, object]:
        schema, table = split_text(name)
        target = target_table(server, database, name)
        row: dict[str, object] = {
            "server_name": server,
            "database_name": database,
            "schema_name": schema,
            "table_name": table,
            "sync_status": "COMPLETED",
            "error": None,
        }
        try:
            if name in clashes:
                raise ValueError(f"other tables have the target {clashes[name]} too")
            given = tables[name]
            frame = given if isinstance(given, DataFrame) else given()
            if source.sync_columns is None:
                column = sync_column_of(frame, pk.get(name, ()))
            else:
                column = source.sync_columns.get(name)
            if sync_type == "full" and not spark.catalog.tableExists(target):
                done = full_sync(spark, frame, target, column)
            else:
                done = incremental_sync(
                    spark, frame, target, column, last.get(".".join(split_text(name))), batch_rows,
                    lambda batch: append_rows(spark, ledger, TABLE_RUNS, [row | _done(batch) | {"updated_at": _now()}]),
                )
            if header_root is not None:
                write_header(frame, f"{header_root}/{database}/{table}")
            row |= _done(done)
        except Exception as problem:  # the outcome row carries it
            row |= {"sync_status": "FAILED", "error": str(problem), "rows_written": 0}
        return row | {"updated_at": _now()}

    return _Prepared(source, sync_type, run, {name: moved.get(".".join(split_text(name)), 0) for name in chosen})


def _run_all(
    spark: SparkSession, ledger: str, databases: Sequence[_Prepared], at_once: int
) -> list[dict[str, object]]:
    """Run the tables of all databases from one pool, those first whose last runs wrote most.

    Each database has a scheduler pool of its own, so where the session shares fairly no
    database waits for another one's large table. Ledger rows wait for one another: those of
    tables are appended before the row of a database whose last table is done.
    """

    @inheritable_thread_target(spark)
    def run(database: _Prepared, name: str) -> tuple[_Prepared, dict[str, object]]:
        pool = namespace_text(database.source.server, database.source.database)
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", pool)
        return database, database.run(name)

    waiting: list[dict[str, object]] = []
    ended: list[_Prepared] = [d for d in databases if not d.tables]

    def flush() -> None:
        append_rows(spark, ledger, TABLE_RUNS, waiting)
        append_rows(spark, ledger, DATABASE_RUNS, [d.database_row() for d in ended])
        append_rows(spark, ledger, RUN_LOG, [d.log_row() for d in ended])
        waiting.clear()
        ended.clear()

    work = sorted(((d, name) for d in databases for name in d.tables), key=lambda w: -w[0].tables[w[1]])
    with ThreadPoolExecutor(max_workers=at_once) as pool:
        for future in as_completed([pool.submit(run, *w) for w in work]):
            database, row = future.result()
            database.outcomes.append(row)
            waiting.append(row)
            if len(database.outcomes) == len(database.tables):
                ended.append(database)
            if len(waiting) == LEDGER_BATCH:
                flush()
    flush()
    return [row for d in databases for row in d.outcomes]


def _done(outcome: Outcome) -> dict[str, object]:
    """The part of a ledger row that an outcome fills."""
    row: dict[str, object] = {
        "route": outcome.route,
        "rows_written": outcome.rows_written,
        "added_columns": ",".join(outcome.added_columns) or None,
    }
    if outcome.watermark:
        row |= {"last_pk_value": outcome.watermark.text, "last_pk_type": outcome.watermark.type}
    return row


def _key_columns(keys: DataFrame) -> dict[str, list[str]]:
    """Key columns by table, in key order: a few rows per table."""
    found: dict[str, list[str]] = {}
    for r in keys.orderBy("table_name", "pk_position").collect():
        found.setdefault(r.table_name, []).append(r.column_name)
    return found


def sync_column_of(source: DataFrame, keys: Sequence[str] = ()) -> str | None:
    """The sync column of one table by the rule of ``choose_sync_column``: the first key
    column, else a time, else an identifier, each by name."""
    times, ids = [], []
    for f in source.schema:
        kind = re.sub("_(ntz|ltz)$", "", f.dataType.simpleString())
        times += [f.name] * (kind in TIME_TYPES)
        ids += [f.name] * (kind in ID_TYPES)
    own = [k for k in keys if k in source.columns]
    return next(iter([*own[:1], *sorted(times), *sorted(ids)]), None)


@dataclass(frozen=True)
class SourceDatabase:
    """One database to bring up to date: its tables by ``schema.table`` and the
    sync column of those that have one (without, each table's own columns decide)."""

    server: str
    database: str
    tables: Mapping[str, SourceTable]
    sync_columns: Mapping[str, str] | None = None
    keys: DataFrame | None = None


def catalog_database(
    spark: SparkSession, server: str, namespace: str, keys: DataFrame | None = None
) -> SourceDatabase:
    """A source database by its catalog listing, system tables left out. Tables are opened
    when their turn comes."""
    listed = user_tables(catalog_listing(spark, [namespace])).collect()  # names, not rows
    opens = {
        f"{DEFAULT_SCHEMA}.{r.table_name}": partial(spark.table, identifier(namespace, r.table_name))
        for r in listed
    }
    return SourceDatabase(server, namespace, opens, keys=keys)


def sync_fleet(
    spark: SparkSession,
    ledger: str,
    sources: Iterable[SourceDatabase],
    skip: Mapping[str, Iterable[str]] | None = None,
    target_root: str | None = None,
    at_once: int = 4,
    header_root: str | None = None,
) -> DataFrame:
    """Bring every database of every server up to date, system databases and the
    ones a server skips left out. Gives the outcome rows of all tables.

    The tables of all databases share one pool of ``at_once`` jobs. A database that cannot be
    prepared is a failed run in the ledger and stops no other. Each server's run is noted in
    the job ledger, as running when it begins and with its outcome when it ends.
    """
    wanted = [
        s
        for s in sources
        if s.database not in SYSTEM_DATABASES and s.database not in set((skip or {}).get(s.server, ()))
    ]
    started = _now()
    servers = list(dict.fromkeys(s.server for s in wanted))
    _note_jobs(spark, ledger, {s: ("RUNNING", None) for s in servers}, started)
    prepared, broken = [], []
    for source in wanted:
        try:
            prepared.append(_prepared(spark, ledger, source, target_root, header_root, None))
        except Exception as problem:  # the database's row carries it
            broken.append(_database_row(source, None, str(problem), True))
    append_rows(spark, ledger, DATABASE_RUNS, broken)
    outcomes = _run_all(spark, ledger, prepared, at_once)
    errors: dict[str, str] = {}
    for row in [*broken, *outcomes]:
        if row["sync_status"] == "FAILED":
            errors.setdefault(str(row["server_name"]), str(row["error"]))
    ends = {s: ("FAILED" if s in errors else "COMPLETED", errors.get(s)) for s in servers}
    _note_jobs(spark, ledger, ends, started)
    return _outcome_frame(spark, outcomes)


#: The type of a fleet's runs in the job ledger.
FLEET_JOB = "sync"


def _note_jobs(
    spark: SparkSession, ledger: str, status: Mapping[str, tuple[str, str | None]], started: datetime
) -> None:
    entries = [
        {"server_name": server, "job_type": FLEET_JOB, "last_run": started, "status": now, "error": error, "created_at": _now()}
        for server, (now, error) in status.items()
    ]
    append_rows(spark, ledger, JOB_RUNS, entries)


_OUTCOME = """server_name string, database_name string, schema_name string, table_name string,
    route string, rows_written bigint, last_pk_value string, sync_status string, error string,
    added_columns string"""


def _outcome_frame(spark: SparkSession, outcomes: Iterable[Mapping[str, object]]) -> DataFrame:
    schema = T.DataType.fromDDL(_OUTCOME)
    return spark.createDataFrame([tuple(o.get(f.name) for f in schema) for o in outcomes], schema)


def tables_processed(outcomes: DataFrame) -> DataFrame:
    """How many tables moved rows, of how many."""
    return outcomes.groupBy("server_name", "database_name").agg(
        F.count_if(F.col("rows_written") > 0).alias("processed"), F.count("*").alias("tables")
    )


def _now() -> datetime:
    return datetime.now(timezone.utc).replace(tzinfo=None)
