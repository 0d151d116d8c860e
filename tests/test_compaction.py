"""State of compacted ledgers, and the job ledger."""

from __future__ import annotations

import random
import threading
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from twinkeep.operators import compaction, sync
from twinkeep.operators.ledger import database_state, job_state, live_jobs, table_state
from twinkeep.sources.ledger_tables import (
    DATABASE_RUNS,
    JOB_RUNS,
    RUN_LOG,
    SNAPSHOTS,
    TABLE_RUNS,
    append_rows,
    create_ledgers,
)

STATE = {DATABASE_RUNS: database_state, TABLE_RUNS: table_state, JOB_RUNS: job_state}


def some_rows(seed: int, n: int) -> dict[str, list[dict]]:
    rng = random.Random(seed)
    out = {name: [] for name in STATE}
    for k in range(n):
        at = None if rng.random() < 0.1 else datetime(2024, 1, 1) + timedelta(hours=rng.randint(0, 30))
        base = {"server_name": f"s{rng.randint(0, 1)}", "updated_at": at, "created_at": at}
        base |= {"error": rng.choice([None, "e"]), "status": rng.choice([None, "deleted", "ok"])}
        base |= {"sync_status": rng.choice([None, "FAILED", "COMPLETED", "RUNNING"]), "job_type": f"j{rng.randint(0, 2)}"}
        base |= {"database_name": f"d{rng.randint(0, 2)}", "schema_name": "dbo", "table_name": f"t{rng.randint(0, 3)}"}
        base |= {"sync_type": rng.choice(["full", "incremental"]), "last_pk_value": rng.choice([None, str(k)])}
        for name in STATE:
            out[name].append(base)
    return out


def states(spark, namespace, rows_of):
    return {n: sorted(map(str, STATE[n](rows_of(n)).collect())) for n in STATE}


def test_state_is_the_same_at_every_step(spark, namespace, folder):
    create_ledgers(spark, namespace)

    def whole(name):
        return spark.table(f"{namespace}.{name}")

    def short(name):
        return compaction.state_rows(spark, namespace, name)

    for step in range(3):
        for part in range(2):
            for name, rows in some_rows(2 * step + part, 40).items():
                append_rows(spark, namespace, name, rows)
        before = states(spark, namespace, whole)
        assert states(spark, namespace, short) == before
        for name in STATE:
            assert compaction.compact_ledger(spark, namespace, name, folder) == 2
            assert compaction.compact_ledger(spark, namespace, name, folder) == 0
        assert states(spark, namespace, short) == before == states(spark, namespace, whole)
        for name in STATE:
            assert short(name).count() <= 6 * STATE[name](whole(name)).count()
            assert step < 2 or short(name).count() < whole(name).count()
    assert whole(SNAPSHOTS).count() == 9 and whole(TABLE_RUNS).count() == 240


def test_a_compaction_that_dies_changes_nothing(spark, namespace, monkeypatch):
    create_ledgers(spark, namespace)
    append_rows(spark, namespace, TABLE_RUNS, some_rows(1, 30)[TABLE_RUNS])

    def dies(*given):
        raise RuntimeError("gone")

    with monkeypatch.context() as patched:
        patched.setattr(compaction, "append_rows", dies)
        with pytest.raises(RuntimeError, match="gone"):
            compaction.compact_ledger(spark, namespace, TABLE_RUNS)
    assert compaction.state_rows(spark, namespace, TABLE_RUNS).count() == 30
    assert compaction.compact_ledger(spark, namespace, TABLE_RUNS) == 1
    append_rows(spark, namespace, TABLE_RUNS, some_rows(2, 5)[TABLE_RUNS])
    tail = compaction.state_rows(spark, namespace, TABLE_RUNS)
    assert len([f for f in tail.inputFiles() if f"/{TABLE_RUNS}/" in f]) == 1
    with pytest.raises(ValueError, match="no state"):
        compaction.compact_ledger(spark, namespace, RUN_LOG)
    empty = f"{namespace}.{JOB_RUNS}"
    assert compaction.compact_ledger(spark, namespace, JOB_RUNS) == 0 and spark.table(empty).count() == 0


def test_runs_go_on_from_a_snapshot(spark, namespace, folder):
    create_ledgers(spark, namespace)

    def run(low, high):
        given = {"dbo.t": spark.range(low, high).withColumn("v", F.lit("x"))}
        return sync.sync_database(spark, namespace, f"s-{namespace}", "d", given, {"dbo.t": "id"}, folder).first()

    assert run(0, 5).rows_written == 5
    for name in (DATABASE_RUNS, TABLE_RUNS):
        compaction.compact_ledger(spark, namespace, name)
    second = run(0, 9)
    assert (second.route, second.rows_written, second.last_pk_value) == ("range", 4, "8")


def test_databases_of_a_fleet_overlap_and_a_broken_one_stops_none(spark, namespace, folder):
    create_ledgers(spark, namespace)
    meet = threading.Barrier(2, timeout=60)

    def opened():
        meet.wait()
        return spark.range(3)

    def unreadable():
        raise OSError("no such table")

    server, other = f"s-{namespace}", f"o-{namespace}"
    sources = [
        sync.SourceDatabase(server, "one", {"dbo.t": opened}),
        sync.SourceDatabase(other, "two", {"dbo.t": opened, "dbo.u": unreadable}),
        sync.SourceDatabase(server, "three", {"dbo.t": spark.range(1)}, keys=spark.range(1)),
        sync.SourceDatabase(server, "four", {}),
    ]
    done = {(r.database_name, r.table_name): r for r in sync.sync_fleet(spark, namespace, sources, target_root=folder, at_once=2).collect()}
    assert {k: r.sync_status for k, r in done.items()} == {("one", "t"): "COMPLETED", ("two", "t"): "COMPLETED", ("two", "u"): "FAILED"}
    state = {r.database_name: r for r in database_state(spark.table(f"{namespace}.{DATABASE_RUNS}")).collect()}
    assert {k: r.sync_status for k, r in state.items()} == {"one": "COMPLETED", "two": "FAILED", "three": "FAILED", "four": "COMPLETED"}
    jobs = {r.server: r for r in live_jobs(job_state(spark.table(f"{namespace}.{JOB_RUNS}"))).collect()}
    assert {k: (r.type, r.status) for k, r in jobs.items()} == {server: ("sync", "FAILED"), other: ("sync", "FAILED")}
    assert "no such table" in jobs[other].error and spark.table(f"{namespace}.{JOB_RUNS}").count() == 4


def test_tables_that_wrote_most_come_first(spark, namespace, folder):
    create_ledgers(spark, namespace)
    order = []

    def opened(name, n):
        return lambda: order.append(name) or spark.range(n)

    given = {f"dbo.t{k}": opened(k, k + 1) for k in range(4)}
    for _ in range(2):
        sync.sync_database(spark, namespace, f"s-{namespace}", "d", given, target_root=folder, at_once=1)
    assert order == [0, 1, 2, 3, 3, 2, 1, 0]
