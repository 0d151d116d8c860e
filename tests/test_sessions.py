"""Sessions of runs against a plain walk over each database's runs."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from twinkeep.operators import sessions

KIND = "run_id long, server_name string, database_name string, sync_status string, error string, updated_at timestamp_ntz"
GAP = timedelta(minutes=30)


def walk(runs):
    out = []
    by = {}
    for r in runs:
        if r[5] is not None:
            by.setdefault((r[1], r[2]), []).append(r)
    for key, own in by.items():
        own.sort(key=lambda r: (r[5], r[0]))
        groups = [[own[0]]]
        for r in own[1:]:
            if r[5] - groups[-1][-1][5] <= GAP:
                groups[-1].append(r)
            else:
                groups.append([r])
        for g in groups:
            bad = [not (r[3] in (None, "", "COMPLETED") or "WARNING" in r[3]) for r in g]
            outcome = "unfinished" if bad[-1] else "recovered" if any(bad) else "completed"
            out.append((*key, g[0][5], g[-1][5], len(g), sum(bad), outcome))
    return sorted(out, key=str)


def test_against_a_walk(spark):
    rng = random.Random(8)
    begin = datetime(2024, 1, 1)
    runs = []
    for k in range(600):
        minutes = rng.choice((rng.randrange(3000), 30 * rng.randrange(100)))
        status = rng.choice(("FAILED", "RUNNING", "COMPLETED", "COMPLETED", "WARNING_ROWS", None, ""))
        at = None if k % 97 == 0 else begin + timedelta(minutes=minutes)
        runs.append((k, f"s{k % 2}", f"d{rng.randrange(6)}" if k % 3 else "hot", status, None, at))
    frame = spark.createDataFrame(runs, KIND)
    columns = ("server_name", "database_name", "started_at", "finished_at", "runs", "runs_not_completed", "outcome")
    found = sessions.sessions_of_runs(frame.repartition(5)).collect()
    assert sorted([tuple(r[c] for c in columns) for r in found], key=str) == walk(runs)
    assert len({r.session_id for r in found}) == len(found)


def test_newest_n_and_a_restart(spark):
    """The same sessions when the newest runs arrive in a second append."""
    begin = datetime(2024, 1, 1)
    runs = [(k, "s", "d", "FAILED" if k % 4 == 1 else "COMPLETED", None, begin + timedelta(minutes=20 * k + 60 * (k // 5))) for k in range(50)]
    whole = spark.createDataFrame(runs, KIND)
    parts = spark.createDataFrame(runs[:23], KIND).unionByName(spark.createDataFrame(runs[23:], KIND))
    for n in (1, 4, 100):
        a, b = (sorted(map(str, sessions.newest_sessions(f, n).collect())) for f in (whole, parts))
        assert a == b and len(a) == min(n, 10)
    assert sessions.newest_sessions(whole.limit(0)).count() == 0
    assert sessions.sessions_of_runs(whole).agg(F.sum("runs")).first()[0] == 50
