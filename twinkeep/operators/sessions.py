"""Sessions built from the run ledger: a run begins, is tried again, and ends."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinkeep.functions.fixed import RECENT_SESSIONS
from twinkeep.functions.status import epoch_millis, is_completed, millis_between
from twinkeep.operators.ledger import DATABASE_KEY, newest_per_key

#: Runs of a database that lie closer together belong to one session.
SESSION_GAP = "30 minutes"


def sessions_of_runs(runs: DataFrame, gap: str = SESSION_GAP) -> DataFrame:
    """One row per session of a database: runs of which each follows the one before within ``gap``.

    ``outcome`` is that of the newest run: ``completed``, ``recovered`` (completed after a run of the
    session that was not), or ``unfinished``. Sessions depend on the ledger alone, so a
    restart of whatever reads it changes nothing; a run that arrives late joins or merges sessions.
    Runs without a time belong to no session.
    """
    done = is_completed(F.col("sync_status"))
    newest = F.max_by(F.struct("sync_status", "error", done.alias("done")), F.struct("updated_at", "run_id"))
    found = (
        runs.where(F.col("updated_at").isNotNull())
        .groupBy(*DATABASE_KEY, F.session_window("updated_at", gap))
        .agg(
            F.min("updated_at").alias("started_at"),
            F.max("updated_at").alias("finished_at"),
            F.count("*").alias("runs"),
            F.count_if(~F.coalesce(done, F.lit(False))).alias("runs_not_completed"),
            newest.alias("_newest"),
        )
    )
    ended = F.coalesce(F.col("_newest.done"), F.lit(False))
    outcome = F.when(~ended, "unfinished").when(F.col("runs_not_completed") > 0, "recovered").otherwise("completed")
    return found.select(
        F.concat_ws(":", *DATABASE_KEY, epoch_millis(F.col("started_at")).cast("string")).alias("session_id"),
        *DATABASE_KEY,
        "started_at",
        "finished_at",
        millis_between(F.col("finished_at"), F.col("started_at")).alias("duration_ms"),
        "runs",
        "runs_not_completed",
        outcome.alias("outcome"),
        F.col("_newest.sync_status").alias("sync_status"),
        F.col("_newest.error").alias("error"),
    )


def newest_sessions(runs: DataFrame, n: int = RECENT_SESSIONS, gap: str = SESSION_GAP) -> DataFrame:
    """The newest ``n`` sessions of each database."""
    return newest_per_key(sessions_of_runs(runs, gap), DATABASE_KEY, ["finished_at"], n)
