from __future__ import annotations

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from twinkeep.functions.digest import DIGEST, only_digest, own_columns
from twinkeep.streaming import incremental, known

SCHEMA = "k bigint, v string"


def deliver(spark, inbox, *rows):
    spark.createDataFrame(list(rows), SCHEMA).coalesce(1).write.mode("append").parquet(inbox)


def target_rows(spark, target, schema):
    rows = incremental.read_target(spark, target, schema)
    rows = rows.drop(incremental.RUN, incremental.BATCH).collect()
    return sorted((tuple(r) for r in rows), key=str)


def test_restart_adds_nothing_and_overlap_adds_only_new_rows(spark, folder):
    inbox, target, checkpoint = f"{folder}/in", f"{folder}/out", f"{folder}/state"
    schema = spark.createDataFrame([], SCHEMA).schema

    def drain():
        incremental.append_new_files(spark, inbox, schema, target, checkpoint, True, "k")
        return target_rows(spark, target, schema)

    deliver(spark, inbox, (1, "a"), (1, "a"), (None, "n"))
    assert drain() == [(1, "a"), (None, "n")]
    assert len(drain()) == 2
    deliver(spark, inbox, (1, "a"), (1, "b"), (None, "n"), (9, "c"))
    assert drain() == [(1, "a"), (1, "b"), (9, "c"), (None, "n")]


def test_a_backlog_is_cut_into_batches(spark, folder):
    inbox, target, checkpoint = f"{folder}/in", f"{folder}/out", f"{folder}/state"
    schema = spark.createDataFrame([], SCHEMA).schema
    for key in (1, 1, 2):
        deliver(spark, inbox, (key, "a"))
    incremental.append_new_files(
        spark, inbox, schema, target, checkpoint, True, files_per_batch=1
    )
    batches = incremental.read_target(spark, target, schema)
    assert target_rows(spark, target, schema) == [(1, "a"), (2, "a")]
    assert batches.select(incremental.BATCH).distinct().count() == 2


def test_plain_append_keeps_copies(spark, folder):
    inbox, target, checkpoint = f"{folder}/in", f"{folder}/out", f"{folder}/state"
    schema = spark.createDataFrame([], SCHEMA).schema
    deliver(spark, inbox, (1, "a"), (1, "a"))
    incremental.append_new_files(spark, inbox, schema, target, checkpoint)
    deliver(spark, inbox, (1, "a"))
    incremental.append_new_files(spark, inbox, schema, target, checkpoint)
    assert len(target_rows(spark, target, schema)) == 3


def test_a_replayed_batch_writes_the_same_rows(spark, folder):
    """A crash after the write and before the commit repeats the batch."""
    inbox, target, checkpoint = f"{folder}/in", f"{folder}/out", f"{folder}/state"
    schema = spark.createDataFrame([], SCHEMA).schema
    deliver(spark, inbox, (1, "a"))
    incremental.append_new_files(spark, inbox, schema, target, checkpoint, True)
    deliver(spark, inbox, (1, "a"), (2, "b"))
    incremental.append_new_files(spark, inbox, schema, target, checkpoint, True)
    for name in ("1", ".1.crc"):
        (Path(checkpoint.removeprefix("file:")) / "commits" / name).unlink(missing_ok=True)
    incremental.append_new_files(spark, inbox, schema, target, checkpoint, True)
    assert target_rows(spark, target, schema) == [(1, "a"), (2, "b")]


@pytest.mark.parametrize("drop_known", [True, False])
def test_a_new_checkpoint_keeps_the_target(spark, folder, drop_known):
    inbox, target = f"{folder}/in", f"{folder}/out"
    schema = spark.createDataFrame([], SCHEMA).schema
    deliver(spark, inbox, *[(k, "a") for k in range(10)])
    incremental.append_new_files(spark, inbox, schema, target, f"{folder}/one", drop_known)
    fresh = f"{folder}/in2"
    deliver(spark, fresh, (9, "a"), (10, "b"), (11, "c"))
    incremental.append_new_files(spark, fresh, schema, target, f"{folder}/two", drop_known)
    expected = [(k, "a") for k in range(10)] + [(10, "b"), (11, "c")]
    if not drop_known:
        expected.append((9, "a"))
    assert sorted(target_rows(spark, target, schema)) == sorted(expected)


def garble(target, batch):
    """Make the files of a batch unreadable."""
    for file in Path(target.removeprefix("file:")).glob(f"run=*/batch={batch}/*.parquet"):
        file.write_bytes(b"not parquet")
        file.with_name(f".{file.name}.crc").unlink(missing_ok=True)


def test_only_folders_that_may_hold_a_row_are_read(spark, folder):
    inbox, target, checkpoint = f"{folder}/in", f"{folder}/out", f"{folder}/state"
    schema = spark.createDataFrame([], SCHEMA).schema

    def drain():
        incremental.append_new_files(spark, inbox, schema, target, checkpoint, True)

    for low in (0, 100, 200):
        deliver(spark, inbox, *[(k, "a") for k in range(low, low + 100)], (low, None))
        drain()
    garble(target, 0)
    garble(target, 2)
    deliver(spark, inbox, (150, "a"), (100, None), (300, "b"), (301, None))
    drain()
    last = incremental.read_target(spark, target, schema).where("batch = 3")
    assert {(r.k, r.v) for r in last.collect()} == {(300, "b"), (301, None)}


def test_folders_without_a_filter_of_this_schema_are_read(spark, folder):
    """Batches written without drop_known, or before a column was added."""
    target = f"{folder}/out"
    narrow = spark.createDataFrame([], SCHEMA).schema
    deliver(spark, f"{folder}/plain", (1, "a"), (1, "a"))
    incremental.append_new_files(spark, f"{folder}/plain", narrow, target, f"{folder}/one")
    deliver(spark, f"{folder}/known", (2, "b"), (1, "a"))
    incremental.append_new_files(spark, f"{folder}/known", narrow, target, f"{folder}/two", True)
    wide = spark.createDataFrame([], f"{SCHEMA}, w double").schema
    rows = spark.createDataFrame([(1, "a", None), (2, "b", None), (2, "b", 1.0)], wide)
    rows.write.parquet(f"{folder}/wide")
    incremental.append_new_files(spark, f"{folder}/wide", wide, target, f"{folder}/three", True)
    found = incremental.read_target(spark, target, wide).collect()
    assert sorted((r.k, r.v, r.w or 0.0) for r in found) == [
        (1, "a", 0.0), (1, "a", 0.0), (2, "b", 0.0), (2, "b", 1.0)
    ]


def test_more_folders_than_are_named(spark, folder, monkeypatch):
    monkeypatch.setattr(incremental, "NAMED_FOLDERS", 1)
    inbox, target, checkpoint = f"{folder}/in", f"{folder}/out", f"{folder}/state"
    schema = spark.createDataFrame([], SCHEMA).schema
    for rows in ([(1, "a")], [(2, "a")], [(1, "a"), (2, "a"), (3, "a")]):
        deliver(spark, inbox, *rows)
        incremental.append_new_files(spark, inbox, schema, target, checkpoint, True)
    assert target_rows(spark, target, schema) == [(1, "a"), (2, "a"), (3, "a")]


@pytest.mark.parametrize("rows", [0, 1, 32, 33, 20_000])
def test_filters_miss_no_row_and_hit_few_others(spark, folder, rows):
    table = spark.range(rows).selectExpr("id AS k", "CAST(id AS STRING) AS v")
    strange = spark.range(10**6, 10**6 + 20_000).selectExpr("id AS k", "CAST(id AS STRING) AS v")
    own, other = (only_digest(t, own_columns(t)).select(*DIGEST) for t in (table, strange))
    table.write.parquet(f"{folder}/out/run=r/batch=0")
    known.write_filter(own, rows, f"{folder}/out", table.schema, "r", 0)
    filters = known.read_filters(spark, f"{folder}/out", table.schema)
    for part in range(3):
        some = own.where(F.pmod(DIGEST[0], F.lit(3)) == part)
        hit = known._hit(some, some.count(), filters).count()
        assert hit == (some.count() > 0)
    sizes = filters.select("blocks").distinct().collect()
    assert len(sizes) <= 1
    wrong = sum(known._hit(other.where(F.pmod(DIGEST[0], F.lit(8)) == p), 2500, filters).count() for p in range(8))
    assert wrong <= 1
