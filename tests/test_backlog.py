"""A backlog in batches: nothing doubled or lost, whatever the type, wherever a run dies."""

from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

from twinkeep.operators import sync
from twinkeep.operators.ledger import table_state
from twinkeep.sources.ledger_tables import TABLE_RUNS, create_ledgers

KINDS = {
    "long": "id",
    "int": "CAST(id / 7 AS INT)",
    "double": "CASE WHEN id = 500 THEN double('NaN') ELSE id / 3 END",
    "decimal": "CAST(id / 8 AS DECIMAL(12, 3))",
    "date": "date_add(date'2020-01-01', CAST(id / 5 AS INT))",
    "timestamp": "timestamp_seconds(id * 1001)",
    "timestamp_ntz": "CAST(timestamp_seconds(id * 1001) AS TIMESTAMP_NTZ)",
    "string": "lpad(CAST(CAST(id / 3 AS INT) AS STRING), 9, '0')",
    "binary": "CAST(lpad(CAST(CAST(id / 3 AS INT) AS STRING), 9, '0') AS BINARY)",
}


def made(spark, kind):
    return spark.range(2000).selectExpr("id", f"{KINDS[kind]} AS at").repartition(5)


def bag(frame):
    return Counter((r.id, str(r.at)) for r in frame.collect())


@pytest.mark.parametrize("kind", KINDS)
def test_batches_of_every_type(spark, namespace, kind):
    source, target = made(spark, kind), f"{namespace}.t"
    first = sync.full_sync(spark, source.where("id < 300"), target, "at")
    seen = []
    done = sync.incremental_sync(spark, source, target, "at", first.watermark, 300, seen.append)
    # NaN is above everything and never a watermark; ties with the first watermark are not beyond it.
    beyond = source.where(F.col("at") > first.watermark.column(source.schema["at"].dataType))
    if kind == "double":
        beyond = beyond.where("NOT isnan(at)")
    expected = bag(source.where("id < 300")) + bag(beyond)
    assert bag(spark.table(target)) == expected
    assert len(seen) >= 3
    marks = [o.watermark.column(source.schema["at"].dataType) for o in [*seen, done]]
    assert all(spark.range(1).select(a < b).first()[0] for a, b in zip(marks, marks[1:]))
    assert done.rows_before == sum(o.rows_written for o in seen)
    assert done.rows_before + done.rows_written == sum(bag(beyond).values())
    again = sync.incremental_sync(spark, source, target, "at", done.watermark, 300)
    assert again.rows_written == 0 or kind == "double"


@pytest.mark.parametrize("dies_at", [0, 1, 3])
def test_killed_between_data_and_commit(spark, namespace, dies_at):
    source, target = made(spark, "int"), f"{namespace}.t"
    first = sync.full_sync(spark, source.where("id < 300"), target, "at")
    kept = [first.watermark]

    def dies(batch):
        if len(kept) == dies_at + 1:
            raise InterruptedError
        kept.append(batch.watermark)

    with pytest.raises(InterruptedError):
        sync.incremental_sync(spark, source, target, "at", first.watermark, 200, dies)
    sync.incremental_sync(spark, source, target, "at", kept[-1], 200)
    beyond = source.where(F.col("at") > int(first.watermark.text))
    assert bag(spark.table(target)) == bag(source.where("id < 300")) + bag(beyond)


def test_one_value_larger_than_a_batch_stays_whole(spark, namespace):
    source = spark.range(1000).select("id", F.when(F.col("id") < 900, 5).otherwise(F.col("id")).alias("at"))
    target = f"{namespace}.t"
    sync.full_sync(spark, source.limit(0).unionByName(spark.createDataFrame([(-1, 1)], "id long, at long")), target, "at")
    seen = []
    sync.incremental_sync(spark, source, target, "at", sync.Watermark("1", "bigint"), 50, seen.append)
    assert spark.table(target).count() == 1001
    assert max(o.rows_written for o in seen) >= 900


def test_ledger_has_a_row_per_batch(spark, namespace):
    create_ledgers(spark, namespace)
    source = made(spark, "long")
    for given in (source.where("id < 300"), source):
        sync.sync_database(spark, namespace, "srv", "sales", {"dbo.t": given}, {"dbo.t": "at"}, batch_rows=400)
    runs = spark.table(f"{namespace}.{TABLE_RUNS}").orderBy("run_id").collect()
    assert [r.route for r in runs][0] in ("load", "full") and len(runs) >= 5
    assert sum(r.rows_written for r in runs) == 2000
    assert table_state(spark.table(f"{namespace}.{TABLE_RUNS}")).first().last_pk_value == "1999"


def test_rows_left_behind(spark, namespace):
    source, target = made(spark, "long"), f"{namespace}.t"
    done = sync.full_sync(spark, source.where("id < 300 AND id % 100 <> 7"), target, "at")
    frame = source.withColumn("at", F.when(F.col("id") % 500 != 2, F.col("at")))
    left = sync.left_behind(spark, frame, target, "at", done.watermark).first()
    assert (left.null_rows, left.late_rows) == (4, 3)
