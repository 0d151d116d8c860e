"""Columns computed from whole texts, one Arrow batch at a time.

``append`` keeps every column and row of its input, so no join back by an id is
needed: null ids, repeated rows and extra columns pass through as they are.
"""

from __future__ import annotations

import os
import shutil
import tempfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinkeep.session import work_path

#: Bytes of text worked on at a time; a longer text is worked on alone.
CHUNK_BYTES = 1 << 20
#: The same for work that holds many numbers per byte of text.
SMALL_CHUNK_BYTES = 1 << 18


def append(
    frame: DataFrame, inputs: list[str], make: Callable[[], Callable], fields: str
) -> DataFrame:
    """``frame`` with the columns ``fields`` (DDL), computed from ``inputs``.

    ``make()`` is called once per task and returns a function from the input
    columns of a batch (Arrow arrays) to the new columns, in order. A column of
    ``frame`` that bears the name of a new one is replaced. A batch has ``BATCH_ROWS``
    rows at most, whatever the session sends.
    """
    new = T._parse_datatype_string(fields)
    names = {f.name.lower() for f in new.fields}
    kept = frame.drop(*[c for c in frame.columns if c.lower() in names and c not in inputs])
    clash = {c for c in inputs if c.lower() in names}
    if clash:
        kept = kept.withColumnsRenamed({c: f"__in_{c}" for c in clash})
    read = [f"__in_{c}" if c in clash else c for c in inputs]
    schema = T.StructType(kept.schema.fields + new.fields)
    ship(frame.sparkSession)
    arrow = [_arrow(f.dataType) for f in new.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in _parts(batches):
            out = work(*[batch.column(batch.schema.get_field_index(c)) for c in read])
            cols = [_cast(x, t) for x, t in zip(out, arrow, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *cols], [*batch.schema.names, *(f.name for f in new.fields)]
            )

    return kept.mapInArrow(run, schema).drop(*[f"__in_{c}" for c in clash])


def generate(
    frame: DataFrame, inputs: list[str], make: Callable[[], Callable], fields: str
) -> DataFrame:
    """Rows of the columns ``fields`` alone, any number per batch of ``BATCH_ROWS`` rows at most."""
    schema = T._parse_datatype_string(fields)
    ship(frame.sparkSession)
    arrow = [_arrow(f.dataType) for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in _parts(batches):
            out = work(*[batch.column(batch.schema.get_field_index(c)) for c in inputs])
            yield pa.RecordBatch.from_arrays(
                [_cast(x, t) for x, t in zip(out, arrow, strict=True)], schema.names
            )
        end = getattr(work, "end", None)
        if end:
            out = end()
            yield pa.RecordBatch.from_arrays(
                [_cast(x, t) for x, t in zip(out, arrow, strict=True)], schema.names
            )

    return frame.select(*inputs).mapInArrow(run, schema)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of ``BATCH_ROWS`` at most, each with buffers of its own.

    How many rows the session sends is decided when the caller runs the job. Results, and
    what is held while they are made, follow these parts.
    """
    for batch in batches:
        if batch.num_rows <= BATCH_ROWS:
            yield batch
            continue
        for low in range(0, batch.num_rows, BATCH_ROWS):
            yield batch.take(pa.array(np.arange(low, min(low + BATCH_ROWS, batch.num_rows))))
        # Else it would stay until the next one is read, and its pages in the pool for good.
        del batch
        pa.default_memory_pool().release_unused()


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the tasks of a session this package, wherever the session was started."""
    context, package = spark.sparkContext, Path(__file__).resolve().parents[1]
    if context.applicationId in _SHIPPED or not package.is_dir():
        return
    folder = tempfile.mkdtemp(prefix="twinkeep-")
    archive = shutil.make_archive(f"{folder}/twinkeep", "zip", package.parent, package.name)
    context.addPyFile(os.path.realpath(archive))  # Spark serves it to the executors
    _SHIPPED.add(context.applicationId)


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def _cast(values: object, kind: pa.DataType) -> pa.Array:
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    if not isinstance(values, pa.Array):
        values = pa.array(values, type=kind)
    return values if values.type == kind else values.cast(kind)


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column and the bounds of its values; null counts as empty."""
    values = pc.fill_null(texts.cast(pa.large_string()), "")
    _, bounds, data = values.buffers()
    at = np.frombuffer(bounds, np.int64, len(values) + 1 + values.offset)[values.offset :]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, at


def chunks(at: np.ndarray, size: int | None = None) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``size`` (``CHUNK_BYTES``) bytes each, in order; every row once."""
    low, rows, size = 0, len(at) - 1, size or CHUNK_BYTES
    while low < rows:
        high = int(np.searchsorted(at, at[low] + size, side="right")) - 1
        high = min(max(high, low + 1), rows)
        yield low, high
        low = high


#: Rows per Arrow batch of jobs that stand between others in one long run: bounds the memory of Python
#: workers and of the buffers that executors exchange with them.
BATCH_ROWS = 1000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
_READ = "spark.sql.parquet.columnarReaderBatchSize"


def stored(
    frame: DataFrame, label: str, batch_rows: int | None = None, batch_bytes: int | None = None, read_rows: int | None = None
) -> DataFrame:
    """``frame`` written to the shared folder and read again: computed once, lineage cut.

    ``batch_rows`` and ``batch_bytes`` bound the Arrow batches of this job, ``read_rows`` what a
    task decodes of a Parquet file at once.
    """
    spark = frame.sparkSession
    path = work_path(spark, label)
    bounds = {_BATCH: batch_rows, _BATCH_BYTES: batch_bytes, _READ: read_rows}
    before = {k: spark.conf.get(k) for k, most in bounds.items() if most}
    try:
        for k, now in before.items():
            spark.conf.set(k, str(_least(now, bounds[k])))
        frame.write.parquet(path)
    finally:
        for k, now in before.items():
            spark.conf.set(k, now)
    return spark.read.schema(frame.schema).parquet(path)


def _least(setting: str, most: int) -> int:
    """``most``, or the number of a setting if that is less; other settings (with units) are no bound below it."""
    try:
        now = int(setting.rstrip("b"))
    except ValueError:
        return most
    return min(now, most) if now > 0 else most


class Covered:
    """``frame`` with every column under a neutral name, so that none clashes with a new one.

    ``inner`` is that frame, ``at(name)`` the neutral name of a column, ``back(result)``
    selects the columns under their own names again.
    """

    def __init__(self, frame: DataFrame):
        self.columns = frame.columns
        self.inner = frame.toDF(*[f"__c{k}" for k in range(len(self.columns))])

    def at(self, name: str) -> str:
        return f"__c{self.columns.index(name)}"

    def back(self, result: DataFrame) -> DataFrame:
        return result.select(*[F.col(f"__c{k}").alias(c) for k, c in enumerate(self.columns)])


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Jobs run inside read ``BATCH_ROWS`` rows per Arrow batch at most."""
    before = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, str(min(BATCH_ROWS, int(before))))
    try:
        yield
    finally:
        spark.conf.set(_BATCH, before)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold_of(column: str, folds: int):
    """The remainder of crc32 of an id written as text; null ids fall into fold 0."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % folds, F.lit(0))
