from __future__ import annotations

import weakref

import numpy as np
import pyarrow as pa
import pytest

from twinkeep.llm import rows


@pytest.mark.parametrize("size", [4, 1000])
def test_batches_are_small_whatever_the_session_sends(spark, monkeypatch, size):
    """The caller of a lazy result decides how many rows the session sends, so operators divide them."""
    monkeypatch.setattr(rows, "BATCH_ROWS", size)
    texts = [(k, None if k % 7 == 0 else f"é{k}" * (k % 5)) for k in range(2500)]
    frame = spark.createDataFrame(texts, "k long, text string").coalesce(1)

    def make(limit=size):
        rows.BATCH_ROWS = limit  # tasks import the module themselves

        def work(values: pa.Array):
            data, at = rows.utf8(values)
            words = [data[at[i] : at[i + 1]].tobytes().decode() for i in range(len(values))]
            return [pa.array([len(values)] * len(values), pa.int32()), pa.array(words, pa.string())]

        return work

    fields = "n int, word string"
    for got in (rows.append(frame, ["text"], make, fields), rows.generate(frame, ["text"], make, fields)):
        found = got.collect()
        assert [r.word for r in found] == [t or "" for _, t in texts]
        assert max(r.n for r in found) == size
    kept = rows.append(frame, ["text"], make, fields).select("k", "text").collect()
    assert [tuple(r) for r in kept] == texts


def test_a_batch_is_gone_before_the_next_is_read():
    """Workers of long sessions keep the most that they ever held, so two batches at once count for good."""
    made, alive = [], []

    def batch(n):
        out = pa.record_batch({"k": pa.array(range(n))})
        made.append(weakref.ref(out))
        return out

    def sent():
        for n in (2500, 2 * rows.BATCH_ROWS, 7, 0, 3000):
            alive.append(sum(x() is not None and x().num_rows > rows.BATCH_ROWS for x in made))
            yield batch(n)

    got = [part.column("k").to_pylist() for part in rows._parts(sent())]
    assert alive == [0] * 5
    assert sum(got, []) == [k for n in (2500, 2 * rows.BATCH_ROWS, 7, 0, 3000) for k in range(n)]


def test_chunks_hold_every_row_once():
    at = np.cumsum([0, 10, 0, 300, 5, 5, 5, 0])
    for size in (1, 10, 20, 1000, None):
        found = list(rows.chunks(at, size))
        assert [low for low, _ in found] == [0, *[high for _, high in found[:-1]]] and found[-1][1] == 7
        assert all(high == low + 1 or at[high] - at[low] <= (size or rows.CHUNK_BYTES) for low, high in found)


def test_a_stored_job_has_its_own_bounds(spark):
    keys = [rows._BATCH, rows._BATCH_BYTES, rows._READ]
    before = [spark.conf.get(k) for k in keys]
    frame = spark.range(5000).selectExpr("id", "repeat('x', 1000) AS text").coalesce(1)
    read = lambda n: rows.generate(frame, ["text"], lambda: lambda t: [[t.nbytes]], "n long") if n else frame
    sizes = [r.n for r in rows.stored(read(1), "sizes", batch_bytes=100_000, read_rows=7).collect()]
    assert sum(sizes) > 5_000_000 and max(sizes) < 200_000
    assert rows.stored(read(0), "rows", batch_rows=3).count() == 5000
    with pytest.raises(Exception, match="no such"):
        rows.stored(frame.selectExpr("raise_error('no such') AS x"), "none", 1, 1, 1)
    assert [spark.conf.get(k) for k in keys] == before


def test_a_bound_is_never_above_the_setting():
    assert [rows._least(x, 500) for x in ("10000", "67108864b", "200", "200b", "64m", "-1")] == [500, 500, 200, 200, 500, 500]
