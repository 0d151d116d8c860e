from __future__ import annotations

import math

import numpy as np

from tests.conftest import SMALL
from twinkeep.llm import quality, queries
from twinkeep.llm.rows import utf8

MEDIUM = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    found = queries.op7_quality_neighbours(spark, MEDIUM)
    labels = spark.read.parquet(f"{MEDIUM}/labels.parquet").select("doc_id", "quality")
    rows = found.where("held_out").join(labels, "doc_id").collect()
    assert sum(r.predicted == r.quality for r in rows) / len(rows) > 0.98
    assert found.count() == 10_000 and all(0 <= r.score <= 1 for r in rows)


def test_terms_match_a_plain_count():
    import pyarrow as pa

    texts = ["Two two WORDS!! ### a|b 12", None, "é É x9x", "a a b", "", "tail"]
    data, at = utf8(pa.array(texts))
    whole = quality.terms(data, at, 0, len(texts))
    for k, text in enumerate(texts):
        own, bounds = utf8(pa.array([text]))
        assert np.array_equal(whole[k], quality.terms(own, bounds, 0, 1)[0])
        assert whole[k].sum() == 2 * len((text or "").split())
    assert whole[3][quality.WORDS + quality._AGAIN] == 1


def test_votes_match_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = queries.quality_model(docs, spark, SMALL)
    rows = quality.score(docs.select("text"), model).collect()
    for row in rows[:60]:
        data, at = utf8(__import__("pyarrow").array([row.text]))
        mine = model.project(quality.terms(data, at, 0, 1))[0]
        near = [math.fsum(float(a) * float(b) for a, b in zip(mine, v)) for v in model.vectors]
        edge = sorted(near)[-min(quality.NEIGHBOURS, len(near))]
        votes = [(max(0, s) ** quality.SHARPNESS, y) for s, y in zip(near, model.labels) if s >= edge - 1e-6]
        top = sum(w * y for w, y in votes) + quality.PRIOR * model.base
        assert abs(row.score - top / (sum(w for w, _ in votes) + quality.PRIOR)) < 1e-3
        assert abs(row.nearest - max(near)) < 1e-4


def test_odd_rows(spark):
    labelled = [("fine words here", 1), ("fine words there", 1), ("### ###", 0), ("x", None), (None, 0), ("y", 5)]
    model = quality.train(spark.createDataFrame(labelled, "text string, quality int"))
    assert sorted(model.labels) == [0, 0, 1, 1]
    data = [(1, None, 2), (2, "", 2), (None, "### ###", 2), (3, "fine " * 90_000, 2), (3, "fine words here", 2)]
    docs = spark.createDataFrame(data, "doc_id long, text string, score int")
    rows = quality.score(docs, model).collect()
    assert rows[0].score == rows[1].score == 0.5
    assert rows[2].score < 0.5 < rows[4].score
    kept = quality.keep_good(docs, model, 0.6)
    assert kept.columns == docs.columns and all(r.score == 2 for r in kept.collect())
    assert quality.score(docs.limit(0), model).count() == 0
    none = quality.train(spark.createDataFrame([], "text string, quality int"))
    assert {r.score for r in quality.score(docs, none).collect()} == {0.0}


def test_votes_hold_little_memory():
    """A block of texts against all labelled vectors: what a worker holds, it keeps for a session."""
    import tracemalloc

    import pyarrow as pa

    rng = np.random.default_rng(3)
    vectors = rng.standard_normal((quality.SAMPLE, quality.DIMENSIONS)).astype(np.float32)
    axes = rng.standard_normal((quality.WORDS + quality.SHAPES, quality.DIMENSIONS)).astype(np.float32)
    weights, labels = np.ones(len(axes), np.float32), rng.integers(0, 2, len(vectors)).astype(np.float32)
    model = quality.Neighbours(vectors, labels, weights, axes, 0.5)
    data, at = utf8(pa.array([f"word{k} other{k} " * (k % 90) for k in range(1000)]))
    tracemalloc.start()
    for low, high in quality._slices(at):
        model.vote(quality.terms(data, at, low, high))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 40e6
