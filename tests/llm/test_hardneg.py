"""Hard negatives against plain loops over all rows."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest

from twinkeep.llm import hardneg

KIND = "vec_id long, embedding array<double>, label int, row string, shelf string, anchor long, q string"


def brute(data, every=50, positives=5, negatives=3, low=50, high=95):
    rows = []
    for vec_id, vector, label in data:
        if label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        rows.append((vec_id, [max(-(2**63), min(2**63 - 1, math.floor(256 * x))) for x in vector], label))
    out = []
    place = lambda r: (-r[0], r[1] is None, r[1] or 0)
    for i, (a, q, label) in enumerate(rows):
        if a is None or a % every:
            continue
        scored = [(sum(x * y for x, y in zip(q, p)), b, own == label) for j, (b, p, own) in enumerate(rows) if j != i]
        for score, b, _ in sorted((s for s in scored if s[2]), key=place)[:positives]:
            fit = [s for s in scored if not s[2] and low * score <= 100 * s[0] <= high * score]
            for rank, s in enumerate(sorted(fit, key=place)[:negatives], 1):
                out.append((a, b, rank, s[1], score, s[0]))
    return sorted(out, key=str)


def found(spark, data, **more):
    frame = spark.createDataFrame([(*d, "x", "y", 1, "z") for d in data], KIND).repartition(5)
    return sorted([tuple(r) for r in hardneg.mine(frame, **more).collect()], key=str)


def vectors(rng, n, dims, labels, ids):
    centres = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(labels)]
    out = []
    for _ in range(n):
        label = 0 if rng.random() < 0.4 else rng.randrange(labels)
        out.append((rng.randrange(ids), [0.6 * c + rng.gauss(0, 0.7) for c in centres[rng.randrange(labels)]], label))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rng = random.Random(seed)
    data = vectors(rng, 500, 12, 4, 400)
    # Ties, null ids, lone labels, rows that take no part, short vectors, a zero vector.
    data += [data[3], data[3], (None, data[3][1], data[3][2]), (None, data[5][1], 2), (50, [0.5] * 12, 77)]
    data += [(100, None, 1), (150, [1.0] * 12, None), (200, [1.0, None], 1), (250, [float("nan")] * 12, 1)]
    data += [(300, [float("inf")] * 12, 1), (350, [1.0, 2.0], 1), (0, [], 2), (50, [0.0] * 12, 3), (-50, [-1.0] * 12, 3)]
    expected = brute(data)
    assert found(spark, data) == expected and len(expected) > 20
    narrow = {"every": 3, "positives": 2, "negatives": 6, "low": 10, "high": 70}
    assert found(spark, data, **narrow) == brute(data, **narrow)


def test_large_numbers_and_none(spark):
    rng = random.Random(4)
    data = [(k, [rng.uniform(-1, 1) * 5.4e6 for _ in range(4)], k % 3) for k in range(101)]
    expected = brute(data)
    assert found(spark, data) == expected and max(abs(r[4]) for r in expected) > 1 << 61
    assert found(spark, []) == []
    assert found(spark, [(1, [1.0], 1)]) == []


def test_many_blocks_and_hot_label(spark):
    """One label holds most rows, so its rows fill several blocks of one partition."""
    rng = random.Random(6)
    data = [(k, [rng.gauss(0, 1) for _ in range(6)], 1 if k % 8 else 2) for k in range(6000)]
    frame = spark.createDataFrame([(*d, "x", "y", 1, "z") for d in data], KIND)
    named = hardneg.usable(frame, "vec_id", "embedding", "label")
    blocks = hardneg.write_blocks(named, 6).collect()
    assert sum(b.n for b in blocks) == 6000 and max(b.n for b in blocks) <= hardneg.BLOCK
    assert sorted(x for b in blocks for x in np.frombuffer(b.ids, np.int64).tolist()) == list(range(6000))
    got = found(spark, data, every=1500)
    assert got == brute(data, every=1500)


def test_shelves_and_anchors_meet_in_any_number_of_partitions(spark, monkeypatch):
    """Small results are coalesced into one partition, large ones are not: the keys of both sides must meet there too."""
    monkeypatch.setattr(hardneg, "BLOCK", 16)
    monkeypatch.setattr(hardneg, "SHELF", 2)
    monkeypatch.setattr(hardneg, "SLICE", 4)
    data = vectors(random.Random(9), 400, 8, 3, 300)
    setting = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "false")
    try:
        got = found(spark, data, every=20)
    finally:
        spark.conf.set(setting, before)
    expected = brute(data, every=20)
    assert got == expected and len(expected) > 50


def test_curve_moves_one_step_at_a_time():
    for dims, bits in ((2, 4), (3, 2), (4, 2)):
        grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
        place = hardneg.hilbert(grid, bits)
        assert sorted(place.tolist()) == list(range(len(grid)))
        walk = grid[np.argsort(place)]
        assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_bounds_hold():
    rng = np.random.default_rng(1)
    block, a = rng.integers(-300, 300, (50, 7)), rng.integers(-300, 300, (9, 7))
    low, high = hardneg.bounds(a, block.min(axis=0)[None, :], block.max(axis=0)[None, :])
    score = hardneg.products(a, block)
    assert (score >= low).all() and (score <= high).all()
