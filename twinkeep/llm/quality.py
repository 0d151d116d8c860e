"""Quality by nearest-neighbour voting among labelled latent-semantic vectors.

A text's terms are its words and their shapes (runs of upper case, lower case, digits
and each sign by itself; a word equal to the one before has a shape of its own). Both
are hashed into ``WORDS`` and ``SHAPES`` columns, weighted by log frequency and inverse
document frequency, and projected on the ``DIMENSIONS`` leading singular vectors of the
labelled texts. A text is compared with every labelled vector, in exact blocked cosine
products; the ``NEIGHBOURS`` nearest, and all that are as near as the last of these,
vote with their similarity to the power ``SHARPNESS``, beside a weak vote for the share
of good texts.

What is broadcast is bounded: at most about ``SAMPLE`` labelled rows, taken by hash.

Null and empty texts have no terms and get the share of good texts. Rows are
independent: repeated rows and null ids each give their result. Without labels every
score is 0. Whole texts are read, in slices of about ``rows.SMALL_CHUNK_BYTES``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinkeep.llm import rows
from twinkeep.llm.winnowing import _constants, _mix, _Powers

SAMPLE, NEIGHBOURS, SHARPNESS, DIMENSIONS = 8_000, 15, 8, 64
WORDS, SHAPES = 512, 512
#: Texts compared at a time: bounds memory whatever the batch.
BLOCK = 128
#: Weight of the vote for the share of good texts.
PRIOR = 0.05

_U = np.uint64
_BYTE = _constants(23, 256)
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
#: Classes of bytes: lower case and beyond ASCII, upper case, digits, each other by itself.
_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[97:123] = _CLASS[128:] = ord("a")
_CLASS[65:91] = ord("A")
_CLASS[48:58] = ord("0")
_AGAIN = SHAPES - 1
_POWERS = _Powers(0x9E3779B97F4A7C15)


def _sums(values: np.ndarray, place: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Polynomial hashes of the runs; ``place`` is the power of each value."""
    if not len(starts):
        return np.zeros(0, _U)
    up, down = _POWERS.reach(int(place[-1]) + 2)
    total = np.zeros(len(values) + 1, _U)
    np.cumsum(values * up[place], out=total[1:])
    return _mix((total[ends] - total[starts]) * down[place[starts]])


def terms(data: np.ndarray, at: np.ndarray, low: int, high: int) -> np.ndarray:
    """Counts of the hashed terms of texts low to high, a row per text."""
    first, last = at[low], at[high]
    raw, bounds = data[first:last], at[low : high + 1] - first
    width, count = WORDS + SHAPES, high - low
    if not len(raw):
        return np.zeros((count, width), np.float32)
    solid = ~_BLANK[raw]
    cut = np.zeros(len(raw) + 1, bool)
    cut[bounds] = True
    starts = np.flatnonzero(solid & (~np.r_[False, solid[:-1]] | cut[:-1]))
    ends = np.flatnonzero(solid & (~np.r_[solid[1:], False] | cut[1:])) + 1
    text = np.searchsorted(bounds, starts, side="right") - 1
    word = _sums(_BYTE[raw], np.arange(len(raw)), starts, ends)
    kind = _CLASS[raw]
    turn = np.ones(len(raw), bool)
    turn[1:] = kind[1:] != kind[:-1]
    turn[starts] = True
    shape = _sums(np.where(turn, _BYTE[kind], _U(0)), np.cumsum(turn), starts, ends)
    again = np.zeros(len(starts), bool)
    again[1:] = (word[1:] == word[:-1]) & (text[1:] == text[:-1])
    columns = np.where(again, _AGAIN, (shape % _U(_AGAIN)).astype(np.int64)) + WORDS
    counts = np.bincount(text * width + columns, minlength=count * width)
    counts += np.bincount(text * width + (word % _U(WORDS)).astype(np.int64), minlength=count * width)
    return counts.reshape(count, width).astype(np.float32)


def _slices(at: np.ndarray) -> Iterator[tuple[int, int]]:
    for low, high in rows.chunks(at, rows.SMALL_CHUNK_BYTES):
        for first in range(low, high, BLOCK):
            yield first, min(first + BLOCK, high)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


@dataclass
class Neighbours:
    """Labelled vectors (unit length), their labels, and the way into their space."""

    vectors: np.ndarray
    labels: np.ndarray
    weights: np.ndarray
    axes: np.ndarray
    base: float

    def project(self, counts: np.ndarray) -> np.ndarray:
        return _unit(_weighted(counts, self.weights) @ self.axes)

    def vote(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores and nearest similarities of a block of texts."""
        if not len(self.labels):
            return np.full(len(counts), self.base), np.zeros(len(counts))
        near = self.project(counts) @ self.vectors.T
        k = min(NEIGHBOURS, near.shape[1])
        edge = np.partition(near, near.shape[1] - k, axis=1)[:, near.shape[1] - k, None]
        vote = np.where(near >= edge, np.maximum(near, 0), 0) ** SHARPNESS
        good = vote @ self.labels + PRIOR * self.base
        score = good / (vote.sum(axis=1) + PRIOR)
        return np.clip(score, 0, 1).astype(np.float64), near.max(axis=1).astype(np.float64)


def _weighted(counts: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Words and shapes each of unit length, so that neither drowns the other."""
    x = np.log1p(counts) * weights
    # Shapes by their share: how much of a text they are matters more than that they occur.
    shares = counts[:, WORDS:] / np.maximum(counts[:, WORDS:].sum(axis=1, keepdims=True), 1)
    return np.hstack([0.5 * _unit(x[:, :WORDS]), _unit(np.sqrt(shares) * weights[WORDS:])])


def train(
    labelled: DataFrame, text: str = "text", label: str = "quality", sample: int = SAMPLE
) -> Neighbours:
    """Vectors of the labelled rows (labels other than 0 and 1 are left out)."""
    chosen = labelled.select(F.col(text).alias("text"), F.col(label).cast("int").alias("label"))
    chosen = chosen.where("label IN (0, 1)")
    share = min(1.0, sample / max(1, chosen.count()))
    part = F.pmod(F.xxhash64("text", F.lit(5)), F.lit(1_000_000))

    def make():
        def work(texts: pa.Array):
            data, at = rows.utf8(texts)
            parts = [terms(data, at, a, b) for a, b in _slices(at)]
            counts = np.concatenate(parts) if parts else np.zeros((0, WORDS + SHAPES), np.float32)
            flat = pa.array(counts.ravel())
            return [pa.ListArray.from_arrays(pa.array(np.arange(len(counts) + 1, dtype=np.int32) * (WORDS + SHAPES)), flat)]

        return work

    # Copies of a text share its hash: all are taken or none, and they make one vector.
    once = chosen.where(part < int(share * 1_000_000)).groupBy("text").agg(F.max("label").alias("label"))
    taken = rows.append(once, ["text"], make, "counts array<float>").select("counts", "label").toArrow()
    counts = taken.column("counts").combine_chunks()
    counts = counts.values.to_numpy(zero_copy_only=False).reshape(-1, WORDS + SHAPES).astype(np.float32)
    labels = taken.column("label").to_numpy().astype(np.float32)
    if not len(labels):
        none = np.zeros((0, 1), np.float32)
        return Neighbours(none, labels, np.zeros(WORDS + SHAPES, np.float32), np.zeros((WORDS + SHAPES, 1)), 0.0)
    held = (counts > 0).sum(axis=0)
    weights = np.log((1 + len(labels)) / (1 + held)).astype(np.float32) + 1
    x = _weighted(counts, weights)
    values, axes = np.linalg.eigh((x.T @ x).astype(np.float64))
    axes = axes[:, ::-1][:, :DIMENSIONS].astype(np.float32)
    return Neighbours(_unit(x @ axes), labels, weights, axes, float(labels.mean()))


def score(docs: DataFrame, model: Neighbours, text: str = "text") -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``nearest`` (similarity of the nearest labelled text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        model = shared.value

        def work(texts: pa.Array):
            data, at = rows.utf8(texts)
            parts = [model.vote(terms(data, at, a, b)) for a, b in _slices(at)]
            if not parts:
                return [[], []]
            return [pa.array(np.concatenate(x)) for x in zip(*parts)]

        return work

    return rows.append(docs, [text], make, "score double, nearest double")


def keep_good(docs: DataFrame, model: Neighbours, threshold: float, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that score at least ``threshold``, with its columns."""
    columns = docs.columns
    inner = docs.withColumnsRenamed({c: f"__{k}" for k, c in enumerate(columns)})
    scored = score(inner, model, f"__{columns.index(text)}").where(F.col("score") >= threshold)
    return scored.select(*[F.col(f"__{k}").alias(c) for k, c in enumerate(columns)])
