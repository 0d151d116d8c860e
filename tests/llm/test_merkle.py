"""Manifest and proofs against a plain recursive tree."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from twinkeep.llm import merkle, queries

KIND = "doc_id long, text string, lang string, source string, n_chars long"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row, text):
    doc_id, _, lang, source, n_chars = row
    values = (doc_id, source, lang, n_chars, text)
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def fold(nodes, place, now):
    """Top of a tree, siblings of a place, and the top with another leaf there."""
    proof = []
    while len(nodes) > 1:
        low = place // 8 * 8
        run = nodes[low : low + 8]
        proof += run[: place - low] + run[place - low + 1 :]
        now = sha("".join(run[: place - low] + [now] + run[place - low + 1 :]))
        nodes = [sha("".join(nodes[k : k + 8])) for k in range(0, len(nodes), 8)]
        place //= 8
    return nodes[0], proof, now


def brute(data, tampered):
    trees = {}
    for row in data:
        trees.setdefault(row[2], []).append((leaf(row, row[1]), row))
    names = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    for own in trees.values():
        own.sort(key=lambda x: (x[1][0] is not None, x[1][0] or 0, x[0]))
    tops = [fold([x[0] for x in trees[n]], 0, "")[0] for n in names]
    out = []
    for t, name in enumerate(names):
        digests = [x[0] for x in trees[name]]
        for place, (own, row) in enumerate(trees[name]):
            top, proof, now = fold(digests, place, leaf(row, tampered(row)))
            root, more, now = fold(tops, t, now)
            out.append((row[0], own, top, root, sha("".join(proof + more)), now, now == root))
    return sorted(out, key=str)


def tampered(row):
    text = row[1]
    return text and "".join(c.lower() if c.isascii() else c for c in text)


def found(spark, data, depth):
    docs = spark.createDataFrame(data, KIND).repartition(5).withColumn("leaf_of", F.lit(1)).withColumn("pos", F.lit("x"))
    own = [merkle.leaf_of("doc_id", "source", "lang", "n_chars", x) for x in ("text", F.translate("text", queries._UPPER, queries._LOWER))]
    leaves = docs.select("*", own[0].alias("leaf"), own[1].alias("checked"))
    result = merkle.digest(merkle.verify(merkle.prove(leaves, carry=["checked"], depth=depth), "checked"))
    return sorted([tuple(r) for r in result.collect()], key=str)


@pytest.mark.parametrize("depth", [1, 2, 5])
def test_trees_of_all_sizes(spark, depth):
    rng = random.Random(depth)
    sizes = {None: 70, "": 1, "a": 8, "b": 9, "é": 600, "Z": 64, "zz": 65, "q": 2}
    data = [
        (rng.randrange(5 * n), rng.choice((None, "", "low", "Up Per", "ÄB" * 9)), name, rng.choice((None, "s")), k)
        for name, n in sizes.items()
        for k in range(n)
    ]
    data += [(None, None, None, None, None), (None, "A", "b", "s", 1), (3, "Same", "a", "s", 1), (3, "Same", "a", "s", 1)]
    data.append((9, "Long " * 200_000, "q", None, None))
    expected = brute(data, tampered)
    assert found(spark, data, depth) == expected
    assert {x[6] for x in expected} == {True, False}


def test_one_row_and_none(spark):
    row = (1, "Ab", "x", None, 2)
    assert found(spark, [row], 5) == brute([row], tampered)
    assert found(spark, [], 5) == []


def test_requests_are_minimal():
    """What a partition asks for, with what it derives, is all that its proofs need, and nothing else."""
    for n in (1, 5, 64, 65, 600, 4097):
        for known in ([0], [n - 1], sorted({0, n // 2, n - 1}), list(range(n // 3, n // 2 + 1))):
            asked = {(k, p) for k, x in merkle.missing(np.array(known), n) for p in x.tolist()}
            have, need = set(known), set()
            for level, size in enumerate(merkle._sizes(n)[:-1]):
                need |= {(level, q) for p in have for q in range(p // 8 * 8, min(p // 8 * 8 + 8, size)) if q not in have}
                have = {p // 8 for p in have}
            assert asked == need


def test_hot_tree_spans_partitions(spark):
    """A tree with most rows is numbered and raised in many tasks."""
    frame = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("en").alias("lang"), F.unhex(F.sha2(F.col("id").cast("string"), 256)).alias("leaf"))
    own = merkle.placed(frame.repartition(8), "lang", "doc_id", "leaf", [], depth=3)
    assert own.select("g").distinct().count() > 4
    assert own.where("pos <> id").count() == 0


def test_leaf_partitions_and_what_they_send_are_small(spark):
    """A proof has a kilobyte or two: a task holds some thousand, and sends them in batches."""
    frame = spark.range(40_000).select(F.col("id").alias("doc_id"), F.lit("en").alias("lang"), F.unhex(F.sha2(F.col("id").cast("string"), 256)).alias("leaf"))
    own = merkle.placed(frame.repartition(8), "lang", "doc_id", "leaf", [])
    assert own.select("g").distinct().count() > 3
    some = own.where("pos < 4096").orderBy("pos").toArrow().append_column("extra", pa.array(range(4096)))
    asked = merkle._requests(some)
    given = asked.append_column("digest", pa.array([b"x" * 32] * asked.num_rows, pa.binary()))
    found = merkle._expand(some, given)
    assert [b.num_rows for b in found.to_batches()] == [1000, 1000, 1000, 1000, 96]
    assert found.column("extra").to_pylist() == list(range(4096))
    for row in found.slice(999, 3).to_pylist():
        assert merkle.folded(row["leaf"], row["pos"], row["n"], row["t"], row["trees"], row["proof"]) == row["root"]
