from __future__ import annotations

import random

import pytest
import xxhash

from tests.conftest import SMALL
from twinkeep.llm import graph, queries, simhash


def plain_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for blank in "\t\n\x0b\x0c\r":
        words = words.replace(blank, " ")
    words = [w for w in words.split(" ") if w]
    grams = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(
        1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)
    )


def brute_classes(codes):
    """{index: smallest index reachable} by comparing all pairs."""
    root = list(range(len(codes)))

    def up(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(codes)):
        for b in range(a):
            if (codes[a] ^ codes[b]).bit_count() <= 4:
                x, y = up(a), up(b)
                root[max(x, y)] = min(x, y)
    return [up(x) for x in range(len(codes))]


def clustered(seed, centres, each, flips):
    rng, out = random.Random(seed), []
    for _ in range(centres):
        centre = rng.getrandbits(64)
        for _ in range(each):
            code = centre
            for b in rng.sample(range(64), rng.randint(0, flips)):
                code ^= 1 << b
            out.append(code)
    return out


def signed(code):
    return code - (1 << 64) if code >> 63 else code


@pytest.mark.parametrize("above", [simhash.SPLIT_ABOVE, 2])
def test_classes_match_all_pairs(spark, monkeypatch, above):
    monkeypatch.setattr(simhash, "SPLIT_ABOVE", above)
    monkeypatch.setattr(simhash, "PAIRS_AT_ONCE", 64)
    codes = clustered(1, 12, 40, 4) + clustered(2, 40, 3, 3) + [random.Random(3).getrandbits(64) for _ in range(100)]
    frame = spark.createDataFrame(
        [(i, signed(c)) for i, c in enumerate(codes)], "doc_id long, simhash long"
    )
    found = {r.simhash: r.component_id for r in simhash.classes(frame).collect()}
    assert [found[signed(c)] for c in codes] == brute_classes(codes)


def test_whole_table_matches_brute_force(spark):
    rows = queries.op5_simhash_pigeonring(spark, SMALL).collect()
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    texts = {d.doc_id: d.text for d in docs}
    assert len(rows) == len(docs)
    ids = sorted(texts)
    codes = [plain_fingerprint(texts[i]) for i in ids]
    expected = dict(zip(ids, [ids[x] for x in brute_classes(codes)]))
    for row in rows:
        assert row.fingerprint == f"{codes[ids.index(row.doc_id)]:016x}"
        assert row.component_id == expected[row.doc_id]


def test_odd_rows(spark):
    data = [
        (5, "One two three four five", "x"), (4, "one  two\tthree four five", "y"),
        (4, "one two three four five", "y"), (None, "one two three four five", "z"),
        (7, None, "n"), (8, "", "n"), (9, " \n", "n"), (None, "q " * 60_000 + "end", "n"),
    ]
    docs = spark.createDataFrame(data, "doc_id long, text string, simhash string")
    rows = simhash.near_duplicates(docs).collect()
    assert len(rows) == 8
    assert {r.component_id for r in rows if r.doc_id in (4, 5)} == {4}
    assert {(r.fingerprint, r.component_id) for r in rows if r.doc_id in (7, 8, 9)} == {("0" * 16, 7)}
    kept = simhash.keep_one(docs).collect()
    assert sorted((r.doc_id or -1) for r in kept) == [-1, 4, 7]
    assert kept[0].__fields__ == docs.columns
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
    assert simhash.keep_one(docs.limit(0)).count() == 0


def test_components_of_a_long_path_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(500)] + [(5, 5), (None, 3)]
    frame = spark.createDataFrame(edges, "a long, b long")
    found = {r.node: r.root for r in graph.components(frame).collect()}
    assert found == {i: 0 for i in range(301)} | {1000 + i: 1000 for i in range(500)}
