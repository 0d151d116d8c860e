"""The similarity join against brute force over all pairs."""

from __future__ import annotations

import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from twinkeep.llm import occurrence, queries

KIND = "doc_id long, text string, key string, n int, id string, tokens string"


def shingles(text):
    lower = "".join(c.lower() if c.isascii() else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute(data):
    sets = [shingles(t) for _, t in data]
    root, links = list(range(len(data))), [0] * len(data)

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i in range(len(data)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
                links[i] += 1
                links[j] += 1
    least = {}
    for i, (d, _) in enumerate(data):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    out = [
        (d, len(sets[i]), least.get(find(i)) if sets[i] else d, links[i]) for i, (d, _) in enumerate(data)
    ]
    return sorted(out, key=str)


def found(spark, data, parts=6):
    docs = spark.createDataFrame([(d, t, "x", 1, "y", "z") for d, t in data], KIND).repartition(parts)
    return sorted([tuple(r) for r in occurrence.join(docs).collect()], key=str)


def edited(rng, words, places):
    out = list(words)
    for _ in range(places):
        out[rng.randrange(len(out))] = f"new{rng.randrange(10**6)}"
    return out


def corpus(seed):
    rng = random.Random(seed)
    frame = [f"f{k}" for k in range(60)]
    texts = [None, "", " ", "\t\n", "!!!", "!!! ", "one", "One.", "ONE", "one two", "a b c d", "a b c d e", "A b, c d e", "é É", "é É"]
    for _ in range(25):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.choice((6, 12, 30, 80, 200)))]
        texts += [" ".join(words)] * rng.choice((1, 3))
        texts += [" ".join(edited(rng, words, rng.randrange(8))) for _ in range(4)]
        texts += [" ".join(words[rng.randrange(len(words) // 3) :]), " ".join(frame + words)]
        texts += [" ".join(words[:n]) for n in range(len(words) * 3 // 4, len(words), 7)]
    chain = [f"c{k}" for k in range(300)]
    texts += [" ".join(chain[k : k + 100]) for k in range(0, 200, 9)]
    repeated = ["r"] * 300
    texts += [" ".join(repeated), " ".join(repeated[:200]), " ".join(repeated[:4])]
    rng.shuffle(texts)
    return [(rng.choice((k, k, k, None, k // 2)), t) for k, t in enumerate(texts)]


@pytest.mark.parametrize("seed", [1, 2])
def test_all_links_against_brute_force(spark, seed):
    data = corpus(seed)
    expected = brute(data)
    assert found(spark, data) == expected
    assert max(r[3] for r in expected) > 5


def test_real_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    expected = brute([(r.doc_id, r.text) for r in docs])
    result = queries.op12_jaccard_join(spark, "/root/testdata/sf0.001").collect()
    assert sorted([tuple(r) for r in result], key=str) == expected


def test_hot_line_long_text_and_none(spark):
    """A line that most texts share, a crowd of near copies, and a very long text."""
    rng = random.Random(5)
    line = " ".join(f"line{k}" for k in range(12))
    base = [f"b{k}" for k in range(120)]
    data = [(k, line + " " + " ".join(f"u{rng.randrange(10**6)}" for _ in range(rng.randrange(3, 40)))) for k in range(150)]
    data += [(1000 + k, " ".join(edited(rng, base, 2))) for k in range(60)]
    long = " ".join(f"l{rng.randrange(10**7)}" for _ in range(150_000))
    data += [(2000, long), (2001, long + " end")]
    assert found(spark, data, 3) == brute(data)
    assert found(spark, []) == []


def test_divide_skip_counts_exactly():
    """Short lists merged and long ones probed give the occurrences that plain counting gives."""
    rng = np.random.default_rng(3)
    for _ in range(40):
        sets = [np.unique(rng.zipf(1.3, rng.integers(1, 60)) % 200) for _ in range(rng.integers(1, 80))]
        owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        lists = occurrence.Lists(np.concatenate(sets), owner, len(sets))
        query = np.unique(rng.integers(0, 220, rng.integers(1, 60)))
        for least in (1, 2, 5, len(query)):
            plain = np.array([len(np.intersect1d(query, s)) for s in sets])
            at, count = lists.search(query, least)
            assert at.tolist() == np.flatnonzero(plain >= least).tolist()
            assert count.tolist() == plain[plain >= least].tolist()


def test_a_group_of_the_counting_step_is_small():
    """A task holds a group several times over (sort, Arrow batch, arrays): its shuffled bytes and its arrays are bounded."""
    total, cores = 70_000_000, 6
    size = -(-2 * total // (5 * occurrence._groups(total, cores)))
    rng = np.random.default_rng(3)
    packed = []
    for part in np.array_split(np.sort(rng.integers(0, 1 << 62, size, np.uint64)), 200):
        owner = np.arange(len(part), dtype=np.uint32)
        packed.append((0, rng.bytes(16 * len(part)), owner.tobytes(), part.tobytes(), b""))
    kinds = (pa.int32(), *[pa.binary()] * 4)
    names = ["g", "keys", "owner", "tokens", "counts"]
    table = pa.table([pa.array(x, t) for x, t in zip(zip(*packed), kinds)], names)
    tracemalloc.start()
    counted = occurrence._counted(table, 4)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert counted.num_rows == 0 or sum(len(k.as_py()) for k in counted.column("keys")) % 16 == 0
    assert table.nbytes < 8 << 20 and peak < 48 << 20
