from __future__ import annotations

import hashlib
import random
import re

import duckdb

from scripts.check import TABLES, compare
from tests.conftest import SMALL
from twinkeep.llm import winnowing

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items):
    windows = {}
    for item, text in items:
        w = words(text)
        n = min(13, len(w))
        if item is None or not n:
            continue
        for s in range(len(w) - n + 1):
            windows.setdefault(tuple(w[s : s + n]), set()).add(str(item))
    out = []
    for doc, text in docs:
        w, hit, own = words(text), set(), set()
        for n in {len(x) for x in windows}:
            for s in range(len(w) - n + 1):
                found = windows.get(tuple(w[s : s + n]))
                if found:
                    hit |= set(range(s, s + n))
                    own |= found
        sha = hashlib.sha256(",".join(sorted(own)).encode()).hexdigest()
        out.append((doc, len(w), len(hit), len(own), sha, bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def ours(spark, docs, items):
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS n_words", "'x' AS items")
    i = spark.createDataFrame(items, "item_id long, text string")
    found = winnowing.digest(winnowing.contamination(d, i))
    return sorted((tuple(r) for r in found.collect()), key=str)


def test_random_texts_match_brute_force(spark):
    rng = random.Random(4)
    vocab = ["a", "b", "É", "x9", "Zz"]
    items = [(k, " ".join(rng.choice(vocab) for _ in range(n))) for k, n in enumerate([1, 2, 3, 5, 8, 12, 13, 14, 20, 40, 40])]
    items += [(3, items[8][1]), (None, "b b"), (50, None), (51, " ,; "), (52, items[9][1].upper())]
    docs = []
    for k in range(120):
        text = " ".join(rng.choice(vocab) for _ in range(rng.randint(0, 60)))
        if k % 3 == 0:
            source = rng.choice([t for _, t in items if t])
            text += " -- " + source + "! " + text
        docs.append((k, text))
    docs += [(5, docs[5][1]), (None, items[9][1]), (200, None), (201, ""), (202, "q " * 30_000 + items[10][1])]
    assert ours(spark, docs, items) == brute(docs, items)
    long_only = [x for x in items if len(words(x[1])) >= 13]
    assert ours(spark, docs, long_only) == brute(docs, long_only)


def test_empty_tables(spark):
    docs = [(1, "some words here")]
    sha = hashlib.sha256(b"").hexdigest()
    assert ours(spark, docs, []) == [(1, 3, 0, 0, sha, False)]
    assert ours(spark, [], [(1, "some words")]) == []


def test_full_tables_split_by_chunks(spark, monkeypatch):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    expected = brute([tuple(r) for r in docs.collect()], [tuple(r) for r in items.collect()])
    monkeypatch.setattr(winnowing.rows, "CHUNK_BYTES", 5000)
    found = winnowing.contamination(docs, items)
    assert sorted((tuple(r) for r in winnowing.digest(found).collect()), key=str) == expected
    assert any(r[5] for r in expected)
    kept = winnowing.drop_contaminated(docs, items)
    assert {r.doc_id for r in kept.collect()} == {r[0] for r in expected if not r[5]}
    assert kept.columns == docs.columns


def test_query_matches_sql(spark):
    db = duckdb.connect()
    for table in TABLES:
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL}/{table}.parquet'")
    verdict, _ = compare(spark, db, "op1_winnowing", SMALL)
    assert verdict.startswith("ok"), verdict
