from __future__ import annotations

import random

import duckdb
import pytest

from scripts.check import TABLES, compare
from tests.conftest import SMALL
from twinkeep.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, place string, h1 int"


def brute(data):
    conv = {}
    for c, turn, role, text in set(data):
        if c is not None:
            conv.setdefault(c, []).append((turn, role, text))
    lists = {}
    for c, turns in conv.items():
        turns.sort(key=lambda t: [(x is not None, x) if x is not None else (False, 0) for x in t])
        lists[c] = tuple((r, t) for _, r, t in turns)
    out = {}
    for c, mine in lists.items():
        if any(
            other[: len(mine)] == mine and (len(other) > len(mine) or d < c)
            for d, other in lists.items()
            if d != c
        ):
            continue
        out[c] = (len(mine), "".join(f"<|im_start|>{r if r is not None else 'unknown'}\n{t or ''}<|im_end|>\n" for r, t in mine))
    return out


def ours(spark, data, **options):
    frame = spark.createDataFrame([(*r, "x", 1) for r in data], SCHEMA)
    found = {}
    for r in sorted(chat.format_chats(frame, **options).collect(), key=lambda r: (r.conv_id, r.part)):
        n, text = found.get(r.conv_id, (r.n_turns, ""))
        found[r.conv_id] = (n, text + r.rendered)
    return found


@pytest.mark.parametrize("block", [chat.BLOCK, 2])
def test_random_logs_match_brute_force(spark, block):
    rng = random.Random(7)
    data = []
    for c in range(80):
        turns = [(t, rng.choice(["user", "assistant", None]), rng.choice("abc") if t else "hi") for t in range(rng.randint(1, 5))]
        data += [(c, *t) for t in turns]
        for k in range(1, len(turns)):
            if rng.random() < 0.5:
                data += [(1000 + 10 * c + k, *t) for t in turns[:k]]
    data += data[:20]  # repeated rows
    data += [(5000, None, "user", None), (5000, 3, None, ""), (5001, 0, "user", ""), (None, 0, "user", "lost"),
             (5002, 1, "user", "tie"), (5002, 1, "user", "tie b"), (5003, 0, "user", "long " * 20_000)]
    assert ours(spark, data, block=block) == brute(data)


def test_turns_without_or_with_one_number_fill_several_blocks(spark):
    rng = random.Random(9)
    data = []
    for c in range(6):
        turns = [(None if c % 2 else 7, rng.choice(["user", None]), f"{k:03}") for k in range(20 + 30 * c)]
        data += [(c, *t) for t in turns] + [(100 + c, *t) for t in sorted(turns, key=str)[:9]]
    block = 8
    assert ours(spark, data, block=block) == brute(data)
    frame = spark.createDataFrame([(*r, "x", 1) for r in data], SCHEMA)
    sizes = chat._turns(frame, "conv_id", "turn", "role", "text", block).groupBy("conv_id", "block").count()
    assert max(r["count"] for r in sizes.collect()) == block


def test_empty_table(spark):
    assert ours(spark, []) == {}


def test_main_path_is_native(spark):
    frame = spark.read.parquet(f"{SMALL}/conversations.parquet")
    plan = chat.format_chats(frame)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas", "Cartesian", "NestedLoop"))


def test_query_matches_sql(spark):
    db = duckdb.connect()
    for table in TABLES:
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL}/{table}.parquet'")
    verdict, _ = compare(spark, db, "op4_chat_snapshots", SMALL)
    assert verdict.startswith("ok"), verdict
    assert "types" not in verdict, verdict
