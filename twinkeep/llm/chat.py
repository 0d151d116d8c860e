"""Chat formatting: collapse cumulative snapshots, then render what is left.

A log may hold a conversation once per turn, each time with all turns so far. A
conversation whose turns are the first turns of a longer one is dropped; of equal
ones the smallest id stays.

Turns are numbered within their conversation in the order of ``turn``, then role,
then text; rows repeated whole count once. The rolling hash of a prefix is the xor of
128-bit hashes of (place, role, text) of its turns. All of it runs in two levels, so a
conversation of any length never meets in one task, whatever its turn numbers: turns are
numbered by a range shuffle and folded in blocks (``BLOCK`` consecutive places), and blocks
are then offset by the totals of the blocks before. Prefixes are compared by aggregation over their hash, which
combines before the shuffle, so a first turn that a third of all conversations share
is no hot key. An anti-join drops the conversations that another one extends.

Nulls: rows without ``conv_id`` belong to no conversation and are left out; a null
turn comes first; a null role renders as ``unknown`` and a null text as empty, but
both differ from ``unknown`` and from empty text when prefixes are compared. Turns with
one number, or none, are told apart by role and text. An empty table gives no rows; other
columns, of whatever names, are not read. Built-in functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from twinkeep.llm.rows import stored
from twinkeep.operators.numbering import number_within

#: Consecutive turns per block; a rendered conversation has a part per block.
BLOCK = 4096
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def _turns(
    conversations: DataFrame, conv_id: str, turn: str, role: str, text: str, block: int
) -> DataFrame:
    """Distinct turns with ``block`` and ``place`` (from 1 on) in their conversation."""
    turns = (
        conversations.select(
            F.col(conv_id).alias("conv_id"),
            F.col(turn).alias("turn"),
            F.col(role).alias("role"),
            F.col(text).alias("text"),
        )
        .where("conv_id IS NOT NULL")
        .withColumns(
            {
                "h1": F.xxhash64(F.lit(1), "role", F.col("role").isNull(), "text", F.col("text").isNull()),
                "h2": F.xxhash64(F.lit(2), "text", F.col("text").isNull(), "role", F.col("role").isNull()),
            }
        )
        .dropDuplicates(["conv_id", "turn", "role", "text"])
    )
    order = [F.col(c).asc_nulls_first() for c in ("turn", "role", "text")]
    placed = number_within(turns, ["conv_id"], order, "place")
    return stored(placed.withColumn("block", F.floor((F.col("place") - 1) / block)), "turns")


def _prefixes(placed: DataFrame) -> DataFrame:
    """Per turn the rolling hash ``p1``, ``p2`` of all turns up to it."""
    inside = W.partitionBy("conv_id", "block").orderBy("place").rowsBetween(W.unboundedPreceding, 0)
    bound = placed.select(
        "conv_id",
        "block",
        "place",
        F.xxhash64("place", "h1", "h2").alias("x1"),
        F.xxhash64("h2", "place", "h1").alias("x2"),
    )
    rolled = bound.select(
        "conv_id", "block", "place",
        *[F.bit_xor(x).over(inside).alias(x) for x in ("x1", "x2")],
    )
    totals = bound.groupBy("conv_id", "block").agg(*[F.bit_xor(x).alias(x) for x in ("x1", "x2")])
    before = W.partitionBy("conv_id").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    earlier = totals.select(
        "conv_id", "block",
        *[F.coalesce(F.bit_xor(x).over(before), F.lit(0)).alias(f"{x}_before") for x in ("x1", "x2")],
    )
    return rolled.join(earlier, ["conv_id", "block"]).select(
        "conv_id",
        "place",
        F.col("x1").bitwiseXOR(F.col("x1_before")).alias("p1"),
        F.col("x2").bitwiseXOR(F.col("x2_before")).alias("p2"),
    )


def maximal(placed: DataFrame) -> DataFrame:
    """``conv_id`` and ``n_turns`` of the conversations that no other extends or repeats."""
    key = ["place", "p1", "p2"]
    prefixes = stored(_prefixes(placed), "prefixes")
    lengths = prefixes.groupBy("conv_id").agg(F.max("place").alias("place"))
    ends = stored(
        prefixes.join(lengths, ["conv_id", "place"]).groupBy(*key).agg(F.min("conv_id").alias("conv_id")),
        "ends",
    )
    # A prefix that some conversation goes beyond: it has more turns than ends there.
    whole = prefixes.join(lengths, ["conv_id", "place"], "left_semi").groupBy(*key).count()
    beyond = (
        prefixes.groupBy(*key)
        .agg(F.count("*").alias("all"))
        .join(whole, key)
        .where(F.col("all") > F.col("count"))
        .select(*key)
    )
    return ends.join(beyond, key, "left_anti").select("conv_id", F.col("place").alias("n_turns"))


def rendered(role: Column, text: Column) -> Column:
    """One turn in the template."""
    return F.concat(
        F.lit(OPEN), F.coalesce(role, F.lit("unknown")), F.lit("\n"),
        F.coalesce(text, F.lit("")), F.lit(CLOSE + "\n"),
    )


def format_chats(
    conversations: DataFrame,
    conv_id: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    block: int = BLOCK,
) -> DataFrame:
    """Maximal conversations: ``conv_id``, ``part``, ``n_turns`` and ``rendered``.

    ``part`` is 0 but for conversations of more than ``block`` turns, which have one row
    per block in order; joined by nothing, the parts are the conversation.
    ``n_turns`` is that of the whole conversation.
    """
    placed = _turns(conversations, conv_id, turn, role, text, block)
    kept = stored(maximal(placed), "maximal")
    inside = W.partitionBy("conv_id").orderBy("block")
    return (
        placed.join(kept, "conv_id")
        .groupBy("conv_id", "n_turns", "block")
        .agg(
            F.sort_array(
                F.collect_list(F.struct("place", rendered(F.col("role"), F.col("text")).alias("t")))
            ).alias("turns")
        )
        .select(
            "conv_id",
            (F.row_number().over(inside) - 1).alias("part"),
            "n_turns",
            F.array_join(F.transform("turns", lambda t: t["t"]), "").alias("rendered"),
        )
    )
