"""Mixing sources to target weights by iterative proportional fitting.

Tokens are counted per cell (source, language, topic). Raking scales the cells to each
dimension's target shares in turn until all margins hold. Documents are then sampled
with the probability of their cell: its raked share over its own share, scaled so that
the expected sample has ``budget`` of all tokens. Where that exceeds 1 the cell is taken
whole and the others make up for it; margins hold exactly as long as no cell does.

Targets are shares by value for a dimension, or a temper: shares proportional to the
tokens to that power (1 keeps the mixture, 0 makes it even). Values that given targets
do not name keep their tokens' share of what the named ones leave of 1.

Cells stay a table throughout: a dimension may have millions of values. A cell that
holds a third of all rows is one row here, its tokens are summed before the shuffle.

Topics: documents have none of their own, so the query takes the majority bits of the
hashes of a text's longer words (``TOPIC_BITS`` of them), which put texts of like
vocabulary together. Any column serves as topic.

A null source, language or topic is a value of its own. Null and empty texts have no
tokens; their cells follow the same rule, and a cell without tokens gets the smallest
probability of all. The draw is a hash of id and text: repeated rows are drawn alike.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinkeep.llm import rows
from twinkeep.llm.winnowing import Words, _mix, _U

TEMPER, BUDGET, SWEEPS, TOLERANCE, TOPIC_BITS, LONG_WORD = 0.5, 0.3, 25, 1e-3, 3, 6
SEED = 29
_NULL = "\0"
#: Steps of the search for the scale, in each of ``ROUNDS`` rounds.
STEPS, ROUNDS = 64, 3

Targets = dict[str, "dict[str, float] | float"]


def annotate(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``n_tokens`` (words) and ``topic``."""

    def make():
        def work(texts: pa.Array):
            data, at = rows.utf8(texts)
            tokens = np.zeros(len(at) - 1, np.int64)
            topic = np.zeros(len(at) - 1, np.int32)
            for low, high in rows.chunks(at, rows.SMALL_CHUNK_BYTES):
                words = Words(data, at, low, high)
                tokens[low:high] = np.diff(words.at)
                long = words.size >= LONG_WORD
                hashes, own = _mix(words.hash[long]), words.text[long]
                total = np.bincount(own, minlength=high - low)
                for bit in range(TOPIC_BITS):
                    ones = np.bincount(own, (hashes >> _U(bit)) & _U(1), minlength=high - low)
                    topic[low:high] |= (2 * ones > total).astype(np.int32) << bit
            return [pa.array(tokens), pa.array(topic)]

        return work

    return rows.append(docs, [text], make, "n_tokens long, topic int")


def _value(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(_NULL))


def cell_table(docs: DataFrame, dimensions: tuple[str, ...], tokens: str) -> DataFrame:
    """Tokens per combination of values, as text."""
    return docs.groupBy(*[_value(d).alias(f"__{d}") for d in dimensions]).agg(
        F.sum(F.col(tokens).cast("double")).alias("tokens")
    )


def _target(cells: DataFrame, dimension: str, goal: dict[str, float] | float) -> DataFrame:
    """``goal`` shares of the values of a dimension that have tokens."""
    key = f"__{dimension}"
    margin = cells.groupBy(key).agg(F.sum("tokens").alias("t")).where("t > 0")
    if isinstance(goal, dict):
        spark = cells.sparkSession
        named = spark.createDataFrame(
            [(_NULL if k is None else str(k), float(v)) for k, v in goal.items()], f"`{key}` string, named double"
        )
        margin = margin.join(named, key, "left")
        rest = max(0.0, 1.0 - sum(goal.values()))
        sums = margin.agg(
            F.sum(F.when(F.col("named").isNull(), F.col("t"))).alias("unnamed"), F.sum("named").alias("named_sum")
        ).first()
        weight = F.coalesce(F.col("named"), F.lit(rest) * F.col("t") / F.lit(float(sums.unnamed or 1.0)))
    else:
        weight = F.pow("t", F.lit(float(goal)))
    weighed = margin.select(key, weight.alias("g"))
    total = weighed.agg(F.sum("g")).first()[0] or 1.0
    return rows.stored(weighed.select(key, (F.col("g") / F.lit(float(total))).alias("goal")), "targets")


def rake(cells: DataFrame, dimensions: tuple[str, ...], targets: Targets) -> DataFrame:
    """``cells`` with ``weight``: shares of all tokens whose margins are the targets.

    Stops when no margin is off by more than ``TOLERANCE`` of its target, or after ``SWEEPS`` rounds
    (targets that contradict each other have no solution; the last round stands).
    """
    total = cells.agg(F.sum("tokens")).first()[0] or 1.0
    now = cells.withColumn("weight", F.col("tokens") / F.lit(float(total)))
    for d in dimensions:
        now = now.join(_target(cells, d, targets[d]).withColumnRenamed("goal", f"goal__{d}"), f"__{d}", "left")
    now = rows.stored(now.withColumn("off", F.lit(0.0)), "goals")
    for _ in range(SWEEPS):
        now = now.withColumn("off", F.lit(0.0))
        # Stored after each dimension: a step on a step on a step would be planned eight times over.
        for d in dimensions:
            goal = F.col(f"goal__{d}")
            sums = now.groupBy(f"__{d}").agg(F.sum("weight").alias("s"))
            factor = F.when(F.col("s") > 0, F.coalesce(goal, F.lit(0.0)) / F.col("s")).otherwise(0.0)
            miss = F.when((goal > 0) & (F.col("s") > 0), F.abs(F.col("s") / goal - 1)).otherwise(0.0)
            stepped = now.join(sums, f"__{d}").withColumns(
                {"weight": F.col("weight") * factor, "off": F.greatest("off", miss)}
            )
            now = rows.stored(stepped.drop("s"), "raked")
        worst = now.agg(F.max("off")).first()[0] or 0.0
        if worst <= TOLERANCE:
            break
    return now.drop("off", *[f"goal__{d}" for d in dimensions])


def _taken(ratio: DataFrame, scales: np.ndarray) -> np.ndarray:
    """Expected tokens at each of the ``scales``, in rising order; one plan for any scales."""
    each = ratio.select("tokens", "ratio", F.posexplode(F.array(*[F.lit(float(c)) for c in scales])).alias("k", "scale"))
    chance = F.least(F.lit(1.0), F.col("ratio") * F.col("scale"))
    sums = each.groupBy("k").agg(F.sum(F.col("tokens") * chance).alias("s")).orderBy("k").collect()
    return np.array([float(r.s) for r in sums])


def probabilities(raked: DataFrame, budget: float) -> DataFrame:
    """``raked`` with ``probability``: expected tokens are ``budget`` of all tokens."""
    ratio = raked.withColumn(
        "ratio", F.when(F.col("tokens") > 0, F.col("weight") / F.col("tokens")).otherwise(0.0)
    )
    bounds = ratio.agg(
        F.max("ratio"), F.min(F.when(F.col("ratio") > 0, F.col("ratio"))), F.sum("tokens")
    ).first()
    most, least, total = (float(x or 0.0) for x in bounds)
    if not most:
        return ratio.withColumn("probability", F.lit(float(budget)))
    # The scale lies between budget / most and 1 / least: more tokens the larger it is.
    low, high = 0.0, 1 / least
    for turn in range(ROUNDS):
        at = np.geomspace(budget / most * 1e-3, high, STEPS) if not turn else np.linspace(low, high, STEPS)
        reach = _taken(ratio, at) / total
        k = int(np.searchsorted(reach, budget))
        low, high = float(at[max(0, k - 1)]), float(at[min(k, STEPS - 1)])
    a, b = float(reach[max(0, k - 1)]), float(reach[min(k, STEPS - 1)])
    # Between two steps the sum is a straight line, but for a bend where a cell is full.
    scale = high if b <= a else low + (high - low) * min(1.0, max(0.0, (budget - a) / (b - a)))
    probability = F.least(F.lit(1.0), F.col("ratio") * F.lit(scale))
    floor = least * scale
    return ratio.withColumn(
        "probability", F.when(F.col("tokens") > 0, probability).otherwise(F.lit(min(1.0, floor)))
    )


def mix(
    docs: DataFrame,
    dimensions: tuple[str, ...] = ("source", "lang", "topic"),
    targets: Targets | None = None,
    tokens: str = "n_tokens",
    doc_id: str = "doc_id",
    text: str = "text",
    budget: float = BUDGET,
) -> DataFrame:
    """``docs`` with ``probability`` and ``sampled``.

    ``targets`` has an entry per dimension; the default tempers each by ``TEMPER``.
    """
    targets = targets or {d: TEMPER for d in dimensions}
    cells = rows.stored(cell_table(docs, dimensions, tokens), "cells")
    chances = probabilities(rake(cells, dimensions, targets), budget)
    chances = rows.stored(chances.select(*[f"__{d}" for d in dimensions], "probability"), "chances")
    kept = docs.drop(*[c for c in docs.columns if c.lower() in ("probability", "sampled")])
    draw = F.pmod(F.xxhash64(F.lit(SEED), doc_id, text), F.lit(1 << 53)) / F.lit(float(1 << 53))
    return (
        kept.withColumns({f"__{d}": _value(d) for d in dimensions})
        .join(chances, [f"__{d}" for d in dimensions])
        .drop(*[f"__{d}" for d in dimensions])
        .withColumn("sampled", draw < F.col("probability"))
    )
