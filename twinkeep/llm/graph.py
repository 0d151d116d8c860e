"""Connected components of a graph given as an edge table.

Alternating large-star and small-star rounds (Kiveris et al., 2014) as DataFrame
jobs. Every round is written to the shared folder, so lineage stays short and
lost executors cost one round at most. Minima are written before they are joined,
which leaves the join free to split a hub that holds a third of all edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinkeep.llm.rows import stored


def components(edges: DataFrame) -> DataFrame:
    """Rows ``(node, root)`` for nodes that have an edge; root is the smallest node.

    ``edges`` has two columns of one orderable type. Null ends, loops and repeated
    edges are ignored; an empty table gives an empty result.
    """
    a, b = edges.columns
    now = stored(
        edges.where(F.col(a) != F.col(b))
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .distinct(),
        "edges",
    )
    before = _print(now)
    while True:
        now = _star(now, large=True)
        now = stored(_star(now, large=False), "edges")
        after = _print(now)
        if after == before:
            break
        before = after
    roots = now.select(F.col("v").alias("node")).distinct().withColumn("root", F.col("node"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Edges (u > v). Large: larger neighbours move to the minimum; small: the others."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = both.join(stored(least, "minima"), "u")
    if large:
        moved = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m"))
    else:
        moved = joined.select(F.col("v").alias("u"), "m").unionByName(joined.select("u", "m"))
    return moved.where(F.col("u") != F.col("m")).select("u", F.col("m").alias("v")).distinct()


def _print(edges: DataFrame) -> tuple:
    """Count and order-free digest of the edges, to see that a round changed nothing."""
    row = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
    return tuple(row)
