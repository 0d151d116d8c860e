"""A Merkle manifest of a dataset, with one proof per row from Octopus multiproofs.

Rows are leaves. Each value of a tree column (``lang``) has a tree over its leaves in the
order of an id; runs of ``ARITY`` consecutive nodes become their parent's digest until one
node remains, the subroot. The subroots, in the order of the tree column (null first),
are the leaves of one more tree, whose top is the root.

Positions come from one range shuffle: rows are sorted by tree and id over all partitions,
and a row's position is its place in its partition plus the counts of the partitions
before, so a tree that holds most rows still spans many tasks. Levels are raised a block of
``ARITY ** DEPTH`` nodes at a time: one pass over the leaves, a second over 1/4096 of them.

Proofs follow the Octopus scheme: a leaf partition (some aligned blocks of leaves) looks at
all its leaves together, lists level by level the nodes that their paths need and that it
can't derive itself, and drops what is listed twice. That minimal set is fetched by one join
with the stored nodes; the partition then derives the interior nodes its leaves share and
expands each leaf's own proof locally, a thousand leaves at a time. Where 256 000 leaves would
ask for some 40 nodes each, a block of 4096 asks for a few dozen.

A proof is the siblings' digests, level by level from the leaf to the root, left to right
within a level; ``folded`` recomputes the root from a leaf and its proof.

Null ids come first in their tree; rows with the same id are ordered by their leaf, and rows
that are equal in both are interchangeable. Null and empty texts differ. A lone leaf is its
tree's subroot, a lone subroot the root, and their proofs have no siblings there. Very long
texts are hashed in the JVM. An empty table gives no rows. Only named columns are read, so
other columns may have any name.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinkeep.llm import rows

ARITY, ARITY_BITS = 8, 3
#: Levels raised in one pass: blocks of 8 ** 4 = 4096 nodes.
DEPTH = 4
#: Leaves per group of blocks, in the mean: bounds the memory of a task. A proof has a kilobyte or two.
GROUP_ROWS = 1 << 13
#: The tree of the subroots.
TOP = -1


def _hash(digests: bytes) -> bytes:
    """Digest of concatenated digests, which go in as hexadecimal text."""
    return hashlib.sha256(digests.hex().encode()).digest()


def encoded(column: str | Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, a colon and the value."""
    value = (F.col(column) if isinstance(column, str) else column).cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf_of(*columns: str | Column) -> Column:
    """The digest of a row (32 bytes) from its columns in the given order."""
    return F.unhex(F.sha2(F.concat(*map(encoded, columns)), 256))


def _up(n: int) -> int:
    return (n + ARITY - 1) >> ARITY_BITS


def _sizes(n: int) -> list[int]:
    """Nodes per level of a tree of n leaves, the single top included."""
    out = [n]
    while out[-1] > 1:
        out.append(_up(out[-1]))
    return out


def _ordered(frame: DataFrame, order: list[str], label: str) -> DataFrame:
    """``frame`` stored in the order of columns over all partitions, with ``part`` and ``nth``."""
    return rows.stored(
        frame.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("part", F.spark_partition_id())
        .withColumn("nth", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))),
        label,
    )


def _before(counts: DataFrame, *by: str) -> DataFrame:
    """``counts`` with ``offset``: rows of earlier partitions; one row per partition and key."""
    earlier = Window.partitionBy(*by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("offset", F.coalesce(F.sum("n").over(earlier), F.lit(0).cast("long")))


def placed(leaves: DataFrame, tree: str, order: str, leaf: str, carry: list[str], depth: int = DEPTH) -> DataFrame:
    """Leaves with ``t`` (number of the tree), ``pos`` and ``n`` (size of the tree), stored.

    ``trees`` is the number of trees, ``g`` the leaf partition: some blocks of leaves.
    """
    named = rows.stored(
        leaves.select(
            F.col(tree).isNotNull().alias("has"),
            F.coalesce(F.col(tree).cast("string"), F.lit("")).alias("value"),
            F.col(order).alias("id"),
            F.col(leaf).alias("leaf"),
            *[F.col(c).alias(f"carry_{c}") for c in carry],
            F.monotonically_increasing_id().alias("row"),
        ),
        "leaves",
    )
    kept = [f"carry_{c}" for c in carry]
    key = ["has", "value"]
    # Equal rows end in different partitions by their row number, so copies don't pile up.
    ranked = _ordered(named, [*key, "id", "leaf", "row"], "ordered")
    counts = rows.stored(
        ranked.groupBy("part", *key).agg(F.count("*").alias("n"), F.min("nth").alias("low")), "counts"
    )
    # One row per partition and tree: partitions hold ranges of trees.
    totals = _ordered(counts.groupBy(*key).agg(F.sum("n").alias("size")), key, "trees")
    starts = _before(totals.groupBy("part").agg(F.count("*").alias("n"), F.min("nth").alias("low")), F.lit(0))
    trees = totals.join(F.broadcast(starts.select("part", "offset", "low")), "part").select(
        *key, "size", (F.col("offset") + F.col("nth") - F.col("low")).alias("t")
    )
    count = totals.count()
    offsets = _before(counts, *key).join(trees, key).select("part", *key, "low", "offset", "size", "t")
    total = ranked.count()
    groups = max(-(-total // GROUP_ROWS), leaves.sparkSession.sparkContext.defaultParallelism)
    pos = F.col("offset") + F.col("nth") - F.col("low")
    return rows.stored(
        ranked.join(offsets, ["part", *key])
        .select("t", pos.alias("pos"), F.col("size").alias("n"), F.lit(count).cast("long").alias("trees"), "id", "leaf", *kept)
        .withColumn("g", F.pmod(F.xxhash64("t", F.shiftright("pos", ARITY_BITS * depth)), F.lit(groups)).cast("int")),
        "placed",
    )


def _raise(base: int, depth: int):
    """A function from nodes of level ``base`` (``t, pos, n, digest``) to those of the next levels."""

    def run(table: pa.Table) -> pa.Table:
        t, pos, n = (table.column(c).to_numpy() for c in ("t", "pos", "n"))
        order = np.lexsort((pos, t))
        t, pos, n = t[order], pos[order], n[order]
        data = table.column("digest").take(pa.array(order)).to_pylist()
        block = pos >> (ARITY_BITS * depth)
        edge = np.flatnonzero(np.r_[True, (t[1:] != t[:-1]) | (block[1:] != block[:-1])]) if len(t) else []
        out = []
        for low, high in zip(edge, [*edge[1:], len(t)]):
            tree, first, size, now = int(t[low]), int(pos[low]), int(n[low]), data[low:high]
            for level in range(base + 1, base + 1 + depth):
                if size == 1:
                    break
                now = [_hash(b"".join(now[k : k + ARITY])) for k in range(0, len(now), ARITY)]
                first, size = first >> ARITY_BITS, _up(size)
                out += [(tree, level, first + k, size, d) for k, d in enumerate(now)]
        return pa.Table.from_arrays(
            [pa.array(x, k) for x, k in zip(zip(*out) if out else [()] * 5, _NODE.types)], schema=_NODE
        )

    return run


_NODE = pa.schema(
    [("t", pa.int64()), ("level", pa.int32()), ("pos", pa.int64()), ("n", pa.int64()), ("digest", pa.binary())]
)
_NODE_DDL = "t long, level int, pos long, n long, digest binary"


def raised(leaves: DataFrame, most: int, depth: int = DEPTH) -> DataFrame:
    """All interior nodes over ``leaves`` (``t, pos, n, digest``); ``most`` is the largest ``n``."""
    rows.ship(leaves.sparkSession)
    base, now, out = 0, leaves, None
    while most > 1:
        total = max(1, now.count())
        groups = max(-(-total // GROUP_ROWS), leaves.sparkSession.sparkContext.defaultParallelism)
        block = F.pmod(F.xxhash64("t", F.shiftright("pos", ARITY_BITS * depth)), F.lit(groups))
        made = now.where("n > 1").select("t", "pos", "n", "digest").groupBy(block.alias("g"))
        level = rows.stored(made.applyInArrow(_raise(base, depth), _NODE_DDL), "nodes")
        out = level if out is None else out.unionByName(level)
        base += depth
        now = level.where(F.col("level") == base)
        most = -(-most // ARITY**depth)
    if out is None:
        return leaves.select("t", F.lit(0).alias("level"), "pos", "n", "digest").where("false")
    return out


def build(
    leaves: DataFrame,
    tree: str = "lang",
    order: str = "doc_id",
    leaf: str = "leaf",
    carry: list[str] | None = None,
    depth: int = DEPTH,
) -> tuple[DataFrame, DataFrame]:
    """The manifest: placed leaves, and all nodes but them (``t, level, pos, n, digest``).

    Tree ``TOP`` has the subroots as its level 0.
    """
    own = placed(leaves, tree, order, leaf, list(carry or ()), depth)
    top = own.agg(F.max("n"), F.max("trees")).first()
    inner = raised(own.select("t", "pos", "n", F.col("leaf").alias("digest")), top[0] or 0, depth)
    lone = own.where("n = 1").select("t", F.col("leaf").alias("digest"))
    subroots = inner.where("n = 1").select("t", "digest").unionByName(lone)
    zero = rows.stored(
        subroots.select(
            F.lit(TOP).cast("long").alias("t"), F.lit(0).alias("level"), F.col("t").alias("pos"),
            F.lit(top[1] or 0).cast("long").alias("n"), "digest",
        ),
        "subroots",
    )
    return own, inner.unionByName(zero).unionByName(raised(zero, top[1] or 0, depth))


def missing(known: np.ndarray, n: int) -> list[tuple[int, np.ndarray]]:
    """Octopus: per level, the nodes that the paths of leaves ``known`` need and can't derive."""
    out = []
    for level, size in enumerate(_sizes(n)[:-1]):
        parents = np.unique(known >> ARITY_BITS)
        children = (parents[:, None] << ARITY_BITS) + np.arange(ARITY)
        children = children[children < size]
        lack = np.setdiff1d(children, known, assume_unique=True)
        if len(lack):
            out.append((level, lack))
        known = parents
    return out


def _by_tree(t: np.ndarray, pos: np.ndarray):
    """Row indexes of each tree in the order of position."""
    order = np.lexsort((pos, t))
    if not len(order):
        return
    cut = np.flatnonzero(np.r_[True, t[order][1:] != t[order][:-1]])
    for low, high in zip(cut, [*cut[1:], len(order)]):
        yield int(t[order[low]]), order[low:high]


def _requests(table: pa.Table) -> pa.Table:
    g, t, pos, n, trees = (table.column(c).to_numpy() for c in ("g", "t", "pos", "n", "trees"))
    found, seen = [], []
    for tree, at in _by_tree(t, pos):
        seen.append(tree)
        found += [(tree, *x) for x in missing(pos[at], int(n[at[0]]))]
    if seen:
        found += [(TOP, *x) for x in missing(np.array(seen), int(trees[0]))]
    size = [len(x) for _, _, x in found]
    return pa.table(
        {
            "g": pa.array(np.full(sum(size), g[0] if len(g) else 0), pa.int32()),
            "t": pa.array(np.repeat([x[0] for x in found], size).astype(np.int64)),
            "level": pa.array(np.repeat([x[1] for x in found], size).astype(np.int32)),
            "pos": pa.array(np.concatenate([x[2] for x in found]).astype(np.int64) if found else np.zeros(0, np.int64)),
        }
    )


class _Tree:
    """The runs of nodes over some leaves of a tree, from known and fetched digests."""

    def __init__(self, known: dict[int, bytes], n: int, fetched: dict[tuple[int, int], bytes]):
        self.sizes = _sizes(n)
        self.runs: list[dict[int, bytes]] = []
        for level, size in enumerate(self.sizes[:-1]):
            runs = {}
            for parent in {p >> ARITY_BITS for p in known}:
                first = parent << ARITY_BITS
                run = range(first, min(first + ARITY, size))
                runs[parent] = b"".join(known[p] if p in known else fetched[level, p] for p in run)
            self.runs.append(runs)
            known = {parent: _hash(run) for parent, run in runs.items()}
        self.top = next(iter(known.values()))
        self._paths: dict[tuple[int, int], bytes] = {}

    def proof(self, pos: int, level: int = 0) -> bytes:
        """Siblings from a node to the top; what nodes share is put together once."""
        if level == len(self.runs):
            return b""
        path = self._paths.get((level, pos)) if level else None
        if path is None:
            run, place = self.runs[level][pos >> ARITY_BITS], 32 * (pos & (ARITY - 1))
            path = run[:place] + run[place + 32 :] + self.proof(pos >> ARITY_BITS, level + 1)
            if level:
                self._paths[level, pos] = path
        return path


def _expand(leaves: pa.Table, fetched: pa.Table) -> pa.Table:
    t, pos, n, trees = (leaves.column(c).to_numpy() for c in ("t", "pos", "n", "trees"))
    given: dict[int, dict] = {}
    for tree, level, p, d in zip(*(fetched.column(c).to_pylist() for c in ("t", "level", "pos", "digest"))):
        given.setdefault(tree, {})[level, p] = d
    digest = leaves.column("leaf").to_pylist()
    below, tops = {}, {}
    groups = list(_by_tree(t, pos))
    for tree, at in groups:
        below[tree] = _Tree({int(pos[k]): digest[k] for k in at}, int(n[at[0]]), given.get(tree, {}))
        tops[tree] = below[tree].top
    above = _Tree(dict(tops), int(trees[0]), given.get(TOP, {})) if groups else None
    rest = {tree: above.proof(tree) for tree in below}
    kept, parts = leaves.drop_columns(["g"]).combine_chunks(), []
    # In parts, each sent as a batch: neither side holds all proofs as one buffer.
    for low in range(0, len(t), rows.BATCH_ROWS):
        part, own = kept.slice(low, rows.BATCH_ROWS), [int(x) for x in t[low : low + rows.BATCH_ROWS]]
        proof = [below[x].proof(int(p)) + rest[x] for x, p in zip(own, pos[low : low + rows.BATCH_ROWS])]
        new = {"subroot": [below[x].top for x in own], "root": [above.top] * len(own), "proof": proof}
        for name, values in new.items():
            part = part.append_column(name, pa.array(values, pa.binary()))
        parts.append(part)
    if parts:
        return pa.concat_tables(parts)
    for name in ("subroot", "root", "proof"):
        kept = kept.append_column(name, pa.array([], pa.binary()))
    return kept


def prove(
    leaves: DataFrame,
    tree: str = "lang",
    order: str = "doc_id",
    leaf: str = "leaf",
    carry: list[str] | None = None,
    depth: int = DEPTH,
) -> DataFrame:
    """One row per row of ``leaves``: ``id``, ``leaf``, ``t``, ``pos``, ``n``, ``trees``, ``subroot``, ``root``,
    ``proof`` (siblings' digests, 32 bytes each) and the columns ``carry``.

    ``leaf`` is a column of 32 bytes, as ``leaf_of`` makes it.
    """
    carry = list(carry or ())
    own, nodes = build(leaves, tree, order, leaf, carry, depth)
    asked = own.select("g", "t", "pos", "n", "trees").groupBy("g").applyInArrow(
        _requests, "g int, t long, level int, pos long"
    )
    asked = rows.stored(asked, "asked")
    fetched = rows.stored(
        asked.join(nodes.drop("n"), ["t", "level", "pos"]).select("g", "t", "level", "pos", "digest"), "fetched"
    )
    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in own.drop("g").schema.fields)
    found = (
        own.groupBy("g")
        .cogroup(fetched.groupBy("g"))
        .applyInArrow(_expand, f"{kept}, subroot binary, root binary, proof binary")
    )
    return found.withColumnsRenamed({f"carry_{c}": c for c in carry})


def folded(leaf: bytes, pos: int, n: int, tree: int, trees: int, proof: bytes) -> bytes:
    """The root that a leaf and its proof lead to."""
    now, at = leaf, 0
    for place, size in ((pos, n), (tree, trees)):
        while size > 1:
            others = 32 * (min(ARITY, size - (place & ~(ARITY - 1))) - 1)
            own = at + 32 * (place & (ARITY - 1))
            now = _hash(proof[at:own] + now + proof[own : at + others])
            at, place, size = at + others, place >> ARITY_BITS, _up(size)
    return now


def verify(proofs: DataFrame, leaf: str = "leaf") -> DataFrame:
    """``proofs`` with ``folded_root``, recomputed from the column ``leaf`` and the siblings, and
    ``verified``: it is the root."""

    def make():
        def work(*columns: pa.Array):
            values = [c.to_pylist() for c in columns]
            return [pa.array([folded(*x) for x in zip(*values)], pa.binary())]

        return work

    found = rows.append(proofs, [leaf, "pos", "n", "t", "trees", "proof"], make, "folded_root binary")
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


def digest(verified: DataFrame) -> DataFrame:
    """The columns of ``verify`` as hexadecimal text, the proof by its digest."""

    def text(column: str) -> Column:
        return F.lower(F.hex(column))

    return verified.select(
        F.col("id").alias("doc_id"),
        *[text(c).alias(c) for c in ("leaf", "subroot", "root")],
        F.sha2(text("proof"), 256).alias("proof_sha256"),
        text("folded_root").alias("folded_root"),
        "verified",
    )
