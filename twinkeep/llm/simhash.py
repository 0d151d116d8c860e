"""Near copies by SimHash, with pigeonring filtering of the candidates.

A text's fingerprint is 64 majority bits over its shingle hashes. Two fingerprints
link when at most ``RADIUS`` bits differ; classes are the connected components.

Candidates: the 64 bits form a ring of five segments. If two fingerprints differ in
at most four bits, there is a segment from which every chain of l consecutive
segments differs in at most 4*l/5 bits: none in the first, one in two, two in three,
three in four (the strong form of the pigeonring principle; Qin and Xiao, 2018).
So rows meet by the first segment (five rows per distinct fingerprint are shuffled),
inside a task only those are paired whose second segment is equal or one bit away
(a sorted lookup of 14 values, not all pairs), longer chains prune the rest, and the
full distance is checked last.

Equal fingerprints are folded first, so copies never pair. A first segment that
holds far more fingerprints than the mean is split by its second segment, with the
one-bit neighbours sent along. Tasks emit a spanning forest of the links they found,
not the links: as many rows as fingerprints at most.

Null, empty and blank texts have the fingerprint zero and link like any other. Null
ids are ignored when the smallest id is taken; a class without ids has none.
Repeated rows each give their row. Very long texts are hashed whole.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinkeep.llm import graph, rows

SHINGLE, SEED, RADIUS = 4, 42, 4

WIDTHS = (13, 13, 13, 13, 12)
SHIFTS = tuple(accumulate((0, *WIDTHS[:-1])))
SEGMENTS = len(WIDTHS)

#: A first segment with more fingerprints than this and than four times the mean is split.
SPLIT_ABOVE = 4096
#: Rows per group of the pairing step: bounds the memory of a task.
GROUP_ROWS = 200_000
#: Pairs looked at together: bounds the memory of a task in dense groups.
PAIRS_AT_ONCE = 1 << 20

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint_of(text: bytes, shingle: int = SHINGLE) -> int:
    """The fingerprint of a UTF-8 text as an unsigned number."""
    words = text.translate(_LOWER).split()
    if not words:
        return 0
    whole = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(whole, SEED)
    ends = list(accumulate(len(w) + 1 for w in words))
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter(
        (
            digest(whole[low : high - 1], SEED)
            for low, high in zip([0, *ends], ends[shingle - 1 :])
        ),
        np.uint64,
        len(words) - shingle + 1,
    )
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * ones > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``docs`` with ``simhash``, the fingerprint as a signed long."""

    def make():
        def work(texts: pa.Array):
            data, at = rows.utf8(texts)
            out = np.fromiter(
                (
                    fingerprint_of(data[a:b].tobytes(), shingle)
                    for a, b in zip(at[:-1].tolist(), at[1:].tolist())
                ),
                np.uint64,
                len(at) - 1,
            )
            return [pa.array(out.view(np.int64))]

        return work

    return rows.append(docs, [text], make, "simhash long")


def _segment(i: int):
    return F.shiftrightunsigned("simhash", SHIFTS[i]).bitwiseAND(F.lit((1 << WIDTHS[i]) - 1))


def links(unique: DataFrame) -> DataFrame:
    """Edges ``(a, b)`` that connect all fingerprints within ``RADIUS`` of each other.

    ``unique`` has one row per fingerprint in ``simhash``. The edges are a spanning
    forest of the links found in each task, so their classes are those of all links.
    """
    rows.ship(unique.sparkSession)
    parts = [F.struct(F.lit(i).alias("i"), _segment(i).alias("v")) for i in range(SEGMENTS)]
    keyed = unique.select("simhash", F.inline(F.array(*parts)))
    total = unique.count()
    mean = total / (1 << min(WIDTHS))
    hot = (
        keyed.groupBy("i", "v")
        .count()
        .where(F.col("count") > max(SPLIT_ABOVE, 4 * mean))
        .select("i", "v", F.lit(True).alias("hot"))
    )
    # At most SEGMENTS * 2**13 keys, whatever the input.
    keyed = keyed.join(F.broadcast(hot), ["i", "v"], "left")
    second = F.expr(
        "CASE i "
        + " ".join(
            f"WHEN {i} THEN shiftrightunsigned(simhash, {SHIFTS[j]}) & {(1 << WIDTHS[j]) - 1}"
            for i in range(SEGMENTS)
            for j in [(i + 1) % SEGMENTS]
        )
        + " END"
    )
    width = F.expr(
        "CASE i " + " ".join(f"WHEN {i} THEN {WIDTHS[(i + 1) % SEGMENTS]}" for i in range(SEGMENTS)) + " END"
    )
    sent = keyed.select(
        "simhash", "i", "v", "hot", second.alias("s"), width.alias("width")
    ).select(
        "simhash",
        "i",
        "v",
        F.explode(
            F.when(
                F.col("hot"),
                F.concat(
                    F.array(F.struct(F.col("s").alias("s"), F.lit(False).alias("guest"))),
                    F.expr(
                        "transform(sequence(0, width - 1), j -> named_struct("
                        "'s', s ^ shiftleft(1L, j), 'guest', true))"
                    ),
                ),
            ).otherwise(F.array(F.struct(F.lit(-1).cast("long").alias("s"), F.lit(False).alias("guest"))))
        ).alias("x"),
    ).select("simhash", "i", "v", "x.s", "x.guest")
    groups = max(1, -(-SEGMENTS * total // GROUP_ROWS))
    groups = max(groups, unique.sparkSession.sparkContext.defaultParallelism)
    return (
        sent.withColumn("g", F.pmod(F.xxhash64("i", "v", "s"), F.lit(groups)))
        .groupBy("g")
        .applyInArrow(_pair, "a long, b long")
    )


_RING = np.array(
    [
        [
            sum(((1 << WIDTHS[(i + j) % 5]) - 1) << SHIFTS[(i + j) % 5] for j in range(n))
            for n in range(1, SEGMENTS + 1)
        ]
        for i in range(SEGMENTS)
    ],
    np.uint64,
)


def _pair(table: pa.Table) -> pa.Table:
    code = table.column("simhash").to_numpy().view(np.uint64)
    i = table.column("i").to_numpy().astype(np.int64)
    v = table.column("v").to_numpy().astype(np.int64)
    s = table.column("s").to_numpy().astype(np.int64)
    guest = table.column("guest").to_numpy(zero_copy_only=False)
    own, group = np.unique(code, return_inverse=True)
    forest = np.arange(len(own))
    shifts, widths = np.array(SHIFTS, np.uint64), np.array(WIDTHS)
    nxt = (i + 1) % SEGMENTS
    second = (code >> shifts[nxt]) & ((1 << widths[nxt]) - 1).astype(np.uint64)
    # Whole keys: looked up by the second segment; split keys: by what they were split by.
    place = (i << 13 | v) << 14
    for part, flips in ((s < 0, 1 + max(WIDTHS)), (s >= 0, 1)):
        at = np.flatnonzero(part)
        if not len(at):
            continue
        key = place[at] | (second[at].astype(np.int64) if flips > 1 else (1 << 13) | s[at])
        order = np.lexsort((guest[at], key))
        at, key = at[order], key[order]
        hosts = ~guest[at]
        for flip in range(flips):
            if flip == 0:
                low = np.arange(1, len(at) + 1)
                high = np.searchsorted(key, key, side="right")
                high = np.where(hosts, high, low)  # guests come last and don't pair with each other
            else:
                mask = np.int64(1) << np.int64(flip - 1)
                other = key ^ mask
                use = (key < other) & (flip - 1 < widths[nxt[at]])
                low = np.searchsorted(key, other, side="left")
                high = np.where(use, np.searchsorted(key, other, side="right"), low)
            _join(forest, code, i, group, at, low, high)
    root = _roots(forest)
    far = np.flatnonzero(root != np.arange(len(own)))
    signed = own.view(np.int64)
    return pa.table({"a": signed[far], "b": signed[root[far]]})


def _join(forest, code, i, group, at, low, high) -> None:
    """Unite what links among the pairs (k, low[k]..high[k]) of sorted rows, in slices."""
    count = np.maximum(high - low, 0)
    use = np.flatnonzero(count)
    for first, width in _slices(count[use]):
        rows_ = use[first:width]
        n = count[rows_]
        for offset in range(0, int(n.max()), max(1, PAIRS_AT_ONCE // len(rows_))):
            step = np.clip(n - offset, 0, max(1, PAIRS_AT_ONCE // len(rows_)))
            left = np.repeat(rows_, step)
            inner = np.arange(len(left)) - np.repeat(np.cumsum(step) - step, step)
            right = np.repeat(low[rows_] + offset, step) + inner
            a, b = at[left], at[right]
            differ, ring = code[a] ^ code[b], _RING[i[a]]
            near = np.ones(len(a), bool)
            for length in range(1, SEGMENTS + 1):
                chain = np.bitwise_count(differ & ring[:, length - 1])
                near &= chain <= length * RADIUS // SEGMENTS
            _unite(forest, group[a[near]], group[b[near]])


def _slices(count: np.ndarray):
    """Ranges of rows with about ``PAIRS_AT_ONCE`` pairs, or one row."""
    ends = np.cumsum(count)
    first = 0
    while first < len(count):
        done = ends[first - 1] if first else 0
        last = int(np.searchsorted(ends, done + PAIRS_AT_ONCE, side="right"))
        last = max(last, first + 1)
        yield first, last
        first = last


def _unite(forest: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    while len(a):
        a, b = _roots_of(forest, a), _roots_of(forest, b)
        apart = a != b
        a, b = a[apart], b[apart]
        np.minimum.at(forest, np.maximum(a, b), np.minimum(a, b))


def _roots_of(forest: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    while True:
        up = forest[nodes]
        if np.array_equal(up, nodes):
            return nodes
        nodes = up


def _roots(forest: np.ndarray) -> np.ndarray:
    return _roots_of(forest, np.arange(len(forest)))


def classes(marked: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """One row per fingerprint of ``marked``: ``simhash``, ``root``, ``component_id``.

    ``root`` names the class (its smallest fingerprint), ``component_id`` is its smallest id.

    ``marked`` is read twice and should be a stored table.
    """
    unique = rows.stored(
        marked.groupBy("simhash").agg(F.min(doc_id).alias("least_id")), "fingerprints"
    )
    roots = graph.components(links(unique)).withColumnsRenamed({"node": "simhash"})
    rooted = rows.stored(
        unique.join(roots, "simhash", "left").select(
            "simhash", "least_id", F.coalesce("root", "simhash").alias("root")
        ),
        "roots",
    )
    least = rows.stored(
        rooted.groupBy("root").agg(F.min("least_id").alias("component_id")), "classes"
    )
    return rooted.join(least, "root").select("simhash", "root", "component_id")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``fingerprint`` (hex) and ``component_id``."""
    marked = fingerprints(docs.select(doc_id, text), text).select(
        F.col(doc_id).alias("doc_id"), "simhash"
    )
    marked = rows.stored(marked, "simhash")
    found = rows.stored(classes(marked), "components")
    return marked.join(found, "simhash").select(
        "doc_id",
        F.lower(F.lpad(F.hex("simhash"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each class: its smallest id; among equal ids any one row.

    Columns of any name pass through as they are.
    """
    covered = rows.Covered(docs)
    doc_id, text = covered.at(doc_id), covered.at(text)
    numbered = rows.stored(
        fingerprints(covered.inner, text).withColumn("__row", F.monotonically_increasing_id()), "marked"
    )
    marked = numbered.select(F.col(doc_id).alias("doc_id"), "simhash", "__row")
    found = rows.stored(classes(marked), "components")
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("__row"))
    kept = (
        marked.groupBy("simhash")
        .agg(F.min(order).alias("first"))
        .join(found, "simhash")
        .groupBy("root")
        .agg(F.min("first").alias("first"))
        .select(F.col("first")["__row"].alias("__row"))
    )
    dropped = marked.select("__row").join(rows.stored(kept, "kept"), "__row", "left_anti")
    dropped = rows.stored(dropped, "dropped")
    return covered.back(numbered.join(dropped, "__row", "left_anti"))
