"""Hard negatives from blocks in Hilbert order, chosen by zone maps.

Vectors are quantised to whole numbers, so scores (inner products) are exact. Anchors are the
rows whose id is divisible by ``EVERY``. An anchor's positives are its ``POSITIVES`` best other
rows of its label; for each, the hard negatives are the ``NEGATIVES`` best rows of another label
whose score lies between ``LOW`` and ``HIGH`` hundredths of the positive's.

Rows are ordered by label and by their place on a Hilbert curve through the dimensions of
largest variance, and written as Parquet blocks of up to ``BLOCK`` rows of one label. Each block
carries the least and largest value of every dimension. By interval arithmetic they bound
the score of an anchor with any row of the block: sum over dimensions of the smaller, or the larger,
of a*least and a*largest. Some consecutive blocks make a shelf, whose zone map covers
theirs. An anchor is sent to the shelves that its label and bounds allow; there each block is
opened for those anchors alone whose bounds allow it:

* positives: blocks of the anchor's label whose upper bound reaches the fifth best score known so
  far, first that of the anchor's own block, which needs no shuffle;
* negatives: blocks of other labels whose bounds meet one of the anchor's windows, and whose upper
  bound reaches the third best score known so far in it.

Tasks send on only the best few of each shelf, which are merged by a window function. The zone
maps of shelves are broadcast: at most ``SHELVES`` of them and one for each partition, 1 kB for
64 dimensions. Anchors are dealt into slices of at most ``SLICE``, so a task holds one shelf and one
slice. All anchors meet all blocks that their bounds allow; nothing is sampled.

Rows without label or vector, or with a component that is null or not finite, take no part.
Shorter vectors count as padded with zeros. Components and scores saturate at 64 bits. Ties go to the smaller id, null ids last;
rows with the same id are different rows. An empty table, or one without anchors, gives no rows.
Only named columns are read, so others may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from twinkeep.llm import rows

EVERY, POSITIVES, NEGATIVES, LOW, HIGH = 50, 5, 3, 50, 95
SCALE = 256.0
BLOCK, SHELF, SHELVES, SLICE = 1024, 64, 1 << 16, 1 << 16
#: Dimensions and bits of the curve: together 64 bits.
CURVE_DIMENSIONS, CURVE_BITS = 16, 4
#: Windows of a block looked at together.
WINDOWS = 1024

_NONE = np.iinfo(np.int64).max


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of points with ``bits`` bits per dimension, as an unsigned number.

    Gray-code form (Skilling, 2004): undo the rotations from the highest bit down, then read the
    bits of all dimensions across.
    """
    x = cells.astype(np.uint64).T.copy()
    dims = len(x)
    one = np.uint64(1)
    for b in range(bits - 1, 0, -1):
        q = one << np.uint64(b)
        low = q - one
        for i in range(dims):
            set_ = (x[i] & q) != 0
            swap = np.where(set_, np.uint64(0), (x[0] ^ x[i]) & low)
            x[0] ^= np.where(set_, low, swap)
            x[i] ^= swap
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    flip = np.zeros(x.shape[1], np.uint64)
    for b in range(bits - 1, 0, -1):
        q = one << np.uint64(b)
        flip ^= np.where((x[-1] & q) != 0, q - one, np.uint64(0))
    x ^= flip
    place = np.zeros(x.shape[1], np.uint64)
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            place = (place << one) | ((x[i] >> np.uint64(b)) & one)
    return place


def _matrix(lists: pa.Array, width: int) -> np.ndarray:
    """Vectors of a list column as rows, padded with zeros."""
    bounds = lists.offsets.to_numpy()
    size = np.diff(bounds)
    out = np.zeros((len(lists), width), np.int64)
    own = np.repeat(np.arange(len(lists)), size)
    values = lists.values.to_numpy(zero_copy_only=False)[bounds[0] : bounds[-1]]
    out[own, np.arange(len(values)) - np.repeat(bounds[:-1] - bounds[0], size)] = values
    return out


def _most(x: np.ndarray) -> int:
    return max(abs(int(x.min())), abs(int(x.max()))) if x.size else 0


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of two integer matrices."""
    bound = max(1, a.shape[1]) * _most(a) * _most(b)
    if bound < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if bound < 1 << 62:
        return a.astype(np.int64) @ b.astype(np.int64).T
    return a.astype(object) @ b.astype(object).T


def bounds(a: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest product of the rows of ``a`` with anything between ``lo`` and ``hi``."""
    up, down = np.maximum(a, 0), np.minimum(a, 0)
    return products(up, lo) + products(down, hi), products(up, hi) + products(down, lo)


def best(score: np.ndarray, able: np.ndarray, ids: np.ndarray, none: np.ndarray, k: int):
    """Per row of ``score`` the columns of its k best ``able`` entries; ties by ``none``, then ``ids``.

    Returns rows and columns, each row's in order of rank.
    """
    order = np.lexsort((ids, none))
    score, able = score[:, order], able[:, order]
    width = score.shape[1]
    if score.dtype == object or _most(score) >= 1 << 50:
        at, col = [], []
        for r in range(len(score)):
            mine = sorted(np.flatnonzero(able[r]).tolist(), key=lambda c: (-int(score[r, c]), c))[:k]
            at += [r] * len(mine)
            col += mine
        return np.array(at, np.int64), order[np.array(col, np.int64)]
    # Score and place as one number: the larger, the better.
    joint = np.where(able, score * width + np.arange(width - 1, -1, -1), -_NONE)
    if k < width:
        col = np.argpartition(-joint, k - 1, axis=1)[:, :k]
    else:
        col = np.broadcast_to(np.arange(width), joint.shape)
    mine = np.take_along_axis(joint, col, axis=1)
    sort = np.argsort(-mine, axis=1, kind="stable")
    col, mine = np.take_along_axis(col, sort, axis=1), np.take_along_axis(mine, sort, axis=1)
    at, rank = np.nonzero(mine > -_NONE)
    return at, order[col[at, rank]]


def usable(frame: DataFrame, vec_id: str, vector: str, label: str) -> DataFrame:
    """Rows that take part: ``row``, ``id``, ``label``, ``q`` (whole numbers)."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != F.lit(float("inf"))))
    return frame.where(F.col(label).isNotNull() & F.col(vector).isNotNull() & fine).select(
        F.monotonically_increasing_id().alias("row"),
        F.col(vec_id).cast("long").alias("id"),
        F.col(label).cast("long").alias("label"),
        F.transform(vector, lambda x: F.floor(F.lit(SCALE) * x.cast("double")).cast("long")).alias("q"),
    )


def _statistics(named: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Variance, mean and deviation of every dimension over all rows; one row per batch and dimension."""

    def make():
        def work(q: pa.Array):
            x = _matrix(q, width).astype(np.float64)
            return [np.arange(width), np.full(width, len(x)), x.sum(axis=0), (x * x).sum(axis=0)]

        return work

    parts = rows.generate(named, ["q"], make, "d int, n long, s double, s2 double")
    sums = parts.groupBy("d").agg(F.sum("n"), F.sum("s"), F.sum("s2")).orderBy("d").collect()
    n, s, s2 = (np.array([float(r[k]) for r in sums]) for k in (1, 2, 3))
    mean = s / np.maximum(n, 1)
    variance = np.maximum(s2 / np.maximum(n, 1) - mean * mean, 0)
    return variance, mean, np.sqrt(variance)


def _curve(named: DataFrame, width: int) -> DataFrame:
    """``named`` with ``curve``: the place of a row on the Hilbert curve."""
    variance, mean, deviation = _statistics(named, width)
    chosen = np.sort(np.argsort(-variance, kind="stable")[:CURVE_DIMENSIONS])
    mean, deviation = mean[chosen], np.maximum(deviation[chosen], 1e-9)
    cells = 1 << CURVE_BITS

    def make():
        def work(q: pa.Array):
            x = (_matrix(q, width)[:, chosen] - mean) / deviation
            cell = np.clip(np.floor((x + 2) / 4 * cells), 0, cells - 1).astype(np.int64)
            place = hilbert(cell, CURVE_BITS) if len(chosen) else np.zeros(len(x), np.uint64)
            return [(place ^ np.uint64(1 << 63)).view(np.int64)]

        return work

    return rows.append(named, ["q"], make, "curve long")


_BLOCK_DDL = (
    "shelf long, block long, label long, n int, ids binary, none binary, rows binary, "
    "kind string, vectors binary, lo array<long>, hi array<long>"
)
_LONGS = pa.list_(pa.int64())
_BLOCK = pa.schema(
    [("shelf", pa.int64()), ("block", pa.int64()), ("label", pa.int64()), ("n", pa.int32())]
    + [(c, pa.binary()) for c in ("ids", "none", "rows")]
    + [("kind", pa.string()), ("vectors", pa.binary()), ("lo", _LONGS), ("hi", _LONGS)]
)


def _packed(batches: Iterator[pa.RecordBatch], width: int, shelf: int) -> Iterator[pa.RecordBatch]:
    """Blocks of one label from sorted rows."""
    part, count, held = None, 0, None

    def block(table: pa.Table) -> pa.RecordBatch:
        nonlocal count
        q = _matrix(table.column("q").combine_chunks(), width)
        most = _most(q)
        kind = "int16" if most < 1 << 15 else "int32" if most < 1 << 31 else "int64"
        ids = table.column("id").combine_chunks()
        row = [
            (part << 33) | (count // shelf), (part << 33) | count, table.column("label")[0].as_py(), len(q),
            ids.fill_null(_NONE).to_numpy().tobytes(), ids.is_null().to_numpy(zero_copy_only=False).astype(np.uint8).tobytes(),
            table.column("row").to_numpy().tobytes(), kind, q.astype(kind).tobytes(),
            q.min(axis=0).tolist(), q.max(axis=0).tolist(),
        ]
        count += 1
        return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, _BLOCK)], schema=_BLOCK)

    def cut(table: pa.Table, last: bool) -> Iterator[pa.RecordBatch]:
        nonlocal held
        label = table.column("label").to_numpy()
        edges = [0, *(np.flatnonzero(label[1:] != label[:-1]) + 1).tolist(), len(label)]
        for low, high in zip(edges, edges[1:]):
            while high - low >= BLOCK or (low < high and (last or high < len(label))):
                yield block(table.slice(low, min(BLOCK, high - low)))
                low += min(BLOCK, high - low)
        held = table.slice(low) if low < len(label) else None

    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        part = table.column("part")[0].as_py()
        yield from cut(pa.concat_tables([held, table]) if held is not None else table, False)
    if held is not None:
        yield from cut(held, True)


def write_blocks(named: DataFrame, width: int) -> DataFrame:
    """The rows as Parquet blocks in label and curve order, with their zone maps."""
    total = named.count()
    shelf = max(SHELF, -(-total // (BLOCK * SHELVES)))
    rows.ship(named.sparkSession)
    order = ["label", "curve", "id", "row"]
    ranged = (
        rows.stored(_curve(named, width), "curve")
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("part", F.spark_partition_id().cast("long"))
    )
    return rows.stored(ranged.mapInArrow(lambda batches: _packed(batches, width, shelf), _BLOCK_DDL), "blocks")


class Block:
    """A row of the block table as arrays."""

    def __init__(self, row: dict):
        self.label = row["label"]
        self.ids = np.frombuffer(row["ids"], np.int64)
        self.none = np.frombuffer(row["none"], np.uint8)
        self.rows = np.frombuffer(row["rows"], np.int64)
        self.q = np.frombuffer(row["vectors"], row["kind"]).reshape(len(self.ids), -1)
        self.lo, self.hi = (np.array(row[c], np.int64)[None, :] for c in ("lo", "hi"))


_ANCHOR = "anchor long, anchor_id long, label long, q array<long>, floor long"


def _long(x) -> int:
    return max(-_NONE, min(_NONE, int(x)))


def _anchors(blocks: DataFrame, every: int, positives: int) -> DataFrame:
    """Anchors with ``floor``: the score of the last positive that their own block has, else null."""

    def make():
        def work(*columns: pa.Array):
            out = []
            for row in pa.RecordBatch.from_arrays(list(columns), names).to_pylist():
                b = Block(row)
                at = np.flatnonzero((b.none == 0) & (b.ids % every == 0))
                if not len(at):
                    continue
                score = products(b.q[at], b.q)
                able = np.ones(score.shape, bool)
                able[np.arange(len(at)), at] = False
                line, col = best(score, able, b.ids, b.none, positives)
                have = np.bincount(line, minlength=len(at))
                ends = np.cumsum(have) - 1
                for k, place in enumerate(at.tolist()):
                    floor = _long(score[k, col[ends[k]]]) if have[k] == positives else None
                    out.append((int(b.rows[place]), int(b.ids[place]), b.label, b.q[place].tolist(), floor))
            return [list(x) for x in zip(*out)] if out else [[]] * 5

        return work

    names = ["label", "ids", "none", "rows", "kind", "vectors", "lo", "hi"]
    return rows.stored(rows.generate(blocks, names, make, _ANCHOR), "anchors")


class Zones:
    """Zone maps of shelves, on the driver and broadcast: at most SHELVES and one per partition."""

    def __init__(self, blocks: DataFrame, width: int):
        per = [F.min(F.col("lo")[d]).alias(f"lo{d}") for d in range(width)]
        per += [F.max(F.col("hi")[d]).alias(f"hi{d}") for d in range(width)]
        found = (
            blocks.select("shelf", "label", "lo", "hi")
            .groupBy("shelf")
            .agg(F.min("label").alias("first"), F.max("label").alias("last"), *per)
            .toArrow()
        )
        self.shelf, self.first, self.last = (found.column(c).to_numpy() for c in ("shelf", "first", "last"))
        shape = (len(self.shelf), width)
        self.lo = np.array([found.column(f"lo{d}").to_numpy() for d in range(width)], np.int64).T.reshape(shape)
        self.hi = np.array([found.column(f"hi{d}").to_numpy() for d in range(width)], np.int64).T.reshape(shape)


def _sent(asked: DataFrame, zones, width: int, slices: int, allowed) -> DataFrame:
    """A row of ``asked`` for each shelf that ``allowed(lower, upper, row, label range)`` lets it read."""
    shared = asked.sparkSession.sparkContext.broadcast(zones)
    columns = asked.columns

    def make():
        z = shared.value

        def work(*values: pa.Array):
            table = pa.Table.from_arrays(list(values), columns)
            q = _matrix(table.column("q").combine_chunks(), width)
            out = []
            for low in range(0, len(q), WINDOWS):
                lower, upper = bounds(q[low : low + WINDOWS], z.lo, z.hi)
                some = table.slice(low, WINDOWS)
                fit = allowed(some, lower, upper, z.first, z.last)
                line, shelf = np.nonzero(fit)
                out.append(some.take(pa.array(line)).append_column("shelf", pa.array(z.shelf[shelf])))
            if not out:
                return [[]] * (len(columns) + 1)
            return [c.combine_chunks() for c in pa.concat_tables(out).columns]

        return work

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in asked.schema.fields)
    return rows.generate(asked, columns, make, f"{kinds}, shelf long").withColumn(
        "slice", F.pmod(F.xxhash64("anchor"), F.lit(slices)).cast("int")
    )


def _met(blocks: DataFrame, sent: DataFrame, slices: int, pair, fields: str) -> DataFrame:
    """``pair(blocks of a shelf, anchors sent to it)`` for every shelf and slice of anchors.

    Both sides' keys have the same types: equal numbers of other types hash to other partitions.
    """
    all_ = F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice")
    left = blocks.select("*", all_).groupBy("shelf", "slice")
    return left.cogroup(sent.groupBy("shelf", "slice")).applyInArrow(pair, fields)


def _best_of(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.col("id").isNull(), "id", "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _blocks_of(table: pa.Table) -> Iterator[Block]:
    for k in range(table.num_rows):
        yield Block(table.slice(k, 1).to_pylist()[0])


_FOUND = pa.schema([("anchor", pa.int64()), ("positive", pa.int32()), ("row", pa.int64()), ("id", pa.int64()), ("score", pa.int64())])
_FOUND_DDL = "anchor long, positive int, row long, id long, score long"


def _table(out: list[tuple]) -> pa.Table:
    """Rows of (anchors, positive numbers, block, columns, scores) as a table."""
    if not out:
        return _FOUND.empty_table()
    parts = [np.concatenate([x[k] for x in out]) for k in range(6)]
    ids = pa.array(parts[3], pa.int64(), mask=parts[4].astype(bool))
    return pa.Table.from_arrays(
        [pa.array(parts[0]), pa.array(parts[1].astype(np.int32)), pa.array(parts[2]), ids, pa.array(parts[5].astype(np.int64))],
        schema=_FOUND,
    )


def _clip(score: np.ndarray) -> np.ndarray:
    return np.array([_long(s) for s in score], np.int64) if score.dtype == object else score


def _floors(table: pa.Table) -> np.ndarray:
    return table.column("floor").combine_chunks().fill_null(-_NONE).to_numpy().copy()


def _positives(width: int, k: int):
    def run(blocks: pa.Table, asked: pa.Table) -> pa.Table:
        if not asked.num_rows or not blocks.num_rows:
            return _FOUND.empty_table()
        q = _matrix(asked.column("q").combine_chunks(), width)
        anchor, label = asked.column("anchor").to_numpy(), asked.column("label").to_numpy()
        floor, out = _floors(asked), []
        for b in _blocks_of(blocks):
            _, upper = bounds(q, b.lo, b.hi)
            use = np.flatnonzero((label == b.label) & (upper[:, 0] >= floor))
            for low in range(0, len(use), WINDOWS):
                at = use[low : low + WINDOWS]
                score = products(q[at], b.q)
                line, col = best(score, b.rows[None, :] != anchor[at][:, None], b.ids, b.none, k)
                values = _clip(score[line, col])
                out.append((anchor[at][line], np.zeros(len(line)), b.rows[col], b.ids[col], b.none[col], values))
                full = np.flatnonzero(np.bincount(line, minlength=len(at)) == k)
                if len(full):  # the last of k in one block is a floor for the others
                    ends = np.cumsum(np.bincount(line, minlength=len(at))) - 1
                    floor[at[full]] = np.maximum(floor[at[full]], values[ends[full]])
        return _table(out)

    return run


def window(score: int, low: int, high: int) -> tuple[int, int]:
    """The whole numbers x with low * score <= 100 * x <= high * score."""
    return -((-low * score) // 100), (high * score) // 100


def _windows(asked: pa.Table, low: int, high: int):
    """Anchor's row in ``asked``, number and bounds of every window that can hold something."""
    line, number, lo, hi = [], [], [], []
    for k, scores in enumerate(asked.column("scores").to_pylist()):
        for j, s in enumerate(scores):
            a, b = window(s, low, high)
            if a <= b:
                line.append(k)
                number.append(j)
                lo.append(_long(a))
                hi.append(_long(b))
    return tuple(np.array(x, np.int64) for x in (line, number, lo, hi))


def _negatives(width: int, k: int, low: int, high: int):
    def run(blocks: pa.Table, asked: pa.Table) -> pa.Table:
        if not asked.num_rows or not blocks.num_rows:
            return _FOUND.empty_table()
        q = _matrix(asked.column("q").combine_chunks(), width)
        anchor, label = asked.column("anchor").to_numpy(), asked.column("label").to_numpy()
        line, number, lo, hi = _windows(asked, low, high)
        floor, out = lo.copy(), []
        for b in _blocks_of(blocks):
            lower, upper = bounds(q, b.lo, b.hi)
            use = np.flatnonzero((label[line] != b.label) & (upper[line, 0] >= floor) & (lower[line, 0] <= hi))
            if not len(use):
                continue
            mine, own = np.unique(line[use], return_inverse=True)
            for first in range(0, len(mine), WINDOWS):
                score = products(q[mine[first : first + WINDOWS]], b.q)
                some = use[(own >= first) & (own < first + WINDOWS)]
                place = own[(own >= first) & (own < first + WINDOWS)] - first
                for at in range(0, len(some), WINDOWS):
                    w, s = some[at : at + WINDOWS], score[place[at : at + WINDOWS]]
                    able = (s >= floor[w][:, None]) & (s <= hi[w][:, None])
                    got, col = best(s, able, b.ids, b.none, k)
                    values = _clip(s[got, col])
                    out.append((anchor[line[w]][got], number[w][got], b.rows[col], b.ids[col], b.none[col], values))
                    have = np.bincount(got, minlength=len(w))
                    full = np.flatnonzero(have == k)
                    ends = np.cumsum(have) - 1
                    floor[w[full]] = np.maximum(floor[w[full]], values[ends[full]])
        return _table(out)

    return run


def mine(
    frame: DataFrame,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    every: int = EVERY,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    low: int = LOW,
    high: int = HIGH,
) -> DataFrame:
    """Rows ``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``."""
    named = rows.stored(usable(frame, vec_id, vector, label), "vectors")
    width = named.agg(F.max(F.size("q"))).first()[0] or 0
    blocks = write_blocks(named, width)
    anchors = _anchors(blocks, every, positives)
    slices = max(1, -(-anchors.count() // SLICE))
    zones = Zones(blocks, width)

    def may_be_positive(some, lower, upper, first, last):
        own = some.column("label").to_numpy()[:, None]
        return (first <= own) & (own <= last) & (upper >= _floors(some)[:, None])

    sent = _sent(anchors, zones, width, slices, may_be_positive)
    found = _met(blocks, sent, slices, _positives(width, positives), _FOUND_DDL)
    top = rows.stored(_best_of(found, ["anchor"], positives).select("anchor", "rank", "id", "score"), "positives")
    # At most ``positives`` entries per anchor.
    chosen = top.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("rank", "score", "id"))).alias("p"))
    asked = rows.stored(
        anchors.join(chosen, "anchor").select(
            "anchor", "anchor_id", "label", "q", F.col("p")["score"].alias("scores"), F.col("p")["id"].alias("ids")
        ),
        "asked",
    )

    def may_hold_negatives(some, lower, upper, first, last):
        line, _, lo, hi = _windows(some, low, high)
        own = some.column("label").to_numpy()
        fit = np.zeros(lower.shape, bool)
        hit = (upper[line] >= lo[:, None]) & (lower[line] <= hi[:, None])
        np.logical_or.at(fit, line, hit)
        return fit & ~((first == last) & (first == own[:, None]))

    sent = _sent(asked.select("anchor", "label", "q", "scores"), zones, width, slices, may_hold_negatives)
    found = _met(blocks, sent, slices, _negatives(width, negatives, low, high), _FOUND_DDL)
    hard = rows.stored(_best_of(found, ["anchor", "positive"], negatives), "negatives")
    return hard.join(asked.select("anchor", "anchor_id", "scores", "ids"), "anchor").select(
        "anchor_id",
        F.col("ids")[F.col("positive")].alias("positive_id"),
        F.col("rank").cast("int").alias("rank"),
        F.col("id").alias("negative_id"),
        F.col("scores")[F.col("positive")].alias("positive_score"),
        F.col("score").alias("negative_score"),
    )
