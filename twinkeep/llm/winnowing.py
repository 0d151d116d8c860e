"""Benchmark decontamination by winnowing.

A window is ``WINDOW`` consecutive words of a benchmark item; an item of fewer words
is one window. Texts are winnowed: of every window the k-grams are hashed and those
with the smallest hash are kept. Two texts that share a window share its smallest
k-gram, so every shared window is found (Schleimer, Wilkerson and Aiken, 2003).

Kept k-grams of the benchmark are set in a bit table of fixed size. Tasks that read
documents look their own kept k-grams up in it, extend each hit to all windows that
contain it, and look those up in a second table. What passes (true hits and very few
others) goes into an equi-join with the benchmark's windows on 128 bits of hash, which
decides. The bit tables do not grow with the benchmark; the join is a plain Spark join.

Windows that belong to the same items share one item list, so a passage found in many
documents and many items is expanded once per document, not once per window.

Null and blank texts have no words. Items without id are ignored; an id that occurs
twice is one item with the windows of both texts. Each document row gives one row,
repeated rows and null ids included. Equal k-gram hashes in a window are all kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinkeep.llm import rows

WINDOW = 13
#: log2 of the bits of each table: 4 MB each.
TABLE_BITS = 25
#: A document is contaminated from this share of hit words on: 1 / LEAST_SHARE.
LEAST_SHARE = 20

_U = np.uint64


def _constants(seed: int, n: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 63, n, dtype=np.uint64) * _U(2) + _U(1)


_BYTE = _constants(11, 256)
_BYTE[65:91] = _BYTE[97:123]
_IS_WORD = np.zeros(256, bool)
_IS_WORD[48:58] = _IS_WORD[65:91] = _IS_WORD[97:123] = _IS_WORD[128:] = True
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)
_MASK = (1 << 64) - 1


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown when needed."""

    def __init__(self, base: int):
        self.base, self.inverse = _U(base), _U(pow(base, -1, 1 << 64))
        self.up = self.down = np.ones(1, _U)

    def reach(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            self.up = np.cumprod(np.r_[_U(1), np.full(n - 1, self.base)])
            self.down = np.cumprod(np.r_[_U(1), np.full(n - 1, self.inverse)])
        return self.up, self.down


_POWERS = [_Powers(b) for b in _BASES]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _rolling(values: np.ndarray, low: np.ndarray, high: np.ndarray, which: int) -> np.ndarray:
    """Hashes of the runs values[low:high]: a polynomial sum, shifted to a common place, mixed."""
    up, down = _POWERS[which].reach(len(values) + 1)
    total = np.zeros(len(values) + 1, _U)
    np.cumsum(values * up[: len(values)], out=total[1:])
    return _mix((total[high] - total[low]) * down[low] + (high - low).astype(_U))


class Words:
    """Word hashes of texts ``low`` to ``high`` of a column, end to end."""

    #: Which bytes belong to words.
    IS_WORD = _IS_WORD

    def __init__(self, data: np.ndarray, at: np.ndarray, low: int, high: int):
        first, last = at[low], at[high]
        raw = data[first:last]
        bounds = at[low : high + 1] - first
        word = self.IS_WORD[raw]
        cut = np.zeros(len(raw) + 1, bool)
        cut[bounds] = True
        before = np.r_[False, word[:-1]] if len(raw) else word
        after = np.r_[word[1:], False] if len(raw) else word
        starts = np.flatnonzero(word & (~before | cut[:-1]))
        ends = np.flatnonzero(word & (~after | cut[1:])) + 1
        self.hash = _rolling(_BYTE[raw], starts, ends, 0)
        #: Place and bytes of each word.
        self.start, self.size = starts, ends - starts
        #: Bounds of each text in ``hash``.
        self.at = np.searchsorted(starts, bounds)
        self.text = np.repeat(np.arange(high - low), np.diff(self.at))

    def grams(self, n: int, which: int) -> np.ndarray:
        """Hashes of the n words from each word on; runs over the end of a text too."""
        low = np.arange(max(0, len(self.hash) - n + 1))
        return _rolling(self.hash, low, low + n, which)

    def windows(self, n: int) -> np.ndarray:
        """Whether the n words from each word on lie in one text."""
        count = max(0, len(self.hash) - n + 1)
        return self.text[:count] == self.text[n - 1 : n - 1 + count]


def shape(length: int) -> tuple[int, int]:
    """k-gram length, and k-grams per window, of windows of ``length`` words."""
    k = (length + 1) // 2
    return k, length - k + 1


def kept(words: Words, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the k-grams kept for windows of ``length`` words."""
    k, w = shape(length)
    grams, inside = words.grams(k, 1), words.windows(length)
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, _U)
    least = grams[: len(inside)].copy()
    for j in range(1, w):
        np.minimum(least, grams[j : j + len(inside)], out=least)
    # A k-gram is kept if it is the smallest of a window that contains it: if the largest
    # of those windows' minima is its own hash.
    least[~inside] = 0
    best = np.zeros(len(grams), _U)
    for j in range(w):
        np.maximum(best[j : j + len(least)], least, out=best[j : j + len(least)])
    place = np.flatnonzero((best == grams) & (best != 0))
    return place, grams[place]


def _spot(h: np.ndarray, length: int) -> np.ndarray:
    return _mix(h ^ _U(length * 0x9E3779B97F4A7C15 & _MASK)) >> _U(64 - TABLE_BITS)


def _holds(table: np.ndarray, spot: np.ndarray) -> np.ndarray:
    return (table[(spot >> _U(3)).astype(np.int64)] >> (spot & _U(7)).astype(np.uint8)) & 1 == 1


def _prints(items: DataFrame, item_id: str, text: str) -> DataFrame:
    """Windows of the benchmark with their hashes, and places of the k-grams kept."""

    def make():
        def work(ids: pa.Array, texts: pa.Array):
            data, at = rows.utf8(texts)
            out = {n: [] for n in ("row", "length", "h1", "h2", "spot")}

            def put(row, length, h1, h2, spot):
                for name, x in zip(out, (row, np.full(len(row), length), h1, h2, spot)):
                    out[name].append(x.astype(np.int64) if name != "h1" and name != "h2" else x.view(np.int64))

            for low, high in rows.chunks(at, rows.SMALL_CHUNK_BYTES):
                words = Words(data, at, low, high)
                count = np.diff(words.at)
                for length in np.unique(np.minimum(count[count > 0], WINDOW)).tolist():
                    start = np.flatnonzero(words.windows(length))
                    short = count[words.text[start]]
                    start = start[(short == length) | (length == WINDOW)]
                    place, grams = kept(words, length)
                    mine = count[words.text[place]]
                    grams = grams[(mine == length) | (length == WINDOW)]
                    h1, h2 = words.grams(length, 1)[start], words.grams(length, 2)[start]
                    put(words.text[start] + low, length, h1, h2, _spot(h1, length))
                    none = np.full(len(grams), -1)
                    put(none, length, grams, grams, _spot(grams, length))
            cols = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in out.values()]
            item = ids.take(pa.array(np.where(cols[0] < 0, 0, cols[0]))) if len(cols[0]) else ids[:0]
            return [item, pa.array(cols[0] >= 0), *map(pa.array, cols[1:])]

        return work

    kind = items.schema[item_id].dataType.simpleString()
    return rows.generate(
        items, [item_id, text], make, f"item {kind}, whole boolean, length int, h1 long, h2 long, spot long"
    )


def _table(prints: DataFrame) -> np.ndarray:
    """The bits at ``spot`` as bytes; at most 2**TABLE_BITS / 64 rows reach the driver."""
    words = (
        prints.groupBy(F.shiftright("spot", 6).alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(spot & 63 as int))")).alias("bits"))
        .toArrow()
    )
    table = np.zeros(1 << (TABLE_BITS - 6), np.int64)
    table[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return table.astype("<i8").view(np.uint8)


def scan(docs: DataFrame, text: str, lengths: list[int], grams, windows) -> DataFrame:
    """``docs`` with ``n_words`` and ``candidates``: windows that may be the benchmark's.

    ``grams`` and ``windows`` are broadcast bit tables.
    """

    def make():
        in_grams, in_windows = grams.value, windows.value

        def work(texts: pa.Array):
            data, at = rows.utf8(texts)
            n_words = np.zeros(len(at) - 1, np.int64)
            per_text = np.zeros(len(at) - 1, np.int64)
            found: list[tuple] = []
            for low, high in rows.chunks(at, rows.SMALL_CHUNK_BYTES):
                words = Words(data, at, low, high)
                n_words[low:high] = np.diff(words.at)
                here = []
                for length in lengths:
                    place, hashes = kept(words, length)
                    place = place[_holds(in_grams, _spot(hashes, length))]
                    if not len(place):
                        continue
                    _, w = shape(length)
                    inside = words.windows(length)
                    start = np.unique(place[:, None] - np.arange(w))
                    start = start[(start >= 0) & (start < len(inside))]
                    start = start[inside[start]]
                    h1 = words.grams(length, 1)[start]
                    hit = _holds(in_windows, _spot(h1, length))
                    start, h1 = start[hit], h1[hit]
                    h2 = words.grams(length, 2)[start]
                    own = words.text[start]
                    here.append((own + low, np.full(len(own), length), start - words.at[own], h1, h2))
                if here:
                    cols = [np.concatenate(x) for x in zip(*here)]
                    order = np.argsort(cols[0], kind="stable")
                    cols = [c[order] for c in cols]
                    per_text += np.bincount(cols[0], minlength=len(per_text))
                    found.append(cols[1:])
            cols = [np.concatenate(x) for x in zip(*found)] if found else [np.zeros(0, np.int64)] * 4
            structs = pa.StructArray.from_arrays(
                [
                    pa.array(cols[0].astype(np.int32)),
                    pa.array(cols[1].astype(np.int64)),
                    pa.array(cols[2].astype(_U).view(np.int64)),
                    pa.array(cols[3].astype(_U).view(np.int64)),
                ],
                names=["length", "start", "h1", "h2"],
            )
            bounds = pa.array(np.r_[0, np.cumsum(per_text)].astype(np.int32))
            return [pa.array(n_words), pa.ListArray.from_arrays(bounds, structs)]

        return work

    fields = "n_words long, candidates array<struct<length int, start long, h1 long, h2 long>>"
    return rows.append(docs, [text], make, fields)


def _judged(docs: DataFrame, text: str, items: DataFrame, item_id: str, item_text: str, drop: tuple = ()):
    """``docs`` with ``n_words`` and ``__row``, stored; and what was found, by ``__row``."""
    spark = docs.sparkSession
    prints = rows.stored(_prints(items.where(F.col(item_id).isNotNull()), item_id, item_text), "prints")
    windows = rows.stored(
        prints.where("whole")
        .groupBy("length", "h1", "h2")
        .agg(F.sort_array(F.collect_set(F.col("item").cast("string"))).alias("items"))
        .withColumn("list", F.xxhash64("items")),
        "windows",
    )
    # Window lengths are 1 to WINDOW, whatever the benchmark.
    lengths = sorted(r.length for r in prints.select("length").distinct().collect())
    tables = [
        spark.sparkContext.broadcast(_table(prints.where("whole" if whole else "NOT whole")))
        for whole in (False, True)
    ]
    scanned = scan(docs, text, lengths, *tables).drop(*drop)
    scanned = rows.stored(scanned.withColumn("__row", F.monotonically_increasing_id()), "scan")
    keys = ["length", "h1", "h2"]
    hits = rows.stored(
        scanned.select("__row", "n_words", F.inline("candidates"))
        .join(windows.select(*keys, "list"), keys)
        .select("__row", "n_words", "start", "length", "list"),
        "hits",
    )
    span = F.struct("start", (F.col("start") + F.col("length")).alias("end"))
    spans = (
        hits.groupBy("__row")
        .agg(F.first("n_words").alias("n"), F.sort_array(F.collect_set(span)).alias("all"))
        .select("__row", "n", _merged("all").alias("spans"))
        .withColumn(
            "n_hit",
            F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"]),
        )
        .withColumn("contaminated", LEAST_SHARE * F.col("n_hit") >= F.col("n"))
        .drop("n")
    )
    owners = (
        hits.select("__row", "list")
        .distinct()
        .join(windows.select("list", "items").dropDuplicates(["list"]), "list")
        .select("__row", F.explode("items").alias("item"))
        .groupBy("__row")
        .agg(F.sort_array(F.collect_set("item")).alias("items"))
    )
    return scanned.drop("candidates"), spans, owners


def contamination(
    docs: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``n_words``, ``n_hit``, ``n_items``, ``items`` (ids as
    text, sorted), ``spans`` (ranges of words hit, joined) and ``contaminated``: words were
    hit, and at least one in ``LEAST_SHARE``."""
    chosen = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    scanned, spans, owners = _judged(chosen, "text", items, item_id, item_text, ("text",))
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    return (
        scanned.join(spans.join(owners, "__row"), "__row", "left")
        .select(
            "doc_id",
            "n_words",
            F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
            F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
            F.coalesce("items", F.array().cast("array<string>")).alias("items"),
            F.coalesce("spans", none).alias("spans"),
            F.coalesce("contaminated", F.lit(False)).alias("contaminated"),
        )
    )


def drop_contaminated(
    docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with its columns, whatever their names."""
    covered = rows.Covered(docs)
    scanned, spans, _ = _judged(covered.inner, covered.at(text), items, item_id, item_text)
    bad = rows.stored(spans.where("contaminated").select("__row"), "contaminated")
    return covered.back(scanned.join(bad, "__row", "left_anti"))


def _merged(column: str):
    """Sorted ranges with overlapping and touching ones joined."""
    empty = F.array().cast("array<struct<start:bigint,end:bigint>>")
    last = lambda done: F.element_at(done, -1)

    def add(done, span):
        joins = (F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["end"] >= span["start"])
        longer = F.struct(
            last(done)["start"].alias("start"), F.greatest(last(done)["end"], span["end"]).alias("end")
        )
        return F.when(
            joins, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(longer))
        ).otherwise(F.concat(done, F.array(span)))

    return F.aggregate(column, empty, add)


def digest(found: DataFrame) -> DataFrame:
    return found.select(
        "doc_id", "n_words", "n_hit", "n_items",
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated",
    )
