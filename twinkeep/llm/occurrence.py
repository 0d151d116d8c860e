"""Similarity join of shingle sets by T-occurrence search with DivideSkip.

A text is the set of its ``SHINGLE``-word shingles (64-bit hashes; fewer words: one shingle). Two
texts link when their Jaccard similarity is at least ``LEAST``. A set of n then shares at least
T = ceil(LEAST * n) shingles with its partners, so of any n - T + 1 of its shingles one is shared.

1. ``marks``: one narrow row per text (id, 128-bit digest of its set, size). Equal sets fold into one.
2. ``possible``: take each set's first 2p - 1 shingles in hash order, p = n - T + 1. The first k
   that two partners share are among those of both, k being the p of the smaller set; so at least the p
   of a set of size T must occur among those of another set. They are counted by value (packed, one shuffle of 40 % of all shingles);
   most texts share too few and are out. Shingles found in many texts of a batch count as
   shared without a shuffle, so a line that is in a third of the texts makes no hot group.
   The others are told to the tasks by a Bloom filter of bounded size and an exact join.
3. ``candidates``: the remaining sets' shared shingles in one order, the rarest first; a set needs a shared one
   among its first p. Sets are dealt to shards by their smallest shingle hash, which puts copies
   together; a shard that would be too large is split. A set is sent, as a query, to every
   later shard that holds one of its first p shingles in such a place (prefix filter), so each pair
   meets once.
4. ``_search``, in a shard: inverted lists over the shard's sets. For a query, DivideSkip (Li, Lu
   and Lu, 2008) merges the short lists, counting how often each set occurs, and keeps those that
   reach T minus the number of long lists; each of them is looked up by binary search in the
   long lists. What reaches the overlap that its size requires is linked. Lists come sorted, and merging
   them is one counting pass instead of a heap of cursors; the result is the same.

A task returns one row per linked set: its class in the task and how many texts it links with. Pairs are
never returned. Classes are the connected components over all tasks. The work of a crowd of k
similar but different texts grows with its k * k / 2 links, which are all counted.

Null, empty and blank texts have the empty set, which links with nothing, not even its like. Null ids
are ignored when the smallest id is taken. Repeated rows are texts of their own. Very long texts are
hashed in whole, a megabyte of other texts at a time. Ties don't arise: every link counts. An empty
table gives no rows. Only named columns are read, so others may have any name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinkeep.llm import graph, rows, simhash, winnowing

SHINGLE = 5
#: The least similarity as a fraction.
LEAST = (4, 5)
#: A shingle in this share of a batch's texts (and in ``COMMON_LEAST`` of them) is common.
COMMON_SHARE, COMMON_LEAST = 32, 16
#: Common shingles that are broadcast (16 MB); rarer ones are shuffled like all others.
COMMON_MOST = 1 << 20
#: Shingles per group of the counting step, and per shard: they bound the memory of a task. A group is whole in the
#: JVM's sort, its Arrow batch and a Python worker at once, some 28 bytes a shingle each.
COUNTED, GROUP = 1 << 18, 1 << 20
#: Texts whose counts one task adds up.
PART_TEXTS = 100_000
#: Texts per Arrow batch.
BATCH_ROWS = 1000
#: log2 of the most bits of the filter of sets that may have partners: 16 MB. Beyond some 8 million
#: such sets it lets more and more others pass, which a join drops.
FILTER_BITS = 27
#: Cost of a binary probe, per halving, in units of a merged entry.
PROBE_COST = 1.0
#: Probes looked at together.
PROBES = 1 << 20

_U = np.uint64
_NOT_BLANK = np.ones(256, bool)
_NOT_BLANK[[9, 10, 11, 12, 13, 32]] = False


class Words(winnowing.Words):
    """Words cut at ASCII blanks alone."""

    IS_WORD = _NOT_BLANK


def sets(data: np.ndarray, at: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Text and hash of the different shingles of texts ``low`` to ``high``, in that order."""
    words = Words(data, at, low, high)
    size = np.diff(words.at)
    inside = np.flatnonzero(words.windows(SHINGLE))
    short = np.flatnonzero((size > 0) & (size < SHINGLE))
    first = np.concatenate([inside, words.at[short]])
    last = np.concatenate([inside + SHINGLE, words.at[short + 1]])
    text = np.concatenate([words.text[inside], short])
    shingle = winnowing._rolling(words.hash, first, last, 1)
    order = np.lexsort((shingle, text))
    text, shingle = text[order], shingle[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (shingle[1:] != shingle[:-1])
    return text[new], shingle[new]


def _texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owner, shingle and set size of a whole batch."""
    data, at = rows.utf8(column)
    owner, shingle, size = [np.zeros(0, np.int64)], [np.zeros(0, _U)], [np.zeros(0, np.int64)]
    for low, high in rows.chunks(at):
        o, s = sets(data, at, low, high)
        owner.append(o + low)
        shingle.append(s)
        size.append(np.bincount(o, minlength=high - low))
    return np.concatenate(owner), np.concatenate(shingle), np.concatenate(size)


def _keys(shingle: np.ndarray, size: np.ndarray) -> list[bytes]:
    ends = np.cumsum(size)
    return [xxhash.xxh3_128_digest(shingle[a:b].tobytes()) for a, b in zip((ends - size).tolist(), ends.tolist())]


def _required(n):
    """The least overlap of a set of n with any set similar to it."""
    return -(-LEAST[0] * n // LEAST[1])


def marks(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``doc_id``, ``key`` (equal for equal sets), ``n``; and ``common``, what a batch found in many of
    its texts, on its first row."""
    pair = pa.struct([("token", pa.int64()), ("n", pa.int64())])

    def make():
        def work(ids: pa.Array, texts: pa.Array):
            owner, shingle, size = _texts(texts)
            token, count = np.unique(shingle, return_counts=True)
            many = count >= max(COMMON_LEAST, len(size) // COMMON_SHARE)
            found = [{"token": t, "n": c} for t, c in zip(token[many].view(np.int64).tolist(), count[many].tolist())]
            common = pa.array([found, *[[]] * (len(size) - 1)][: len(size)], pa.list_(pair))
            return [ids, pa.array(_keys(shingle, size), pa.binary()), pa.array(size), common]

        return work

    kind = docs.schema[doc_id].dataType.simpleString()
    fields = f"doc_id {kind}, key binary, n long, common array<struct<token long, n long>>"
    return rows.stored(rows.generate(docs, [doc_id, text], make, fields), "marks", BATCH_ROWS)


def _common(marked: DataFrame) -> np.ndarray:
    """Common shingles over all batches, sorted; at most ``COMMON_MOST``, the most frequent first kept."""
    found = (
        marked.select(F.inline("common"))
        .groupBy("token")
        .agg(F.sum("n").alias("n"))
        .orderBy(F.desc("n"), "token")
        .limit(COMMON_MOST)
        .select("token")
        .toArrow()
    )
    return np.sort(found.column("token").to_numpy().view(_U))


_PACK = "g int, keys binary, owner binary, tokens binary, counts binary"


def _probes(docs: DataFrame, text: str, common: np.ndarray, groups: int) -> DataFrame:
    """The first 2p - 1 shingles of every set by ranges of their value; common ones as counts."""
    shared = docs.sparkSession.sparkContext.broadcast(common)
    edges = [(k << 64) // groups for k in range(1, groups)]

    def make():
        known, seen = shared.value, set()
        cuts = np.array(edges, _U)

        def work(texts: pa.Array):
            owner, shingle, size = _texts(texts)
            keys = _keys(shingle, size)
            fresh = np.zeros(len(keys), bool)
            if len(seen) > 1 << 17:
                seen.clear()
            for k, key in enumerate(keys):  # a text's copies in the same task are sent once
                if size[k] and key not in seen:
                    seen.add(key)
                    fresh[k] = True
            place = np.arange(len(owner)) - (np.cumsum(size) - size)[owner]
            probe = 2 * (size - _required(size) + 1) - 1
            use = fresh[owner] & (place < probe[owner])
            owner, shingle = owner[use], shingle[use]
            is_common = np.zeros(len(shingle), bool)
            if len(known):
                spot = np.minimum(np.searchsorted(known, shingle), len(known) - 1)
                is_common = known[spot] == shingle
            counts = np.bincount(owner[is_common], minlength=len(keys))
            out = []

            def put(g, own, tokens, count):
                mine, local = np.unique(own, return_inverse=True)
                joined = b"".join(keys[k] for k in mine.tolist())
                out.append((g, joined, local.astype(np.uint32).tobytes(), tokens.tobytes(), count.tobytes()))

            some = np.flatnonzero(counts)
            if len(some):
                put(int(some[0]) % groups, some, np.zeros(0, _U), counts[some].astype(np.int32))
            owner, shingle = owner[~is_common], shingle[~is_common]
            order = np.argsort(shingle)
            owner, shingle = owner[order], shingle[order]
            bounds = [0, *np.searchsorted(shingle, cuts).tolist(), len(shingle)]
            for g, (low, high) in enumerate(zip(bounds, bounds[1:])):
                if low < high:
                    put(g, owner[low:high], shingle[low:high], np.zeros(0, np.int32))
            return [list(x) for x in zip(*out)] if out else [[]] * 5

        return work

    return rows.generate(docs, [text], make, _PACK)


_COUNT = pa.schema([("h", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])
_SUM = pa.schema([("key", pa.binary()), ("c", pa.int64())])


def _counted(table: pa.Table, parts: int) -> pa.Table:
    """Per set of a group, how many of its shingles there another set has; packed by part of the keys."""
    keys, owner, tokens, counts = [], [], [], []
    base = 0
    for k in range(table.num_rows):
        joined, own, token, count = (table.column(c)[k].as_buffer() for c in ("keys", "owner", "tokens", "counts"))
        mine = np.frombuffer(joined, _U).reshape(-1, 2)
        own = np.frombuffer(own, np.uint32).astype(np.int64) + base
        keys.append(mine)
        if count.size:  # sets with so many common shingles
            counts.append(np.stack([own, np.frombuffer(count, np.int32).astype(np.int64)]))
        else:
            owner.append(own)
            tokens.append(np.frombuffer(token, _U))
        base += len(mine)
    # The same set may come from several tasks: one number per set.
    all_keys = np.concatenate([np.zeros((0, 2), _U), *keys])
    order = np.lexsort((all_keys[:, 1], all_keys[:, 0]))
    new = np.ones(len(order), bool)
    new[1:] = (all_keys[order[1:]] != all_keys[order[:-1]]).any(axis=1)
    number = np.zeros(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    unique = all_keys[order[new]]
    shared = np.zeros(len(unique), np.int64)
    if counts:
        own, count = np.concatenate(counts, axis=1)
        np.add.at(shared, number[own], count)
    if tokens:
        token, own = np.concatenate(tokens), number[np.concatenate(owner)]
        order = np.lexsort((own, token))
        token, own = token[order], own[order]
        new = np.ones(len(token), bool)
        new[1:] = (token[1:] != token[:-1]) | (own[1:] != own[:-1])
        token, own = token[new], own[new]
        same = token[1:] == token[:-1]
        in_two = np.zeros(len(token), bool)
        in_two[1:] |= same
        in_two[:-1] |= same
        shared += np.bincount(own[in_two], minlength=len(unique))
    some = np.flatnonzero(shared)
    unique, shared = unique[some], shared[some]
    part = (unique[:, 0] % _U(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    unique, shared, part = unique[order], shared[order].astype(np.int32), part[order]
    edges = [*np.flatnonzero(np.r_[True, part[1:] != part[:-1]]).tolist(), len(part)] if len(part) else []
    out = [(int(part[a]), unique[a:b].tobytes(), shared[a:b].tobytes()) for a, b in zip(edges, edges[1:])]
    columns = zip(*out) if out else [()] * 3
    return pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(columns, _COUNT)], schema=_COUNT)


def _summed(table: pa.Table) -> pa.Table:
    """Counts per set over all groups."""
    keys = np.concatenate([np.frombuffer(k.as_py(), _U).reshape(-1, 2) for k in table.column("keys")])
    counts = np.concatenate([np.frombuffer(c.as_py(), np.int32) for c in table.column("counts")])
    order = np.lexsort((keys[:, 1], keys[:, 0]))
    keys, counts = keys[order], counts[order].astype(np.int64)
    first = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1)])
    data = pa.py_buffer(np.ascontiguousarray(keys[first]).tobytes())
    fixed = pa.Array.from_buffers(pa.binary(16), len(first), [None, data])
    return pa.Table.from_arrays([fixed.cast(pa.binary()), pa.array(np.add.reduceat(counts, first))], schema=_SUM)


def _least_overlap(n: Column) -> Column:
    return F.floor((n * LEAST[0] + LEAST[1] - 1) / LEAST[1]).cast("long")


def _groups(total: int, cores: int) -> int:
    """Groups of the counting step for sets with ``total`` shingles, of which it takes up to 40 %."""
    return max(cores, -(-2 * total // (5 * COUNTED)))


def possible(docs: DataFrame, marked: DataFrame, folded: DataFrame, text: str) -> DataFrame:
    """Rows of ``folded`` whose set shares enough of its first shingles to have a partner."""
    total, texts = (x or 0 for x in folded.agg(F.sum("n"), F.count("*")).first())
    parts = max(256, -(-texts // PART_TEXTS))
    groups = _groups(total, docs.sparkSession.sparkContext.defaultParallelism)
    packed = _probes(docs, text, _common(marked), groups)
    counted = packed.groupBy("g").applyInArrow(
        lambda table: _counted(table, parts), "h int, keys binary, counts binary"
    )
    counts = counted.groupBy("h").applyInArrow(_summed, "key binary, c long")
    smallest = _least_overlap(F.col("n"))  # the size of the smallest partner
    enough = smallest - _least_overlap(smallest) + 1
    return folded.join(counts, "key").where(F.col("c") >= enough).select(folded.columns)


def _places(keys: list[bytes], bits: int) -> np.ndarray:
    """Two places per key in a table of 2 ** bits bits."""
    return np.frombuffer(b"".join(keys), "<u8").reshape(-1, 2) >> _U(64 - bits)


def _filter(wanted: DataFrame) -> tuple[int, np.ndarray]:
    """A Bloom filter of the keys ``wanted``: 16 bits for each, 2 ** ``FILTER_BITS`` at most."""
    bits = min(FILTER_BITS, max(10, (16 * wanted.count()).bit_length()))

    def make():
        def work(keys: pa.Array):
            place = _places(keys.to_pylist(), bits).ravel()
            return [(place >> _U(6)).view(np.int64), (_U(1) << (place & _U(63))).view(np.int64)]

        return work

    words = (
        rows.generate(wanted, ["key"], make, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits"))
    ).toArrow()
    table = np.zeros(1 << (bits - 6), np.int64)
    table[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return bits, table.view(_U)


def shingled(docs: DataFrame, text: str, wanted: DataFrame) -> DataFrame:
    """``key`` and ``tokens`` of the sets ``wanted`` (by ``key``), one row per set.

    Tasks send on only what the filter lets pass; the join drops what it lets pass by mistake.
    """
    shared = docs.sparkSession.sparkContext.broadcast(_filter(wanted))

    def make():
        bits, table = shared.value

        def work(texts: pa.Array):
            owner, shingle, size = _texts(texts)
            keys = _keys(shingle, size)
            place = _places(keys, bits)
            held = (table[(place >> _U(6)).astype(np.int64)] >> (place & _U(63))) & _U(1) == 1
            use = held.all(axis=1)
            ends = pa.array(np.r_[0, np.cumsum(size[use])].astype(np.int32))
            tokens = pa.ListArray.from_arrays(ends, pa.array(shingle[use[owner]].view(np.int64)))
            return [pa.array([k for k, u in zip(keys, use.tolist()) if u], pa.binary()), tokens]

        return work

    made = rows.generate(docs, [text], make, "key binary, tokens array<long>")
    return made.join(wanted.select("key"), "key", "left_semi").dropDuplicates(["key"])


def candidates(docs: DataFrame, text: str, wanted: DataFrame) -> DataFrame:
    """Sets with a shared shingle among their first p: ``id``, ``key``, ``n``, ``copies``, ``tokens`` (the shared
    ones, the rarest first), ``pre`` (how many of them are among the first p), ``home``."""
    found = rows.stored(shingled(docs, text, wanted), "shingles", BATCH_ROWS)
    posted = found.select("key", F.explode("tokens").alias("token"))
    often = rows.stored(posted.groupBy("token").agg(F.count("*").alias("df")).where("df > 1"), "often")
    ranked = (
        posted.join(often, "token")
        .groupBy("key")
        .agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("all"))
        .select("key", F.col("all")["token"].alias("tokens"))
    )
    known = wanted.join(ranked, "key").withColumn(
        "pre", F.col("n") - _least_overlap(F.col("n")) + 1 - (F.col("n") - F.size("tokens"))
    )
    kept = known.where((F.col("pre") > 0) & (F.size("tokens") >= _least_overlap(F.col("n"))))
    return rows.stored(
        kept.withColumn("home", F.array_min("tokens")).withColumn("id", F.monotonically_increasing_id()), "candidates", 500
    )


def _dealt(able: DataFrame) -> DataFrame:
    """Tiles: the sets of a shard (``own``) and those that ask it, with slices of a crowded one."""
    cores = able.sparkSession.sparkContext.defaultParallelism
    total = able.agg(F.sum(F.size("tokens"))).first()[0] or 0
    shards = max(cores, -(-total // GROUP))
    # At most total / GROUP homes are split.
    crowded = able.groupBy("home").agg(F.sum(F.size("tokens")).alias("w")).where(F.col("w") > GROUP)
    split = crowded.select("home", F.ceil(F.col("w") / GROUP).alias("parts"))
    part = F.pmod(F.xxhash64("id"), F.coalesce("parts", F.lit(1)))
    placed = rows.stored(
        able.join(split, "home", "left")
        .withColumn("shard", F.pmod(F.xxhash64("home", part), F.lit(shards)).cast("int"))
        .drop("parts", "home"),
        "placed",
        500,
    )
    prefix = placed.select("id", "shard", F.size("tokens").alias("w"), F.explode(F.slice("tokens", 1, F.col("pre").cast("int"))).alias("token"))
    holds = prefix.select("token", F.col("shard").alias("to")).distinct()
    routes = rows.stored(
        prefix.join(holds, "token").where(F.col("to") >= F.col("shard")).select("id", "to", "w").distinct(), "routes"
    )
    load = routes.groupBy("to").agg(F.ceil(F.sum("w") / (4 * GROUP)).cast("int").alias("slices"))
    sent = routes.join(load, "to").join(placed, "id")
    every = F.sequence(F.lit(0), F.col("slices") - 1)
    own = F.col("to") == F.col("shard")
    mine = F.pmod(F.col("id"), F.col("slices")).cast("int")
    return sent.withColumn(
        "slice", F.explode(F.when(own, every).otherwise(F.array(mine)))
    ).select(
        "to", "slice", "id", "n", "copies", "tokens", own.alias("own"), (F.col("slice") == mine).alias("asks")
    )


class Lists:
    """Inverted lists over some sets, as one sorted array of (list, set)."""

    def __init__(self, tokens: np.ndarray, owner: np.ndarray, count: int):
        order = np.lexsort((owner, tokens))
        self.token, first = np.unique(tokens[order], return_index=True)
        self.first = np.r_[first, len(tokens)]
        self.sets, self.count = owner[order], count
        place = np.repeat(np.arange(len(self.token)), np.diff(self.first))
        self.joint = place * count + self.sets

    def search(self, tokens: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Sets that occur in at least ``least`` of the lists of ``tokens``, and how often."""
        none = np.zeros(0, np.int64)
        if not len(self.token):
            return none, none
        spot = np.minimum(np.searchsorted(self.token, tokens), len(self.token) - 1)
        spot = spot[self.token[spot] == tokens]
        if len(spot) < least:
            return none, none
        size = self.first[spot + 1] - self.first[spot]
        order = np.argsort(size, kind="stable")
        spot, size = spot[order], size[order]
        long = min(least - 1, int(least / (PROBE_COST * np.log2(max(2, int(size[-1]))) + 1)))
        short = len(spot) - long
        # Merge the short lists: all their entries, counted by set.
        low, n = self.first[spot[:short]], size[:short]
        entries = np.arange(int(n.sum())) + np.repeat(low - (np.cumsum(n) - n), n)
        count = np.bincount(self.sets[entries], minlength=self.count)
        found = np.flatnonzero(count >= max(1, least - long))
        count = count[found]
        # Probe the long lists for what is left, the shorter ones first.
        step = max(1, PROBES // max(1, len(found)))
        for at in range(short, len(spot), step):
            some = spot[at : at + step]
            asked = (some[:, None] * self.count + found[None, :]).ravel()
            hit = self.joint[np.minimum(np.searchsorted(self.joint, asked), len(self.joint) - 1)] == asked
            count = count + hit.reshape(len(some), -1).sum(axis=0)
            able = count + (len(spot) - at - len(some)) >= least
            found, count = found[able], count[able]
        return found, count


_LINKS = pa.schema([("id", pa.int64()), ("root", pa.int64()), ("links", pa.int64())])


def _search(table: pa.Table) -> pa.Table:
    """Links of the sets that ask with the sets of the shard: one row per linked set."""
    own = table.column("own").to_numpy(zero_copy_only=False)
    asks = table.column("asks").to_numpy(zero_copy_only=False)
    ids, n, copies = (table.column(c).to_numpy() for c in ("id", "n", "copies"))
    lists = table.column("tokens").combine_chunks()
    bounds = lists.offsets.to_numpy()
    tokens = lists.values.to_numpy()
    size = np.diff(bounds)
    mine = np.flatnonzero(own)
    number = np.full(len(ids), -1)
    number[mine] = np.arange(len(mine))
    owner = np.repeat(np.arange(len(ids)), size)
    inside = own[owner]
    flat = tokens[bounds[0] : bounds[-1]]
    index = Lists(flat[inside], number[owner[inside]], max(1, len(mine)))
    held, forest, links = n[mine], np.arange(len(ids)), np.zeros(len(ids), np.int64)
    for q in np.flatnonzero(asks).tolist():
        least = int(_required(n[q]))
        found, both = index.search(tokens[bounds[q] : bounds[q + 1]], least)
        near = LEAST[1] * both >= LEAST[0] * (n[q] + held[found] - both)
        if own[q]:  # two sets of the shard meet once
            near &= ids[mine[found]] > ids[q]
        partner = mine[found[near]]
        if len(partner):
            links[q] += copies[partner].sum()
            links[partner] += copies[q]
            simhash._unite(forest, np.full(len(partner), q), partner)
    linked = np.flatnonzero(links)
    root = simhash._roots(forest)[linked]
    return pa.Table.from_arrays([pa.array(ids[linked]), pa.array(ids[root]), pa.array(links[linked])], schema=_LINKS)


def join(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``n_shingles``, ``component_id`` (the smallest id of its class, its own
    included) and ``n_links``, the number of other rows it links with."""
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    rows.ship(docs.sparkSession)
    marked = marks(docs, "doc_id", "text")
    folded = rows.stored(
        marked.where("n > 0").groupBy("key").agg(
            F.first("n").alias("n"), F.count("*").alias("copies"), F.min("doc_id").alias("least_id")
        ),
        "folded",
    )
    wanted = rows.stored(possible(docs, marked, folded, "text"), "possible", BATCH_ROWS)
    able = candidates(docs, "text", wanted)
    found = rows.stored(
        _dealt(able).groupBy("to", "slice").applyInArrow(_search, "id long, root long, links long"), "links"
    )
    roots = graph.components(found.select("id", "root"))
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    classed = rows.stored(
        links.join(roots, F.col("id") == F.col("node"), "left")
        .join(able.select("id", "key", "least_id"), "id")
        .select("key", "links", F.coalesce("root", "id").alias("root"), "least_id"),
        "classes",
    )
    least = classed.groupBy("root").agg(F.min("least_id").alias("component_id"))
    by_key = classed.join(least, "root").select("key", "links", "component_id")
    sets_ = folded.select("key", "copies", "least_id").join(by_key, "key", "left")
    linked = F.col("copies") - 1 + F.coalesce("links", F.lit(0).cast("long"))
    return (
        marked.drop("common")
        .join(rows.stored(sets_, "sets"), "key", "left")
        .select(
            "doc_id",
            F.col("n").alias("n_shingles"),
            F.when(F.col("n") > 0, F.coalesce("component_id", "least_id")).otherwise(F.col("doc_id")).alias("component_id"),
            F.coalesce(linked, F.lit(0).cast("long")).alias("n_links"),
        )
    )
