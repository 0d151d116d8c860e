"""Language identification by mixtures of languages.

Each language is a distribution over hashed character trigrams, counted over all
training rows. A text is a mixture of languages; expectation-maximisation finds the
proportions, and the set of languages is the one of one to ``MOST`` languages with
the best penalised likelihood (BIC: half the log of the number of trigrams for each
further language).

Trigrams are taken over bytes with A-Z lower-cased and everything below 0x80 that is
no letter turned into a blank; a trigram with a blank in its middle counts only between
two letters. Whole texts are
counted, in slices of about ``rows.CHUNK_BYTES``, a longer text alone.

Null texts and texts without a letter are ``und`` with score 0, and so are all texts
if there is nothing to learn from. Rows are independent: repeated rows and null ids
each give their result. Ties between languages go to the first name.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinkeep.llm import rows

#: log2 of the trigram buckets, rounds, smoothing, least share of a language in a mixture.
BUCKET_BITS, ROUNDS, SMOOTHING, LEAST_SHARE = 15, 8, 0.5, 0.02
UNKNOWN = "und"

_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def _trigrams(data: np.ndarray, at: np.ndarray, low: int, high: int):
    """Buckets of the trigrams of texts low to high, and the text of each (from 0)."""
    first, last = at[low], at[high]
    raw = _FOLD[data[first:last]]
    if len(raw) < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    bounds = at[low : high + 1] - first
    text = np.repeat(np.arange(high - low), np.diff(bounds))
    blank = np.full(1, 32, np.uint8)
    # A blank before and after; where a text begins or ends, its neighbours are blanks.
    before, after = np.r_[blank, raw[:-1]], np.r_[raw[1:], blank]
    begins, ends = bounds[:-1], bounds[1:] - 1
    full = np.diff(bounds) > 0
    before[begins[full]] = 32
    after[ends[full]] = 32
    keep = (raw != 32) | ((before != 32) & (after != 32))
    code = before.astype(np.uint64) << np.uint64(16) | raw.astype(np.uint64) << np.uint64(8) | after
    bucket = (code[keep] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BUCKET_BITS)
    return bucket.astype(np.int64), text[keep]


@dataclass
class Languages:
    """Names, and log-probabilities of trigram buckets by language."""

    names: list[str]
    chances: np.ndarray


def train(labelled: DataFrame, text: str = "text", lang: str = "lang") -> Languages:
    """Learn from the rows of ``labelled`` whose language is known.

    Tasks send one row per language and bucket they met; the driver gets
    2**BUCKET_BITS rows per language.
    """

    def make():
        counts: dict[str, np.ndarray] = {}

        def work(texts: pa.Array, langs: pa.Array):
            data, at = rows.utf8(texts)
            names = langs.dictionary_encode()
            which, values = names.indices.to_numpy(), names.dictionary.to_pylist()
            for low, high in rows.chunks(at):
                bucket, own = _trigrams(data, at, low, high)
                side = which[low:high][own]
                sums = np.bincount((side << BUCKET_BITS) + bucket, minlength=len(values) << BUCKET_BITS)
                for k, name in enumerate(values):
                    part = sums[k << BUCKET_BITS : (k + 1) << BUCKET_BITS]
                    counts[name] = counts.get(name, 0) + part
            return [[], [], []]

        def end():
            out = [[], [], []]
            for name, sums in counts.items():
                met = np.flatnonzero(sums)
                out[0] += [name] * len(met)
                out[1].append(met)
                out[2].append(sums[met])
            return [out[0], *(np.concatenate(x) if x else [] for x in out[1:])]

        work.end = end
        return work

    known = labelled.select(F.col(text).alias("text"), F.col(lang).alias("lang")).where("lang IS NOT NULL")
    totals = (
        rows.generate(known, ["text", "lang"], make, "lang string, bucket int, n long")
        .groupBy("lang", "bucket")
        .agg(F.sum("n").alias("n"))
        .toArrow()
    )
    names = sorted(set(totals.column("lang").to_pylist()))
    place = {name: k for k, name in enumerate(names)}
    counts = np.full((len(names), 1 << BUCKET_BITS), SMOOTHING)
    which = np.array([place[x] for x in totals.column("lang").to_pylist()], np.int64)
    counts[which, totals.column("bucket").to_numpy()] += totals.column("n").to_numpy()
    return Languages(names, (counts / counts.sum(axis=1, keepdims=True)).astype(np.float32))


def _fit(chances, count, text, starts, total, shares, rounds):
    """Rounds of expectation-maximisation; returns shares and log-likelihoods by text."""
    for _ in range(rounds):
        joint = shares[:, text] * chances
        joint *= count / joint.sum(axis=0)
        shares = np.add.reduceat(joint, starts, axis=1) / total
    like = np.log((shares[:, text] * chances).sum(axis=0)) * count
    return shares, np.add.reduceat(like, starts).astype(np.float64)


def mixtures(bucket: np.ndarray, text: np.ndarray, model: Languages, n_texts: int) -> np.ndarray:
    """Shares by language and text; all zero for texts without trigrams."""
    out = np.zeros((len(model.names), n_texts), np.float32)
    if not len(bucket) or not model.names:
        return out
    key, count = np.unique((text << BUCKET_BITS) | bucket, return_counts=True)
    text, bucket, count = key >> BUCKET_BITS, key & ((1 << BUCKET_BITS) - 1), count.astype(np.float32)
    owners, starts = np.unique(text, return_index=True)
    text = np.searchsorted(owners, text)
    chances = model.chances[:, bucket]
    total = np.add.reduceat(count, starts)
    some = np.full((len(model.names), len(owners)), 1 / len(model.names), np.float32)
    some, _ = _fit(chances, count, text, starts, total, some, ROUNDS)
    # One language: its likelihood is a plain sum. Ties: the first name.
    single = np.stack([np.add.reduceat(np.log(c) * count, starts) for c in chances])
    best_set = np.zeros_like(some)
    best_set[single.argmax(axis=0), np.arange(len(owners))] = 1
    best = single.max(axis=0).astype(np.float64)
    rank = np.argsort(-some, axis=0, kind="stable")
    for size in range(2, len(model.names) + 1):
        # Only texts with a share for a language beyond those that stand are fitted again.
        more = np.flatnonzero(some[rank[size - 1], np.arange(len(owners))] >= LEAST_SHARE)
        if not len(more):
            break
        mine = np.isin(text, more)
        own = np.searchsorted(more, text[mine])
        first = np.searchsorted(own, np.arange(len(more)))
        shares = np.zeros((len(model.names), len(more)), np.float32)
        top = rank[:size, more]
        shares[top, np.arange(len(more))] = some[top, more]
        shares /= shares.sum(axis=0)
        shares, like = _fit(chances[:, mine], count[mine], own, first, total[more], shares, ROUNDS)
        like -= (size - 1) / 2 * np.log(total[more])
        better = like > best[more]
        best[more[better]] = like[better]
        best_set[:, more[better]] = shares[:, better]
    out[:, owners] = best_set
    return out


def identify(docs: DataFrame, model: Languages, text: str = "text") -> DataFrame:
    """``docs`` with ``languages`` (name and share, largest first), ``lang_pred``, ``score``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = rows._arrow(rows.T._parse_datatype_string("a array<struct<lang string, share double>>")[0].dataType)

    def make():
        model = shared.value

        def work(texts: pa.Array):
            data, at = rows.utf8(texts)
            found: list[list] = []
            for low, high in rows.chunks(at):
                bucket, own = _trigrams(data, at, low, high)
                shares = mixtures(bucket, own, model, high - low)
                for k in range(high - low):
                    mine = shares[:, k]
                    some = np.flatnonzero(mine >= LEAST_SHARE)
                    raw = data[at[low + k] : at[low + k + 1]]
                    if not len(some) or not has_letter(raw):
                        found.append([])
                        continue
                    some = some[np.argsort(-mine[some], kind="stable")]
                    found.append([{"lang": model.names[j], "share": min(1.0, float(mine[j]))} for j in some])
            top = [f[0] if f else {"lang": UNKNOWN, "share": 0.0} for f in found]
            return [pa.array(found, kind), [t["lang"] for t in top], [t["share"] for t in top]]

        return work

    fields = "languages array<struct<lang string, share double>>, lang_pred string, score double"
    return rows.append(docs, [text], make, fields)


def has_letter(raw: np.ndarray) -> bool:
    folded = _FOLD[raw]
    if ((folded >= 97) & (folded < 123)).any():
        return True
    return bool((raw >= 128).any()) and any(map(str.isalpha, raw.tobytes().decode()))
