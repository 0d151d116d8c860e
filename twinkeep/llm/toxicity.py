"""Toxicity by a weighted lexicon, matched with an Aho-Corasick automaton.

Texts are folded first: compatibility forms and accents are taken apart (NFKD), marks and
characters without shape (zero-width blanks, soft hyphens) go; lower case; look-alike letters of
other scripts and digits or signs that stand for letters become those letters, where ``i``, ``l``
and ``1`` are one letter; numbers alone and everything else that is no letter become one blank.
Lexicon entries are whole words (`` word ``) and word beginnings
(`` begin``), each with its log-odds of toxic against clean texts. Per word the
heaviest entry counts, unless an exception phrase covers it. The sum and the sum per
word (normalised by length) go through a logistic curve.

Entries and exception phrases are learned from labelled rows, at most about
``SAMPLE`` of them taken by the hash of the text: entries whose share of toxic texts
would be reached by chance less than once in the whole candidate list, exceptions
from matched words and the two-word phrases around them that clean texts hold more
often than toxic ones. Copies are no evidence of their own: of equal and nearly equal folded
texts, told by the least hashes of their word shingles, one counts in the lexicon. Significance alone decides
what is an entry, so the sample's vocabulary bounds what is broadcast.

Null and empty texts score like a text without any match. A text of any length is read whole.
Rows are independent: repeated rows and null ids each give their result; equal texts tie. An empty
table gives no rows, and an input column named ``score`` or ``hits`` is replaced. Without labels of
both kinds every score is the share of toxic rows (0 without any). Scores do not depend on ids.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from dataclasses import dataclass, field
from math import exp, lgamma, log, log1p

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from twinkeep.llm import rows

#: Labelled rows learned from at most; texts an entry or a phrase must be in.
SAMPLE, LEAST_TEXTS = 20_000, 3
#: Words of a shingle, and least hashes of which one in common makes two texts count once.
SHINGLE, NEAR = 5, ("near0", "near1", "near2")
#: Lengths of word beginnings that may become entries.
BEGINNINGS = range(4, 8)
LEAST_WEIGHT = 1.5

#: Characters that stand for Latin letters.
LOOK_ALIKES = {
    "0": "o", "1": "i", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "|": "i", "l": "i",
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c",
    "т": "t", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ԛ": "q", "ԝ": "w",
    "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t",
    "υ": "u", "χ": "x", "ı": "i", "ß": "ss", "æ": "ae", "ø": "o", "đ": "d", "ł": "i",
}
#: Signs that stand for letters only between letters, digits and each other.
INSIDE = {"!": "i", "+": "t", "€": "e"}

_SIGNS = re.compile(r"(?<=[^\W_])[!+€]++(?=[^\W_])")
_NUMBER = re.compile(r"(?<![^\W_])(?<![$@|!+€])[\d$@|!+€]++(?![^\W_])")
_INSIDE = str.maketrans(INSIDE)


class _Fold(dict):
    def __missing__(self, code: int) -> str:
        char = chr(code)
        self[code] = char if char.isalpha() else " "
        return self[code]


class _Shapeless(dict):
    """Drops marks and characters without shape, keeps all others."""

    def __missing__(self, code: int) -> int | None:
        self[code] = None if unicodedata.category(chr(code)) in ("Mn", "Me", "Cf") else code
        return self[code]


_FOLD = _Fold({ord(k): v for k, v in LOOK_ALIKES.items()})
_SHAPED = _Shapeless()


def folded(text: str | None) -> str:
    """Folded words with one blank before, between and after; a blank for no words."""
    text = text or ""
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text).translate(_SHAPED)
    text = _SIGNS.sub(lambda m: m[0].translate(_INSIDE), _NUMBER.sub(" ", text.lower()))
    words = text.translate(_FOLD).split()
    return f" {' '.join(words)} " if words else " "


@dataclass
class Lexicon:
    entries: dict[str, float] = field(default_factory=dict)
    exceptions: list[str] = field(default_factory=list)
    curve: tuple[float, ...] = (0.0, 0.0, 0.0)
    base: float = 0.0
    trained: bool = False

    def automaton(self) -> ahocorasick.Automaton:
        found = ahocorasick.Automaton()
        for phrase in self.exceptions:
            found.add_word(phrase, (len(phrase), None))
        for entry, weight in self.entries.items():
            found.add_word(entry, (len(entry), weight))
        found.make_automaton()
        return found


def matches(automaton: ahocorasick.Automaton, text: str) -> dict[int, float]:
    """Weights of the words that match an entry, by where the blank before them is."""
    best: dict[int, float] = {}
    safe: list[tuple[int, int]] = []
    if len(automaton):
        for end, (length, weight) in automaton.iter(text):
            start = end - length + 1
            if weight is None:
                safe.append((start, end))
            elif weight > best.get(start, 0.0):
                best[start] = weight
    for low, high in safe:
        for start in [s for s in best if low <= s < high]:
            del best[start]
    return best


def _features(automaton: ahocorasick.Automaton, text: str) -> tuple[float, float]:
    total = sum(matches(automaton, text).values())
    words = max(1, text.count(" ") - 1)
    return log1p(total), log1p(100 * total / words)


def _sample(labelled: DataFrame, bound: int) -> DataFrame:
    total = labelled.count()
    share = min(1.0, bound / max(1, total))
    part = F.pmod(F.xxhash64("text"), F.lit(1_000_000))
    return labelled.where(part < int(share * 1_000_000))


def least_hashes(text: str) -> list[int]:
    """Per seed the least hash of the shingles of a folded text."""
    words = text.split()
    shingles = {" ".join(words[k : k + SHINGLE]) for k in range(max(1, len(words) - SHINGLE + 1))}
    return [min(xxh64_intdigest(s, seed) for s in shingles) >> 1 for seed in range(len(NEAR))]


def _candidates(text: str) -> set[str]:
    out = set()
    for word in text.split():
        out.add(f" {word} ")
        for n in BEGINNINGS:
            if len(word) > n:
                out.add(f" {word[:n]}")
    return out


def _counted(sample: DataFrame, make_keys, least: int) -> DataFrame:
    """Keys of ``make_keys(folded text)`` with the toxic and clean texts that have them."""

    def make():
        toxic, clean = Counter(), Counter()
        keys_of = make_keys()

        def work(texts: pa.Array, labels: pa.Array):
            for text, label in zip(texts.to_pylist(), labels.to_pylist()):
                (toxic if label else clean).update(keys_of(text))
            return [[], [], []]

        def end():
            keys = list(toxic.keys() | clean.keys())
            return [keys, [toxic[k] for k in keys], [clean[k] for k in keys]]

        work.end = end
        return work

    return (
        rows.generate(sample, ["folded", "toxic"], make, "key string, toxic long, clean long")
        .groupBy("key")
        .agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
        .where(F.col("toxic") + F.col("clean") >= least)
    )


def _tail(hits: int, n: int, p: float) -> float:
    """log P(Binomial(n, p) >= hits); 0 where that is no rare event."""
    if hits <= n * p:
        return 0.0
    # Above the mean the terms fall faster and faster: what follows a negligible one is negligible.
    total, first = 0.0, None
    for k in range(hits, n + 1):
        term = lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * log(p) + (n - k) * log(1 - p)
        first = term if first is None else first
        total += exp(term - first)
        if term < first - 40:
            break
    return min(0.0, first + log(total))


def train(
    labelled: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    toxic: str = "toxic",
    sample: int = SAMPLE,
    exceptions: tuple[str, ...] = (),
) -> Lexicon:
    """Learn from rows with a label (other labels than 0 and 1 are left out).

    ``exceptions`` are phrases that never count, beside those that are learned.
    """
    chosen = labelled.select(
        F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(toxic).cast("int").alias("toxic")
    ).where("toxic IN (0, 1)")

    def fold():
        def work(texts: pa.Array):
            plain = [folded(t) for t in texts.to_pylist()]
            return [plain, *zip(*map(least_hashes, plain))] if plain else [[]] * (1 + len(NEAR))

        return work

    fields = ", ".join(["folded string", *[f"{n} long" for n in NEAR]])
    taken = rows.append(_sample(chosen, sample), ["text"], fold, fields)
    taken = rows.stored(taken.select("folded", "toxic", *NEAR), "labelled")
    unique = taken
    for near in NEAR:
        first = F.max(F.struct("toxic", "folded", *NEAR)).alias("first")
        unique = unique.groupBy(F.col(near).alias("near")).agg(first).select("first.*")
    unique = rows.stored(unique.select("folded", "toxic"), "labelled")
    sizes = {r.toxic: r["count"] for r in unique.groupBy("toxic").count().collect()}
    hot, cold = sizes.get(1, 0), sizes.get(0, 0)
    rate = taken.agg(F.avg("toxic")).first()[0] or 0.0
    if not hot or not cold:
        return Lexicon(base=float(rate))
    counted = rows.stored(_counted(unique, lambda: _candidates, LEAST_TEXTS), "candidates")
    total = max(1, counted.count())
    weight = F.log((F.col("toxic") + 1) / (hot + 2)) - F.log((F.col("clean") + 1) / (cold + 2))
    heavy = (F.col("weight") >= LEAST_WEIGHT) & (F.col("toxic") >= LEAST_TEXTS)
    top = counted.withColumn("weight", weight).where(heavy).orderBy("key").collect()
    p = hot / (hot + cold)
    chance = log(1 / total)
    entries = {r.key: r.weight for r in top if _tail(r.toxic, r.toxic + r.clean, p) <= chance}
    found = Lexicon(entries, [folded(e) for e in exceptions if folded(e) != " "])
    found.exceptions += _learned_exceptions(unique, found, hot, cold)
    found.curve = _curve(taken, found)
    found.trained = True
    return found


def _learned_exceptions(unique: DataFrame, lexicon: Lexicon, hot: int, cold: int) -> list[str]:
    shared = unique.sparkSession.sparkContext.broadcast(lexicon)

    def phrases():
        automaton = shared.value.automaton()

        def keys(text: str) -> set[str]:
            out = set()
            for start in matches(automaton, text):
                end = text.index(" ", start + 1)
                out.add(text[start : end + 1])
                after, before = text.find(" ", end + 1), text.rfind(" ", 0, start)
                if after > 0:
                    out.add(text[start : after + 1])
                if before >= 0:
                    out.add(text[before : end + 1])
            return out

        return keys

    rate = hot / (hot + cold)
    counted = _counted(unique, phrases, LEAST_TEXTS)
    kept = counted.where(F.col("toxic") <= rate / 2 * (F.col("toxic") + F.col("clean")))
    return [r.key for r in kept.orderBy("key").collect()]


def _curve(taken: DataFrame, lexicon: Lexicon) -> tuple[float, float, float]:
    """Logistic regression on two numbers per row of the (bounded) sample."""
    shared = taken.sparkSession.sparkContext.broadcast(lexicon)

    def make():
        automaton = shared.value.automaton()

        def work(texts: pa.Array):
            values = [_features(automaton, t) for t in texts.to_pylist()]
            return [[v[0] for v in values], [v[1] for v in values]]

        return work

    table = rows.append(taken, ["folded"], make, "x double, y double").select("x", "y", "toxic").toArrow()
    x = np.c_[np.ones(table.num_rows), table.column("x").to_numpy(), table.column("y").to_numpy()]
    t = table.column("toxic").to_numpy()
    w = np.zeros(3)
    ridge = np.diag([1e-6, 0.05, 0.05])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -60, 60)))
        step = np.linalg.solve((x.T * (p * (1 - p) + 1e-9)) @ x + ridge, x.T @ (t - p) - ridge @ w)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return tuple(map(float, w))


def score(docs: DataFrame, lexicon: Lexicon, text: str = "text") -> DataFrame:
    """``docs`` with ``score`` and ``hits`` (matched words, as folded, with weights)."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)
    fields = "score double, hits array<struct<word string, weight double>>"
    kind = rows._arrow(rows.T._parse_datatype_string(fields).fields[1].dataType)

    def make():
        lexicon = shared.value
        automaton = lexicon.automaton()

        def work(texts: pa.Array):
            scores, hits = [], []
            for value in texts.to_pylist():
                text = folded(value)
                found = matches(automaton, text)
                scores.append(_curved(lexicon, sum(found.values()), text))
                hits.append(
                    [
                        {"word": text[s + 1 : text.index(" ", s + 1)], "weight": w}
                        for s, w in sorted(found.items())
                    ]
                )
            return [scores, pa.array(hits, kind)]

        return work

    return rows.append(docs, [text], make, fields)


def _curved(lexicon: Lexicon, total: float, text: str) -> float:
    if not lexicon.trained:
        return lexicon.base
    words = max(1, text.count(" ") - 1)
    a, b, c = lexicon.curve
    z = a + b * log1p(total) + c * log1p(100 * total / words)
    return 1 / (1 + exp(-max(-60.0, min(60.0, z))))
