from __future__ import annotations

import random
from collections import Counter
from math import comb, exp, log, log1p

from twinkeep.llm import queries, toxicity

MEDIUM = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    found = queries.op2_toxicity(spark, MEDIUM)
    labels = spark.read.parquet(f"{MEDIUM}/labels.parquet").select("doc_id", "toxic")
    rows = found.where("held_out").join(labels, "doc_id").collect()
    hit = sum(r.predicted == 1 and r.toxic == 1 for r in rows)
    said, real = sum(r.predicted for r in rows), sum(r.toxic for r in rows)
    print(hit, said, real, len(rows))
    assert hit / said > 0.95 and hit / real > 0.9
    assert found.count() == 10_000 and all(0 <= r.score <= 1 for r in rows)


def test_folding():
    assert toxicity.folded("An 1D10T, $TUPІD-ＭＯＲＯＮ!") == " an idiot stupid moron "
    assert toxicity.folded(None) == toxicity.folded(" .,") == " "
    plain = toxicity.folded("asshole")
    for form in ("a55ho1e", "A$$HOLE", "аsshоle", "ässhölé", "a\u200bss\u00adhole", "ａｓｓｈｏｌｅ", "𝐚𝐬𝐬𝐡𝐨𝐥𝐞", "𝔸𝕊𝕊hole",
                 "assho|e", "a\u0301sshole", "assh0l3", "ℯ".join(["asshol", ""])):
        assert toxicity.folded(form) == plain, form
    for form in ("sh!t", "shi+", "5hit", "sh1t", "śhït"):
        assert toxicity.folded(form + "s") == toxicity.folded("shits"), form
    assert toxicity.folded("6a8y 2oo") == toxicity.folded("gaby zoo")
    assert toxicity.folded("455 $455 2024, wow! 1+1 c++ 100%") == " wow c "


def test_matches_against_a_plain_search():
    rng = random.Random(3)
    lexicon = toxicity.Lexicon({" ab ": 2.0, " abc": 3.0, " b ": 1.0}, [" c ab ", " b b "])
    automaton = lexicon.automaton()
    for _ in range(500):
        words = [rng.choice(["a", "ab", "abc", "abcd", "b", "c"]) for _ in range(rng.randint(0, 9))]
        text = toxicity.folded(" ".join(words))
        expected, at = {}, 0
        for k, word in enumerate(words):
            weight = {"ab": 2.0, "b": 1.0}.get(word, 3.0 if word.startswith("abc") else 0)
            near = (words[k - 1] if k else "", word, words[k + 1] if k + 1 < len(words) else "")
            safe = near[:2] in (("c", "ab"), ("b", "b")) or near[1:] == ("b", "b")
            if weight and not safe:
                expected[at] = weight
            at += len(word) + 1
        assert toxicity.matches(automaton, text) == expected


def test_learns_words_beginnings_and_exceptions(spark):
    rng = random.Random(1)
    filler = [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(20) for j in range(20)]
    data = []
    for k in range(900):
        words = [rng.choice(filler) for _ in range(30)]
        bad = k % 5 == 0
        if bad:
            words.insert(rng.randint(1, 29), rng.choice(["vile", "grutz" + rng.choice("abcdef")]))
        elif k % 5 == 1:
            words[10:10] = ["angle", "vile"]
        data.append((k, " ".join(words), int(bad)))
    lexicon = toxicity.train(spark.createDataFrame(data, "doc_id long, text string, toxic int"))
    assert " grutz" in lexicon.entries
    docs = [(1, "wab wcd v1le wde", 0.0), (2, "wab angle vile wde", 0.0), (3, "wab Grutzq wde", 0.0), (4, None, 0.0),
            (None, "", 0.0), (3, "wab Grutzq wde", 0.0), (5, "wab " * 30_000, 0.0)]
    rows = toxicity.score(spark.createDataFrame(docs, "doc_id long, text string, hits double"), lexicon).collect()
    assert [r.score >= 0.5 for r in rows][1:] == [False, True, False, False, True, False]
    assert rows[2].hits[0].word == "grutzq"


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "x", None), (2, None, 7)], "doc_id long, text string, toxic int")
    lexicon = toxicity.train(docs)
    assert [r.score for r in toxicity.score(docs, lexicon).collect()] == [0.0, 0.0]
    assert toxicity.score(docs.limit(0), lexicon).count() == 0


def plain_tail(hits, n, p):
    return sum(comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(hits, n + 1))


def plain_hits(entries, exceptions, text):
    """Weights of matched words, by a plain search word by word."""
    words = text.split()
    starts = [1 + sum(len(w) + 1 for w in words[:k]) - 1 for k in range(len(words))]
    found = {}
    for k, word in enumerate(words):
        able = [w for e, w in entries.items() if f" {word} " == e or (not e.endswith(" ") and f" {word} ".startswith(e))]
        covered = any(
            text.startswith(e, s) and s <= starts[k] < s + len(e) - 1 for e in exceptions for s in range(len(text))
        )
        if able and not covered:
            found[k] = max(able)
    return found


def test_lexicon_exceptions_and_scores_by_brute_force(spark):
    rng = random.Random(4)
    filler = ["".join(rng.choice("abdefghkm") for _ in range(rng.randint(2, 7))) for _ in range(60)]
    data = []
    for k in range(400):
        words = [rng.choice(filler) for _ in range(rng.randint(3, 12))]
        if k % 4 == 0:
            words.insert(rng.randint(0, 2), rng.choice(["vyper", "grutz" + rng.choice("abcd")]))
        elif k % 16 == 1:
            words[1:1] = ["sweet", "vyper"]
        data.append((k, " ".join(words), int(k % 4 == 0)))
    # Copies that differ in a word each: no evidence for the words they share.
    copied = ["".join(rng.choice("abdefghkm") for _ in range(9)) for _ in range(60)]
    data += [(500 + k, " ".join([*copied[:k], "kkk", *copied[k + 1 :]]), 1) for k in range(20)]
    data += [(900, data[0][1], 1), (901, None, 0), (902, "no label", None)]
    lexicon = toxicity.train(spark.createDataFrame(data, "doc_id long, text string, toxic int"))

    left = [(label, toxicity.folded(text)) for _, text, label in data if label is not None]
    for seed in range(3):
        best = {}
        for pair in left:
            near = toxicity.least_hashes(pair[1])[seed]
            best[near] = max(pair, best.get(near, pair))
        left = list(best.values())
    unique = {text: label for label, text in left}
    hot = sum(unique.values())
    cold = len(unique) - hot
    toxic, clean = Counter(), Counter()
    for text, label in unique.items():
        keys = {f" {w} " for w in text.split()} | {f" {w[:n]}" for w in text.split() for n in range(4, 8) if len(w) > n}
        (toxic if label else clean).update(keys)
    listed = [k for k in toxic | clean if toxic[k] + clean[k] >= 3]
    entries = {}
    for key in listed:
        weight = log((toxic[key] + 1) / (hot + 2)) - log((clean[key] + 1) / (cold + 2))
        rare = plain_tail(toxic[key], toxic[key] + clean[key], hot / len(unique)) <= 1 / len(listed)
        if weight >= toxicity.LEAST_WEIGHT and toxic[key] >= 3 and rare:
            entries[key] = weight
    assert entries and lexicon.entries.keys() == entries.keys()
    assert not any(f" {w} " in entries for w in copied)
    assert all(abs(lexicon.entries[k] - w) < 1e-9 for k, w in entries.items())

    near = {0: Counter(), 1: Counter()}
    for text, label in unique.items():
        words, keys = text.split(), set()
        for k in plain_hits(entries, [], text):
            keys.add(f" {words[k]} ")
            keys |= {f" {a} {b} " for a, b in zip(words[max(0, k - 1) : k + 1], words[max(0, k - 1) + 1 : k + 2])}
            if k + 1 < len(words):
                keys.add(f" {words[k]} {words[k + 1]} ")
        near[label].update(keys)
    safe = [
        k for k in near[0] | near[1]
        if near[0][k] + near[1][k] >= 3 and near[1][k] <= hot / len(unique) / 2 * (near[0][k] + near[1][k])
    ]
    assert safe and sorted(lexicon.exceptions) == sorted(safe)

    # The curve is where the penalised likelihood has no slope.
    def numbers(text):
        total = sum(plain_hits(entries, safe, text).values())
        return 1.0, log1p(total), log1p(100 * total / max(1, len(text.split())))

    rows = [(numbers(toxicity.folded(t)), label) for _, t, label in data if label is not None]
    logistic = lambda x: 1 / (1 + exp(-sum(a * b for a, b in zip(lexicon.curve, x))))
    for i, ridge in enumerate((1e-6, 0.05, 0.05)):
        slope = sum((label - logistic(x)) * x[i] for x, label in rows) - ridge * lexicon.curve[i]
        assert abs(slope) < 1e-4
    docs = spark.createDataFrame([r[:2] for r in data], "doc_id long, text string")
    for row in toxicity.score(docs, lexicon).collect():
        assert abs(row.score - logistic(numbers(toxicity.folded(row.text)))) < 1e-9


def test_tail_against_exact_sums():
    for hits, n, p in ((3, 3, 0.1), (9, 30, 0.05), (700, 1000, 0.5), (2, 50, 0.2), (480, 900, 0.5)):
        exact = plain_tail(hits, n, p)
        got = toxicity._tail(hits, n, p)
        assert got == 0.0 if hits <= n * p else abs(got - log(exact)) < 1e-6
