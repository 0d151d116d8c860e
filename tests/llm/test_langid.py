from __future__ import annotations

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SMALL
from twinkeep.llm import langid, queries

MEDIUM = "/root/testdata/sf0.01"


def train_rows(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet").where("crc32(cast(doc_id as string)) % 4 <> 2")


def test_held_out_accuracy(spark):
    found = queries.op3_language_mixtures(spark, MEDIUM)
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet").select("doc_id", "lang", "text")
    rows = found.join(docs, "doc_id").where("held_out AND length(text) > 40").collect()
    right = sum(r.lang == r.lang_pred for r in rows)
    assert len(rows) > 150 and right / len(rows) > 0.98
    assert found.count() == docs.count()
    assert all(0 <= r.score <= 1 for r in rows)


def test_mixture_shares(spark):
    model = langid.train(train_rows(spark, MEDIUM))
    held = spark.read.parquet(f"{MEDIUM}/documents.parquet").where("crc32(cast(doc_id as string)) % 4 = 2")
    texts = {r.lang: r.t for r in held.groupBy("lang").agg(F.max_by("text", F.length("text")).alias("t")).collect()}
    mixed = texts["de"][:3000] + " " + texts["fr"][:1500]
    frame = spark.createDataFrame([(mixed,), (texts["es"],)], "text string")
    two, one = [r.languages for r in langid.identify(frame, model).collect()]
    assert [x.lang for x in two] == ["de", "fr"] and two[0].share == pytest.approx(2 / 3, abs=0.1)
    assert [x.lang for x in one] == ["es"] and one[0].share == 1


def plain_fit(text, model, chosen):
    """Shares and penalised likelihood of one set of languages, trigram by trigram."""
    data = np.frombuffer(text.encode(), np.uint8)
    bucket, _ = langid._trigrams(data, np.array([0, len(data)]), 0, 1)
    chances = model.chances[list(chosen)][:, bucket].astype(float)
    shares = np.full(len(chosen), 1 / len(chosen))
    for _ in range(60):
        joint = shares[:, None] * chances
        shares = (joint / joint.sum(axis=0)).mean(axis=1)
    return shares, np.log((shares[:, None] * chances).sum(axis=0)).sum() - (len(chosen) - 1) / 2 * np.log(len(bucket))


def test_sets_of_any_size_against_all_sets(spark):
    """Texts in one to all languages: the set with the best penalised likelihood of all sets."""
    model = langid.train(train_rows(spark, MEDIUM))
    held = spark.read.parquet(f"{MEDIUM}/documents.parquet").where("crc32(cast(doc_id as string)) % 4 = 2")
    longest = {r.lang: r.t for r in held.groupBy("lang").agg(F.max_by("text", F.length("text")).alias("t")).collect()}
    names = model.names
    assert len(names) >= 4
    sets = [s for size in range(1, len(names) + 1) for s in itertools.combinations(range(len(names)), size)]
    texts = [" ".join(longest[names[k]][: 900 + 300 * k] for k in s) for s in sets]
    found = langid.identify(spark.createDataFrame([(t,) for t in texts], "text string"), model).collect()
    for own, row, text in zip(sets, found, texts):
        best = max(sets, key=lambda s: plain_fit(text, model, s)[1])
        assert {x.lang for x in row.languages} == {names[k] for k in best} == {names[k] for k in own}
        shares = dict(zip(best, plain_fit(text, model, best)[0]))
        assert all(x.share == pytest.approx(shares[names.index(x.lang)], abs=0.02) for x in row.languages)


def test_counts_are_exact(spark):
    """Probabilities against counts taken text by text."""
    labelled = train_rows(spark, SMALL)
    model = langid.train(labelled)
    counts = {n: np.full(1 << langid.BUCKET_BITS, langid.SMOOTHING) for n in model.names}
    for r in labelled.collect():
        folded = bytes(langid._FOLD[list(r.text.encode())])
        folded = b" " + folded + b" "
        for k in range(len(folded) - 2):
            gram = folded[k : k + 3]
            if gram[1] != 32 or 32 not in (gram[0], gram[2]):
                bucket = (int.from_bytes(gram) * 0x9E3779B97F4A7C15 % (1 << 64)) >> (64 - langid.BUCKET_BITS)
                counts[r.lang][bucket] += 1
    for k, name in enumerate(model.names):
        assert np.allclose(model.chances[k], counts[name] / counts[name].sum())


def test_odd_rows(spark):
    model = langid.train(train_rows(spark, SMALL))
    data = [(1, None, 1), (2, "", 1), (3, "123 ... ¿ …", 1), (None, "a", 1), (5, "the and of " * 40_000, 1), (5, "é", 1)]
    docs = spark.createDataFrame(data, "doc_id long, text string, score int")
    rows = langid.identify(docs, model).collect()
    assert [r.lang_pred == "und" for r in rows] == [True, True, True, False, False, False]
    assert rows[4].lang_pred == "en" and rows[0].score == 0
    assert langid.identify(docs.limit(0), model).count() == 0
    none = langid.train(spark.createDataFrame([("x", None)], "text string, lang string"))
    assert {r.lang_pred for r in langid.identify(docs, none).collect()} == {"und"}
