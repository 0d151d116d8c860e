"""The pipeline against brute-force versions of its stages."""

from __future__ import annotations

import corpus_pipeline
from pyspark.sql import functions as F
import __spark_entry__ as entry
from tests.llm import test_mixing, test_pii, test_simhash, test_winnowing
from twinkeep.llm import mixing, pii, quality, queries

SF = "/root/testdata/sf0.001"

#: Names that the stages use inside.
INNER = (
    "score", "nearest", "masked", "pii", "candidates", "n_words", "__row", "simhash", "spans", "items", "contaminated",
    "__key", "__c0", "__c1", "__source", "__topic", "tokens", "sampled", "first", "root", "least_id", "row", "label",
)


def texts(frame):
    return {r.doc_id: r for r in frame.collect()}


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    one, two, three, four, five = [f for _, f in corpus_pipeline.STAGES]

    kept = one(spark, docs, SF)
    scores = quality.score(docs, queries.quality_model(docs, spark, SF))
    assert set(texts(kept)) == {r.doc_id for r in scores.collect() if r.score >= queries.GOOD}
    assert kept.columns == docs.columns

    before = texts(kept)
    ids = sorted(before)
    codes = [test_simhash.plain_fingerprint(before[i].text) for i in ids]
    single = two(spark, kept, SF)
    assert sorted(texts(single)) == sorted({ids[k] for k in test_simhash.brute_classes(codes)})
    assert single.columns == docs.columns

    clean = three(spark, single, SF)
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    judged = test_winnowing.brute([(i, r.text) for i, r in texts(single).items()], items)
    assert set(texts(clean)) == {r[0] for r in judged if not r[5]}
    assert 0 < sum(r[5] for r in judged)

    private = four(spark, clean, SF)
    before, after = texts(clean), texts(private)
    assert set(before) == set(after)
    for key, row in after.items():
        assert row.text == pii.masked(before[key].text, pii.spans(before[key].text))
        assert row.n_chars == len(row.text)
        spans = [(s.kind, s.start, s.end) for s in pii.spans(before[key].text) if s.kind in pii.BASE_KINDS]
        assert spans == test_pii.brute(before[key].text)

    marked = mixing.annotate(private).collect()
    cells = {}
    for r in marked:
        key = (r.source, r.lang, r.topic)
        cells[key] = cells.get(key, 0) + r.n_tokens
    expected = test_mixing.brute(cells, test_mixing.tempered(cells, mixing.TEMPER), mixing.BUDGET)
    last = five(spark, private, SF).collect()
    every = mixing.mix(mixing.annotate(private)).collect()
    for r in every:
        assert abs(r.probability - expected[(r.source, r.lang, r.topic)]) < 5e-3
    assert {r.doc_id for r in last} == {r.doc_id for r in every if r.sampled}

    whole = entry.queries()["pipeline"](spark, SF).collect()
    plain = lambda rows: sorted(str({**r.asDict(), "probability": round(r.probability, 6)}) for r in rows)
    assert plain(whole) == plain(last)


def test_odd_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(40)
    odd = spark.createDataFrame(
        [(None, None, None, None, None), (7, None, "en", None, 0), (7, "", "en", "s", 0), (7, "", "en", "s", 0)],
        docs.schema,
    )
    own = {c: F.concat(F.lit(c), F.coalesce("doc_id", F.lit(-1)).cast("string")) for c in INNER}
    frame = docs.unionByName(odd).withColumns(own)
    columns = frame.columns
    for name, stage in corpus_pipeline.STAGES:
        frame = stage(spark, frame, SF)
        assert frame.columns[: len(columns)] == columns, name
        rows = frame.collect()
        for r in rows:
            assert all(r[c] == f"{c}{-1 if r.doc_id is None else r.doc_id}" for c in INNER), name
        frame = spark.createDataFrame(rows, frame.schema)
    assert rows and frame.columns == [*columns, "n_tokens", "topic", "probability"]
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, SF)
        assert empty.count() == 0
