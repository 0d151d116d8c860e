from __future__ import annotations

from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from twinkeep.llm import mixing, queries

MEDIUM = "/root/testdata/sf0.01"
DIMS = ("source", "lang", "topic")


def brute(cells, targets, budget):
    """{cell: probability} by raking in plain Python and bisection of the scale."""
    total = sum(cells.values())
    weight = {c: t / total for c, t in cells.items()}
    for _ in range(200):
        for k, d in enumerate(DIMS):
            sums = defaultdict(float)
            for c, w in weight.items():
                sums[c[k]] += w
            weight = {c: w * targets[d].get(c[k], 0) / sums[c[k]] if sums[c[k]] else 0 for c, w in weight.items()}
    ratio = {c: weight[c] / t if t else 0 for c, t in cells.items()}
    low, high = 0.0, 1 / min(r for r in ratio.values() if r)
    for _ in range(200):
        mid = (low + high) / 2
        if sum(t * min(1, mid * ratio[c]) for c, t in cells.items()) < budget * total:
            low = mid
        else:
            high = mid
    return {c: min(1, high * r) for c, r in ratio.items()}


def tempered(cells, power):
    out = {}
    for k, d in enumerate(DIMS):
        sums = defaultdict(float)
        for c, t in cells.items():
            sums[c[k]] += t
        part = {v: s**power for v, s in sums.items() if s}
        out[d] = {v: p / sum(part.values()) for v, p in part.items()}
    return out


@pytest.fixture(scope="module")
def annotated(spark):
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet")
    return mixing.annotate(docs.withColumn("source", F.when(F.col("source") != "src3", F.col("source"))))


@pytest.fixture(scope="module")
def cells(annotated):
    out = defaultdict(float)
    for r in annotated.collect():
        out[(r.source, r.lang, r.topic)] += r.n_tokens
    return dict(out)


@pytest.mark.parametrize("budget", [0.05, 0.3, 0.9])
def test_probabilities_match_brute_force(annotated, cells, budget):
    expected = brute(cells, tempered(cells, mixing.TEMPER), budget)
    for r in mixing.mix(annotated, budget=budget).collect():
        assert r.probability == pytest.approx(expected[(r.source, r.lang, r.topic)], rel=2e-3, abs=1e-6)


def test_given_targets_hold(annotated, cells):
    targets = {"source": {"src0": 0.2, None: 0.1}, "lang": {"en": 0.25, "de": 0.25, "fr": 0.25, "es": 0.25}, "topic": 1.0}
    rows = mixing.mix(annotated, targets=targets, budget=0.05).collect()
    tokens = sum(r.n_tokens * r.probability for r in rows)
    share = lambda test: sum(r.n_tokens * r.probability for r in rows if test(r)) / tokens
    assert share(lambda r: r.source == "src0") == pytest.approx(0.2, abs=0.003)
    assert share(lambda r: r.source is None) == pytest.approx(0.1, abs=0.003)
    assert share(lambda r: r.lang == "es") == pytest.approx(0.25, abs=0.003)
    assert len(rows) == annotated.count()


def test_sample_follows_the_probabilities(spark):
    rows = queries.op6_mixing(spark, "/root/testdata/sf0.1").collect()
    assert len(rows) == 10_000
    total = sum(r.n_tokens for r in rows)
    drawn = sum(r.n_tokens for r in rows if r.sampled)
    assert sum(r.n_tokens * r.probability for r in rows) == pytest.approx(mixing.BUDGET * total, rel=1e-3)
    assert drawn == pytest.approx(mixing.BUDGET * total, rel=0.1)


def test_plans_do_not_grow_on_each_other(spark, annotated, monkeypatch):
    """A step reads what the one before has stored: the driver holds plans of one aggregate and one join."""
    plans, stored = [], mixing.rows.stored

    def noted(frame, label, *more):
        plans.append((label, frame._jdf.queryExecution().optimizedPlan().toString()))
        return stored(frame, label, *more)

    monkeypatch.setattr(mixing.rows, "stored", noted)
    mixing.mix(annotated)
    raked = [p for label, p in plans if label == "raked"]
    assert raked and all(p.count("Join ") <= 1 and p.count("Aggregate ") <= 1 for p in raked)


def test_odd_rows(spark):
    data = [(1, "a b c", "s", "en", 9), (1, "a b c", "s", "en", 9), (2, None, None, None, 9), (None, "", "t", "de", 9),
            (3, "longer words " * 30_000, "t", "de", 9)]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string, lang string, sampled int")
    rows = mixing.mix(mixing.annotate(docs)).collect()
    assert len(rows) == 5 and all(0 <= r.probability <= 1 for r in rows)
    assert [r.n_tokens for r in sorted(rows, key=lambda r: r.n_tokens)] == [0, 0, 3, 3, 60_000]
    assert mixing.mix(mixing.annotate(docs.limit(0))).count() == 0
    assert len(mixing.mix(mixing.annotate(docs.where("text IS NULL"))).collect()) == 1
