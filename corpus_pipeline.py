"""From raw documents to a training mixture, in five stages.

Each stage takes what the one before kept and returns the columns of ``documents``;
between stages the rows are written to the shared folder and read again. All but the
last filter or redact; the last samples.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinkeep.llm import mixing, pii, quality, queries, rows, simhash, winnowing

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the labelled neighbours call good."""
    return quality.keep_good(docs, queries.quality_model(docs, spark, sf_dir), queries.GOOD)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class whose fingerprints link: the one with the smallest id."""
    return simhash.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold less than a twentieth of benchmark words."""
    return winnowing.drop_contaminated(docs, rows.read_table(spark, sf_dir, "benchmark"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind; ``n_chars`` follows the text."""
    covered = rows.Covered(docs)
    masked = pii.find_pii(covered.inner, covered.at("text"), mask=True)
    text, length = F.col("masked"), F.length("masked").cast("long")
    count = F.when(text.isNull(), F.col(covered.at("n_chars"))).otherwise(length)
    inner = masked.withColumns({covered.at("text"): text, covered.at("n_chars"): count})
    return covered.back(inner)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose sources, languages and topics have the target weights.

    A column of ``docs`` that bears the name of one of the three new ones is replaced.
    """
    new = ("n_tokens", "topic", "probability")
    covered = rows.Covered(docs.drop(*[c for c in docs.columns if c.lower() in new]))
    doc_id, text, source, lang = map(covered.at, ("doc_id", "text", "source", "lang"))
    annotated = mixing.annotate(covered.inner, text)
    mixed = mixing.mix(annotated, (source, lang, "topic"), doc_id=doc_id, text=text).where("sampled")
    named = [F.col(covered.at(c)).alias(c) for c in covered.columns]
    return mixed.select(*named, *new)


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("pii", pii_stage),
    ("mixing", mixing_stage),
]

#: Neighbour votes, shingle hashes and raking have no SQL; a test holds the rows against
#: brute-force versions of all stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = rows.read_table(spark, sf_dir, "documents").select(*COLUMNS)
    with rows.small_batches(spark):
        for number, (name, stage) in enumerate(STAGES):
            docs = stage(spark, docs, sf_dir)
            if number < len(STAGES) - 1:
                docs = rows.stored(docs, name)
    return docs
