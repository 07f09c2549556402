"""A training corpus from raw documents: toxic documents go, one document of each
near-duplicate group stays, documents with benchmark passages go, secrets are
masked, and what is left is mixed to target source weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import decontam, jaccard, mixing, secrets, toxicity
from tessella.llm.common import table, written


# Every stage judges rows one by one or by their texts: null texts, empty and very long ones, repeated rows and null
# ids are kept unless a stage's rule rejects them. Further columns pass through, whatever their names; an empty table
# gives an empty result.


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.5; null and empty texts stay. The lexicon is learned from the labelled rows of ``docs``."""
    return toxicity.without_toxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near copies (five words, similarity of 0.8 or more): the one with the smallest id.

    Texts without words are each a group of their own; rows without an id come last.
    """
    return jaccard.one_per_class(docs, jaccard.document_classes(docs, threshold=0.8, n=5, target_recall=0.999))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of ten consecutive words of a benchmark item (of all words of a shorter item); words that only stand near each other do not reject."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"), window=10)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets in their texts masked; ``n_chars`` is counted anew where there is a text."""
    masked = secrets.masked(docs)
    return masked.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each copy of a document in the mixture, with its masked text.

    The sources' entropy makes up half of what it misses to the largest; the
    budget reads every document at least once, and none more than four times.
    """
    return mixing.mixed(docs, entropy_gain=0.5, max_repeats=4.0, cover=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", mask_secrets),
    ("mixing", mix_sources),
]

#: Toxicity, near duplicates and mixing can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, from ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
