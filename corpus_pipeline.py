"""Corpus pipeline: quality filter, exact dedup, near dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame; between stages the rows are written and read again. All
but the last return the columns of documents. Mixing raises rates only (floor 1): it repeats rows of languages that are
short of their target and drops none, so that no clean document is lost.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.common import Stage
from tidemark.llm.exact_dedup import keep_first_copies
from tidemark.llm.jaccard import keep_one_per_component
from tidemark.llm.mixing import mix_documents
from tidemark.llm.packing import pack
from tidemark.llm.quality import quality_scores
from tidemark.llm.queries import LANGUAGE_TARGETS, graded, language_labels, table

#: No SQL has the classifiers, the rates and the packing; tests hold the stages against brute force.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that are at least as likely good as not."""
    scored = quality_scores(docs, graded(table(spark, sf_dir, "labels")), n_grades=3, accept=2)
    return scored.filter("kept").select(*docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one of equal texts."""
    return keep_first_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies."""
    return keep_one_per_component(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats documents as their rates say."""
    return mix_documents(docs, language_labels(spark, sf_dir), LANGUAGE_TARGETS, floor=1.0)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places all that is left in sequences of 1024 tokens."""
    return pack(docs)


STAGES = [
    ("quality classifier", quality),
    ("exact dedup", exact),
    ("n-gram Jaccard join", near),
    ("mixing to target weights", mix),
    ("best-fit packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    stage, docs = Stage(spark, "pipeline"), table(spark, sf_dir, "documents")
    for k, (_, f) in enumerate(STAGES[:-1]):
        docs = stage.write(f(spark, docs, sf_dir), f"stage{k}", "zstd")
    return STAGES[-1][1](spark, docs, sf_dir)
