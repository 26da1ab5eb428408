"""The corpus pipeline: quality, near duplicates, benchmark decontamination, personal data, packing.

``STAGES`` names the stages in order. Each takes (spark, docs, sf_dir) and returns a DataFrame; all but
the last return the columns of documents. A runner writes a stage's rows as Parquet and rereads them as
the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cladeworks.llm import attention_mil, crf_pii, fm_index, jaccard_join, packing
from cladeworks.llm.queries import VOCABULARY
from cladeworks.llm.runtime import stored, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the attention classifier scores 0.5 or more. It learns from ``labels`` and the documents that have them."""
    return attention_mil.kept_documents(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least doc_id, of every component of the Jaccard join."""
    return jaccard_join.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the words of benchmark phrases."""
    return fm_index.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with placeholders for personal data."""
    return crf_pii.redacted(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens and their places in sequences."""
    return packing.pack(packing.token_pieces(docs, VOCABULARY))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("best_fit_packing", best_fit_packing),
]

#: No SQL trains a classifier or decodes a random field; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to documents, each stage's rows written to the shared folder in between."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
