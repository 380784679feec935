"""A corpus pipeline: quality rules, line dedup, near-duplicate join, pseudonyms, packing.

Each stage works on what the one before it kept; all but the last return the
columns of ``documents``.

Defined results: documents without text, or with fewer words than the quality
rules ask for, go in the first stage; texts of any length are worked whole;
equal rows and equal texts leave one document, one with the least doc_id;
documents without a doc_id are in no near-duplicate group and stay; columns
beyond those of ``documents`` pass through as they are, whatever their names;
no documents give no pieces.  Pseudonyms depend on the session's key
(``pii.session_key``), so texts and places differ between sessions without one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from qbank.llm import line_dedup, ngram_join, packing, pii, quality_rules


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; the others lose the lines that fail."""
    return quality_rules.clean(docs)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines stay once; documents of which no word is left go."""
    return line_dedup.clean(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component stays."""
    return ngram_join.clean(docs)


def private_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data become pseudonyms."""
    return pii.clean(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces in training sequences."""
    return packing.pieces(docs, with_ids=False)


STAGES = [
    ("quality_rules", quality_stage),
    ("line_dedup", line_stage),
    ("ngram_join", near_duplicate_stage),
    ("pii", private_stage),
    ("packing", packing_stage),
]

#: Hash-based permutations, tokenisers and curve order have no SQL; tests/llm check each stage by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each result written as Parquet and read again."""
    from qbank.llm.common import table

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = table(docs, name)
    return docs
