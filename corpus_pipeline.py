"""Documents to packed training sequences, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet and hands it, read again,
to the next. All stages but the last return the columns of documents.

Defined results of the chain: rows whose text is null, empty or without a letter go in the first stage, and those of no learned
language (a score under 0.3), unless no row has a lang; rows without a
doc_id stay as they are in the second and third; of rows with one doc_id and one word sequence one stays, rows of one
doc_id with other texts are judged for themselves (and left alone by the third stage, but for the smallest text); texts
are whole, however long; extra columns, whatever their names, go through; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from claimloom.llm import jaccard_join, language_id, packing, queries, secret_scan, suffix_dedup
from claimloom.sources.scratch import mark, materialize, release
from claimloom.sources.shipping import ship


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or in none of the learned languages (a score under 0.3), go; where no row has a lang, nothing
    can be learned and all documents with a letter stay (operator 2)."""
    ship(spark)
    return language_id.keep_identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays (operator 3)."""
    ship(spark)
    return jaccard_join.keep_one(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words and more stay where they occur first and are cut elsewhere (operator 1)."""
    ship(spark)
    return suffix_dedup.remove_copies(docs)


def masked_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the texts (operator 6)."""
    ship(spark)
    return secret_scan.mask_secrets(docs, words=queries.WORD_BPE)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 2048 tokens (operator 9)."""
    ship(spark)
    return packing.pack_documents(docs, queries.WORD_BPE)


STAGES = [
    ("language ID", known_language),
    ("n-gram Jaccard join", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("secret scans", masked_secrets),
    ("best-fit packing", packed),
]
ORACLE_SQL = None  # trained and iterative stages are beyond SQL; tests/llm/test_pipeline.py holds them against plain Python


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs, began = spark.read.parquet(f"{sf_dir}/documents.parquet"), mark()
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), "stage")
        release(spark, began, keep=[docs])  # scratch tables and the result of the stage before
    return docs
