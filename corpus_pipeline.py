"""The corpus pipeline: language ID, exact dedup, near-duplicate join, secret scan, packing.

Each stage takes documents and returns documents, the last one the pieces of packed sequences; what a stage returns is
written as Parquet and read again as the next one's input. Every stage takes whole texts, keeps all columns that it is given,
whatever their names, and turns an empty table into an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigmaloom.llm import common, exact_dedup, jaccard, langid, packing, secrets
from sigmaloom.llm.queries import tokenizer_file

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def in_a_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns the languages of the labelled documents, all of them, and rejects documents without a language: those with null or empty text,
    or without a letter. Repeated rows stay or go together; null ids do not matter."""
    return langid.accepted(docs, langid.train(docs))


def exact_copies_removed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays, of rows that share both one; null ids are the smallest, null texts count as
    empty."""
    return exact_dedup.unique(docs)


def near_copies_removed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of the documents that links of Jaccard similarity join, the one with the smallest doc_id stays; rows that share that id stay
    together. Texts without words are linked with nothing and stay. A null id is no smallest one: such rows stay if their whole group has
    none."""
    return jaccard.representatives(docs)


def secrets_redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets become a mark, n_chars follows; every row stays, null texts stay null."""
    clean = secrets.redacted(docs)
    return clean.withColumn("n_chars", F.length("text").cast(clean.schema["n_chars"].dataType)) if "n_chars" in clean.columns else clean


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of sequences of 4096 tokens, of every row: null and empty texts have the closing id, repeated rows are packed each."""
    return packing.pack_documents(docs, tokenizer_file("word_bpe_49k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("language_id", in_a_language),
    ("exact_dedup", exact_copies_removed),
    ("near_dedup", near_copies_removed),
    ("secret_scan", secrets_redacted),
    ("packing", packed),
]

#: Language models, merges and packing have no SQL; tests compare the stages with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = common.staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
