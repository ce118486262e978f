"""A training-data pipeline over ``documents``: language, toxicity, near-duplicates, secrets, packing.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that its predecessor kept.  The stages but the
last return the columns of ``documents``; the last one places what is left in sequences.  An empty table gives no rows in any
stage, other columns are passed on as they are, and what each stage does with nulls, empty texts and repeats it states.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linetide.llm import language_id, packing, secret_scan, shingle_dedup, toxicity
from linetide.llm.frames import settled, table


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose language is not rejected.

    Texts that are null, empty or without a letter go; null ids, null languages and repeated rows are judged like others.
    """
    return language_id.without_rejected(docs)


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that are not predicted toxic; learns from the labels of the documents at hand.

    Null and empty texts are judged by the bias; null ids and repeated rows like others; without labels all stay.
    """
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group linked at a five-word shingle similarity of 0.8 or more: the one with the least id.

    Null ids come last.  Texts without words are one group.  Of repeated rows one stays, of different texts under one id each
    is judged by itself.
    """
    return shingle_dedup.without_near_duplicates(docs)


def secrets_redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps every document, with its secrets replaced; n_chars is that of the new text.

    A null text stays null, with a null n_chars; null ids and repeated rows are treated like others.
    """
    clean = secret_scan.redact_documents(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places every document's pieces in sequences of 2048 tokens.

    Null and empty texts are one piece of one token; null ids and repeated rows are packed like others.
    """
    return packing.pack_documents(docs)


STAGES = [
    ("language_id", known_language),
    ("toxicity", not_toxic),
    ("simhash_dedup", one_of_each),
    ("secret_scan", secrets_redacted),
    ("best_fit_packing", packed),
]

#: Models, hashes and vocabularies are beyond SQL; the tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over ``documents``; what a stage returns is written as Parquet and read again.

    What a stage wrote on its way is removed after it, and a stage's output after the next one's.
    """
    docs = table(spark, sf_dir, "documents")
    last = None
    for name, stage in STAGES[:-1]:
        docs = settled(lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), name, last)
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)
