"""Corpus pipeline: quality classifier, quality rules, near-duplicates, secrets, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridstone.llm import packing, quality_bayes, quality_rules, secrets, simhash
from gridstone.llm.common import materialize, table


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps; it is trained on the corpus' labelled documents.

    A null text counts as empty, a null source or lang as one of its own. Rows that repeat an id or text are judged one by one, alike
    where they are alike; columns pass unchanged, and an empty table stays empty.
    """
    return quality_bayes.keep_good(docs, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def apply_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the line labels keep. A null text has no words and goes; repeated rows are judged one by one; columns pass unchanged."""
    return quality_rules.keep_quality(docs, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest doc_id, of each component of near copies: five-word shingles, similarity 0.8 or more.

    Texts without words, null ones too, are copies of each other; rows without an id come last. Of rows that repeat the id and text
    that stays, one stays.
    """
    return simhash.keep_first_similar(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their secrets masked and n_chars counted anew. A null text stays null; rows that repeat or lack an id are masked like others."""
    return secrets.redact(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in training sequences. A null text is a piece of the end id alone; repeated rows are packed one by one."""
    return packing.best_fit_packing(docs, packing.vocabulary_path())


STAGES = [
    ("quality_classifier", classify),
    ("quality_rules", apply_rules),
    ("simhash_near_dedup", drop_near_copies),
    ("secret_scan", mask_secrets),
    ("best_fit_packing", pack_sequences),
]

#: The classifier, the line labels, the fingerprints and the tokens are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each stored before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
