"""A corpus made ready for training: four stages, each over all that the one before it has kept.

Each stage's rows are written as Parquet and read again, so no stage depends on what an
executor still holds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from maskframe.llm import language, near_dedup, packing, pii
from maskframe.llm.common import table, written
from maskframe.llm.tokens import tokenizer_file


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or without a language more likely than all others together, go."""
    return language.accepted(docs, language.train(docs))


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that share four fifths of their five-word shingles, or are linked by others that do, the first stays."""
    return near_dedup.keep_one(docs)


def private_data_replaced(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data, and words that disclose whose it is, are replaced; every document stays."""
    return pii.sanitise(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' ids, cut and packed into sequences of 4096."""
    return packing.pack(docs, tokenizer_file("word_bpe_49k.json"))


STAGES = [
    ("language ID", known_language),
    ("MinHash near-dedup", one_of_near_copies),
    ("PII", private_data_replaced),
    ("packing", packed),
]

#: Naive Bayes, sketches and a tokenizer are not SQL; the tests compare run() with a version by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.lower().replace(" ", "-"))
    return docs
