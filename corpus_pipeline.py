"""A corpus pipeline: toxicity, language, near duplicates, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; its result
is written as Parquet and read again. All stages but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quillstone.llm import jaccard, language, packing, toxicity
from quillstone.llm.shared import staged, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, fitted on the labels, scores at one half or more go.

    Null and empty texts stay unless their weak evidence scores one half; repeated rows stay or go
    together; other columns may hold nulls; without labels of both kinds all documents stay; an
    empty table stays empty.
    """
    return toxicity.without_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, without a language that two fifths of their words bear, or of unfamiliar words go.

    Null and empty texts have no letters and go; repeated rows stay or go together; other columns
    may hold nulls; if no training document has a language, all documents go; an empty table stays
    empty.
    """
    return language.in_known_language(docs, language.fit(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that with the smallest doc_id.

    Null and empty texts are like nothing and stay; rows that repeat an id and text are one
    document, of which one row stays; rows with a null doc_id cannot be told apart and stay; an
    empty table stays empty.
    """
    return jaccard.one_of_each(docs, words=5, percent=75)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents left, as pieces of sequences of 1024 tokens along a Hilbert curve.

    A null or empty text is the end token alone; repeated rows are packed once each; a null doc_id
    stays null; an empty table gives no pieces.
    """
    path = public_tokenizers.path
    return packing.pack(docs, path("byte_bpe_50k.json"), path("byte_bpe_50k.tiktoken"), 1024, 0)


STAGES = [
    ("toxicity", drop_toxic),
    ("language", drop_unknown_language),
    ("near_duplicates", drop_near_duplicates),
    ("packing", pack),
]

#: SQL cannot express the stages; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, on the table documents."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
