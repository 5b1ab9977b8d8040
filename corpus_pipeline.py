"""The corpus pipeline: documents by language, without near-duplicates, mixed by source, as tokens.

Each stage takes the columns of documents (doc_id, text, lang, source and any others), whatever their names, and all but
the last return the same columns. Empty tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from factmill.llm import pieces
from factmill.llm.common import materialize
from factmill.llm.langid import identify_documents
from factmill.llm.mixing import mixed
from factmill.llm.simhash import keep_one


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; the others go: null and empty texts and those without letters, and texts that
    are none of the languages that the labels name. Null labels and sources say nothing. Rows that repeat are judged
    alike and all stay or go."""
    return identify_documents(docs).where("language.accepted").select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity 0.8 or more): that of the smallest
    doc_id, ties by hash of the text. A row without doc_id stays only where no other of its group has one. Texts without
    words, null ones too, are one group. Rows that repeat are one."""
    return keep_one(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them, three times at most. A null source is a source. Texts without
    words, null ones too, are not taken. Rows alike in doc_id, source and text are taken as often as all of them."""
    return mixed(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's token ids, and whether they decode to its text; a row for each row. Null and empty texts: no ids.
    Long texts are encoded in chunks, with the same ids."""
    return pieces.round_trip(docs)


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("mixing", mixing), ("tokenize", tokenize)]
#: Fingerprints, random ranks and tokens can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
