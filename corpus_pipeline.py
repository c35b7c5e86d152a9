"""Corpus pipeline: raw documents to packed training sequences, one operator a stage.

Each stage reads what its predecessor wrote and works on all of it. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxlake.llm import decontam, langid, packing, pii, resemblance
from voxlake.llm.common import drop_path, fold, new_path, read_table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language: those with a letter, whose text takes the profile of a learnt language. The profiles
    are learnt from the labelled three quarters of these documents; null or letterless texts go. Equal texts share their
    fate, repeated rows stay."""
    return langid.in_a_language(docs, fold(F.col("doc_id"), 4) != 2)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id from each group of equal or similar ones: five-word shingles, resemblance 0.8. Null and
    empty texts are one group; null ids come last; of repeated rows one stays."""
    return resemblance.representatives(docs, words=5, similarity=0.8)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no test item, edited ones included. Null and empty texts hold none; repeated rows share
    their fate."""
    return decontam.without_leaks(docs, read_table(spark, sf_dir, "benchmark"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each span of personal data replaced by its kind in brackets; n_chars follows. Null and empty texts
    stay as they are; of overlapping spans the first goes; repeated rows are redacted alike."""
    return pii.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences of 2048 tokens. A null or empty text is its end token;
    repeated rows are packed each, in any order."""
    return packing.pack_documents(docs).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("personal_data", redact_personal_data),
    ("packing", pack),
]

#: SimHash, edit distances, profiles and tokenizers can't be expressed in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again."""
    docs, path = read_table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        to = new_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(to)
        if path is not None:
            drop_path(spark, path)
        docs, path = spark.read.parquet(to), to
    return docs
