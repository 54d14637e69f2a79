"""From raw documents to packed training sequences, in five stages; each works on all that the one before kept.

All stages but the last keep the columns of ``documents``, whatever they are called, and rows with nulls in any of them. A null text
is scored, compared and packed as an empty one; an empty table gives an empty one at every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from testweave.llm.common import discard, materialize, table
from testweave.llm.jaccard import drop_near_documents
from testweave.llm.packing import pack_documents
from testweave.llm.quality import fit, keep_quality
from testweave.llm.registry import tokenizer_path
from testweave.llm.repeats import remove_repeats
from testweave.llm.secrets import mask_secrets


def _measured(docs: DataFrame) -> DataFrame:
    """``n_chars`` as it is after the text has changed."""
    if "n_chars" not in docs.columns:
        return docs
    kind = docs.schema["n_chars"].dataType
    return docs.withColumn("n_chars", F.length("text").cast(kind))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go. Null and empty texts are scored like others; rows that repeat stay or go alike."""
    return keep_quality(docs, fit(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest id (null ids last).

    Equal rows are near copies too, so one of them stays; texts without words are like nothing else and all stay.
    """
    return drop_near_documents(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 400 bytes and more that stand elsewhere too are cut out; a row keeps its place even if nothing of its text is left. Null texts stay null or become empty."""
    return _measured(remove_repeats(docs))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked; null, empty and clean texts stay as they are, rows that repeat are masked alike."""
    return _measured(mask_secrets(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of tokenised documents, placed in sequences; a null or empty text is its end id, rows that repeat are packed each."""
    return pack_documents(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", quality),
    ("n-gram jaccard join", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("secret scans", secrets),
    ("packing", packing),
]

#: Trained and iterative stages are beyond SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written to the shared folder and read again, and goes when the next is written."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        before, docs = docs, materialize(stage(spark, docs, sf_dir), "stage")
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
