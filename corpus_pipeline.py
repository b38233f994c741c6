"""From raw documents to packed training sequences, in five stages over all documents.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from divit.llm.jaccard_join import near_duplicates_removed
from divit.llm.mixing import mixed
from divit.llm.packing import pack_documents
from divit.llm.secret_scan import redact
from divit.llm.shared import fresh, release, remove, settle
from divit.llm.toxicity import score_toxicity


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leave out the documents that are likelier toxic than not; all labels may teach.

    Rows are judged by their texts alone: rows with equal texts stay or go together, whatever their ids (null ones too). Null and empty texts stay
    unless most labelled rows are toxic. Columns of any name are carried along; an empty table gives no rows.
    """
    scores = score_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), key=True)
    gone, text = fresh(docs, "gone"), F.xxhash64(F.col("text").cast("string"))
    out = settle(scores.where("predicted = 1").select(F.col("key").alias(gone)).distinct(), "toxic")
    return docs.join(out, text == F.col(gone), "left_anti")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class under Jaccard >= 0.8 of five-word shingles: that of the smallest id.

    Rows with a null id count too, texts without words all stay, and of wholly equal rows one stays.
    """
    return near_duplicates_removed(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their secrets replaced by a mark. Null and empty texts stay as they are; n_chars follows the text."""
    return redact(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each copy of a document that the mix of the sources takes. A null source is a source of its own; an empty table gives no rows."""
    return mixed(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their token ids, in sequences of at most 1024. A null or empty text is its end id alone; repeated rows are packed each."""
    return pack_documents(docs)


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("secrets", secrets),
    ("mixing", mixing),
    ("packing", packing),
]

#: Scores, exact joins of texts and tokenisation are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = before = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        after = settle(stage(spark, docs, sf_dir), name, "snappy")
        if docs is not before:
            remove(docs)  # never the input
        docs = after
        release(spark)
    return STAGES[-1][1](spark, docs, sf_dir)
