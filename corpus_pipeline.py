"""From raw documents to packed sequences: five stages, each over all that the one before it kept.

Defined cases, for every stage: null, blank and short texts fail the quality rules and go no further (a later stage given
them keeps them: they have no near duplicates, no secrets, no words to mix beyond certain copies, and the end token alone
to pack); very long texts are processed whole; repeated rows are one document to near_dedup and rows of their own
elsewhere; ties go to the smaller doc_id; rows without a doc_id are kept; empty tables give empty results; columns beyond
those of documents pass all stages but the last, whatever their names. Copies of a document that the mix repeats are
told apart after packing by example_id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyloom.llm.mixing import mixed_documents
from tallyloom.llm.neardup import deduplicate
from tallyloom.llm.packing import pack_documents
from tallyloom.llm.quality import quality_rules
from tallyloom.llm.secrets import redact_secrets
from tallyloom.llm.staging import staged


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    row = docs.selectExpr("struct(*) as row_", "doc_id", "text")
    return quality_rules(row, labels).filter("kept").select("row_.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, at 0.8 on five-word shingles."""
    return deduplicate(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their secrets blotted out."""
    return redact_secrets(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 4096 tokens."""
    return pack_documents(docs, memory=0.57)  # after four stages an executor has less room


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("secrets", secrets), ("mixing", mixing), ("packing", packing)]
#: Hashed features, sketches and tokenizers have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of the documents table; every stage is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
