"""A training-text pipeline: each stage takes documents and returns those it keeps, the last one packed sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gridscan.llm.common import rows_of, table, written
from gridscan.llm.exact_dedup import dedup_exact
from gridscan.llm.near_dedup import near_duplicates
from gridscan.llm.packing import pack_documents
from gridscan.llm.secret_scan import redacted
from gridscan.llm.toxicity import scorer, train

#: Toxicity and packing cannot be told in SQL.
ORACLE_SQL = None
#: Near copies share this percentage of their five-word shingles or more (op2's contract has 85).
NEAR = 80


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under one half; the model learns from the stored documents and labels."""
    score = scorer(spark, train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))
    return docs.where(score(F.col("text")) < 0.5)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts; of rows alike in id and text, one."""
    kept = dedup_exact(docs).where("kept").select(F.col("doc_id").alias("_id"), "_content")
    return rows_of(docs, kept).dropDuplicates(["doc_id", "text"])


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one of the smallest id, of each group of near copies."""
    kept = near_duplicates(docs, link=NEAR).where("kept").select(F.col("doc_id").alias("_id"), "_content")
    return rows_of(docs, kept)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced by the name of their kind."""
    clean = docs.withColumn("text", redacted(F.col("text")))
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with the sequence they go into."""
    return pack_documents(docs)


STAGES = [("toxicity", toxicity), ("exact_dedup", exact), ("near_dedup", near), ("secret_scan", secrets), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
