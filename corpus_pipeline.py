"""From raw documents to packed token rows, each stage one of the text operators.

Language: documents whose language is not accepted go. Near duplicates: one document of each component
stays. Decontamination: documents that hold too much of a benchmark go. Mixing: documents are read as often
as the source weights say. Packing: token ids in rows of fixed length. All stages but the last return the
columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from demandflow.llm import decontaminate, language_id, mixing, near_dedup, packing
from demandflow.session import cut_lineage


def accepted_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.accepted_documents(docs)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.one_of_each(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.cleaned(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("language", accepted_language),
    ("near_duplicates", without_near_duplicates),
    ("decontamination", decontaminated),
    ("mixing", mixed),
    ("packing", packed),
]

#: SQL cannot express the language model and the packing; tests/llm/test_corpus_pipeline.py compares with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each but the last is written to the shared checkpoint folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
