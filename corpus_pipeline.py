"""From raw documents to packed training sequences, as five stages over the operators.

Each stage takes all that its predecessor kept. All but the last return documents with
their columns as they were; the last returns the pieces of training sequences.
A document is a row; columns other than those a stage reads pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tablewash.llm.decontamination import without_contamination
from tablewash.llm.near_dedup import without_near_duplicates
from tablewash.llm.packing import pack_documents
from tablewash.llm.quality_classifier import classify
from tablewash.llm.quality_rules import quality_rules, trusted_ids
from tablewash.session import prepare_session, stored


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier keeps, which learns from the labels."""
    labels = prepare_session(spark).read.parquet(f"{sf_dir}/labels.parquet")
    return classify(docs, labels).filter("kept").select(*docs.columns)


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose countable faults and n-gram ratio are within limits."""
    labels = prepare_session(spark).read.parquet(f"{sf_dir}/labels.parquet")
    return quality_rules(docs, trusted_ids(labels)).filter("kept").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that with the smallest id."""
    prepare_session(spark)
    return without_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of the benchmark's items."""
    return without_contamination(docs, prepare_session(spark).read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents, each with its place in a training sequence."""
    prepare_session(spark)
    return pack_documents(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("quality rules", rules),
    ("near dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("best-fit packing", packing),
]

# A fitted model, hashes and a greedy packing decide what stays and where it goes.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    prepare_session(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
