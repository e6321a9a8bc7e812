"""The corpus pipeline: each stage works on all that the one before it kept.

Edge cases, for every stage: an empty table gives an empty result; rows with nulls in any column are
worked on (a null text counts as empty: the quality rules reject it, and the stages after them would
keep it); repeated rows and rows that share a doc_id are judged each, but for near duplicates, where
they go or stay together; columns beyond those of documents are returned as they are, whatever their
names, but by packing; texts of any length are taken whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from shelfmark.llm.common import clear, scratch, table
from shelfmark.llm.decontaminate import decontaminated
from shelfmark.llm.neardup import near_dedup
from shelfmark.llm.packing import pack_documents
from shelfmark.llm.pii import pii_redact
from shelfmark.llm.quality import quality_filter


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base or the learned list rejects go."""
    return quality_filter(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the least doc_id stays."""
    return near_dedup(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminated(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the text is replaced by its kind."""
    return pii_redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the packed sequences."""
    return pack_documents(docs)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_duplicates),
    ("decontamination", decontamination),
    ("pii", personal_data),
    ("packing", packing),
]

#: The learned rules, the similarity search and the tokenizer can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another, each result written and read again; what a stage staged for itself is
    deleted when its result is written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        clear(spark, path)
    return STAGES[-1][1](spark, docs, sf_dir)
