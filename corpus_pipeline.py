"""Corpus pipeline: stages that each hand the documents they keep to the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fieldweave.llm.common import stored
from fieldweave.llm.lines import drop_repeated_lines
from fieldweave.llm.packing import packing_report
from fieldweave.llm.probminhash import drop_near_duplicates
from fieldweave.llm.suffixes import drop_repeated_substrings
from fieldweave.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the field does not reject; learned from the labelled rows that are not held out."""
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that three or more share except in the largest doc_id that holds them.

    Null texts count as empty and come back empty; rows that repeat a doc_id are one document, each comes back.
    """
    return drop_repeated_lines(docs).select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class, the least doc_id; of texts without words (null, empty) one stays.

    Rows without a doc_id stay; rows that repeat the id that stays all stay.
    """
    return drop_near_duplicates(docs).select(docs.columns)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without bytes covered by a 200-byte string that also starts elsewhere; null texts come back empty."""
    return drop_repeated_substrings(docs).select(docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of every document's tokens, with its place in a sequence of at most 1,024; null texts are one end id."""
    return packing_report(docs)


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("packing", packing)]
ORACLE_SQL = None  # a learned classifier and sketches take part


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
