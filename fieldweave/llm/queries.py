"""Queries of this subpackage, each a thin digest of its operator, and their SQL where SQL can state them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fieldweave.llm import alignment, chat, lines, mincut, packing, pieces, pivots, probminhash, resampling, suffixes, toxicity, warc, winnowing

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _register(name: str, table: str, fn: Callable[[DataFrame], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = lambda spark, folder: fn(_table(spark, folder, table))
    if sql is not None:
        SQL[name] = sql


QUERIES["op1_toxicity"] = lambda spark, folder: toxicity.toxicity_report(_table(spark, folder, "documents"), _table(spark, folder, "labels"))
_register("op2_pieces", "documents", pieces.pieces_report)
_register("op3_warc", "pages", warc.archive_report, warc.SQL)
_register("op4_vector_near_dedup", "embeddings", pivots.near_vectors)
_register("op5_near_dedup", "documents", probminhash.near_duplicates)
_register("op6_fingerprints", "documents", winnowing.neighbour_likeness)
_register("op7_substring_dedup", "documents", suffixes.substring_report)
_register("op8_packing", "documents", packing.packing_report)
_register("op9_main_text", "pages", mincut.extraction_report)
_register("op10_line_dedup", "documents", lines.line_report, lines.SQL)
QUERIES["op11_importance_resampling"] = lambda spark, folder: resampling.resampling_report(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))
SQL["op11_importance_resampling"] = resampling.SQL
_register("op12_chat_format", "conversations", chat.chat_report, chat.SQL)
_register("op13_token_alignment", "documents", alignment.alignment_report)
