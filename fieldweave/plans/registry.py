"""Registry of named queries, each with the SQL that states the same result where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

SHIFT = 1.37e-9
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


class Tables:
    """Lazy access to the parquet tables of one folder: ``t.lineitem``."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def add(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def r(col: Column | str, digits: int = 4) -> Column:
    """Rounded double without negative zero, for value comparison.

    The small shift keeps exact halves away from the rounding edge, where the order of a
    floating-point sum would decide.
    """
    c = F.col(col) if isinstance(col, str) else col
    return F.round(c.cast("double") + F.lit(SHIFT), digits) + F.lit(0.0)


def q(expr: str, digits: int = 4) -> str:
    """The same rounding in SQL."""
    return f"(round(({expr})::DOUBLE + {SHIFT}::DOUBLE, {digits}) + 0.0::DOUBLE)"
