"""Attach a one-row aggregate to every row, as an uncorrelated scalar subquery."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def attach_row(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """All columns of an ungrouped aggregate on every row of ``df``; no join is planned."""
    packed = one_row.select(F.struct(*one_row.columns).alias("r")).scalar()
    return df.withColumn("__row", packed).select(*df.columns, *[F.col("__row")[c].alias(c) for c in one_row.columns])
