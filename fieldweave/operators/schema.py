"""Column selection and schema rules."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, functions as F

# Columns every component-score table carries.
PROVENANCE = ["fit_split_column", "fit_test_frac", "fit_split_role", "n_fit_rows", "ica_sign_source"]
COMPONENT = re.compile(r"^(PC|IC)\d+$")


def matching_columns(df: DataFrame, pattern: str) -> list[str]:
    found = [c for c in df.columns if re.match(pattern, c)]
    if not found:
        raise ValueError(f"no column matches {pattern!r}")
    return found


def split_columns(df: DataFrame, pattern: str) -> tuple[list[str], list[str]]:
    """(metadata columns, feature columns), both in table order."""
    feats = [c for c in df.columns if re.match(pattern, c)]
    return [c for c in df.columns if c not in set(feats)], feats


def named_traits(df: DataFrame, wanted: list[str]) -> list[str]:
    """The wanted columns without repeats, first mention first; absent names are an error."""
    names = list(dict.fromkeys(wanted))
    absent = [n for n in names if n not in df.columns]
    if absent:
        raise ValueError(f"traits not in table: {absent}")
    return names


def same_features(base: DataFrame, other: DataFrame, pattern: str) -> bool:
    return split_columns(base, pattern)[1] == split_columns(other, pattern)[1]


def assert_provenance(df: DataFrame) -> None:
    """Component-score tables must say, in one constant value, how their fit rows were split."""
    if not any(COMPONENT.match(c) for c in df.columns):
        return
    absent = [c for c in PROVENANCE if c not in df.columns]
    if absent:
        raise ValueError(f"fit-split provenance columns missing: {absent}")
    row = df.agg(
        F.count_distinct("fit_split_column").alias("n"), F.max(F.col("fit_split_column").cast("string")).alias("v")
    ).first()
    if row["n"] != 1 or row["v"] == "":
        raise ValueError("fit-split provenance needs one non-empty fit_split_column value")


def rolled_up_provenance(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Per key: the single value of each column, or 'mixed'."""
    one = lambda c: F.when(F.count_distinct(c) == 1, F.max(F.col(c).cast("string"))).otherwise("mixed")
    return df.groupBy(*keys).agg(*[one(c).alias(c) for c in columns])


def varying_factors(df: DataFrame, columns: list[str]) -> DataFrame:
    """(factor, n_levels) of the factors with more than one level, from one aggregation."""
    counts = df.agg(*[F.count_distinct(F.col(c).cast("string")).alias(c) for c in columns])
    return counts.unpivot([], columns, "factor", "n_levels").where(F.col("n_levels") > 1)
