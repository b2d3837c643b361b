"""Transforms of each row by a statistic of its group.

Group statistics are aggregated (map-side combined) and joined back; no window gathers a group.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from ..functions.scalars import clipped_logit
from .onerow import attach_row
from .ranking import exact_quantiles


def auto_clipped_logit(df: DataFrame, keys: list[str], value: str, out: str, eps: float = 5e-5) -> DataFrame:
    """Clipped logit; a group whose maximum exceeds 1 is read as percentages."""
    top = df.groupBy(*keys).agg(F.max(value).alias("__max"))
    p = F.when(F.col("__max") > 1, F.col(value) / 100).otherwise(F.col(value))
    return df.join(top, keys).withColumn(out, clipped_logit(p, eps)).drop("__max")


def winsorize(df: DataFrame, keys: list[str], value: str, strength: float) -> DataFrame:
    if strength <= 0:
        return df
    edges = exact_quantiles(df, keys, value, {"__lo": strength, "__hi": 1 - strength})
    clipped = F.least(F.greatest(F.col(value), F.col("__lo")), F.col("__hi"))
    return df.join(edges, keys, "left").withColumn(value, F.when(F.col(value).isNotNull(), clipped)).drop("__lo", "__hi")


def winsorize_columns(df: DataFrame, columns: list[str], strength: float, keys: list[str] | None = None) -> DataFrame:
    """Winsorize several columns of one table at their own quantiles, inside groups of ``keys`` where given."""
    if strength <= 0:
        return df
    keys = keys or []
    long = df.unpivot(keys, columns, "__trait", "__value")
    edges = exact_quantiles(long, [*keys, "__trait"], "__value", {"lo": strength, "hi": 1 - strength})
    wide = edges.groupBy(*keys).agg(
        *[F.max(F.when(F.col("__trait") == c, F.col(e))).alias(f"__{c}_{e}") for c in columns for e in ("lo", "hi")]
    )
    clip = {
        c: F.when(F.col(c).isNotNull(), F.least(F.greatest(F.col(c), F.col(f"__{c}_lo")), F.col(f"__{c}_hi"))) for c in columns
    }
    joined = df.join(wide, keys, "left") if keys else attach_row(df, wide)
    return joined.withColumns(clip).select(*df.columns)


def zscore(df: DataFrame, keys: list[str], value: str, out: str, sample: bool = False) -> DataFrame:
    """Group z-score (population SD unless ``sample``); null where the SD is 0 or undefined."""
    sd = F.stddev_samp(value) if sample else F.stddev_pop(value)
    if keys:
        stats = df.groupBy(*keys).agg(F.avg(value).alias("__m"), sd.alias("__s"))
        joined = df.join(stats, keys, "left")
    else:
        stats = df.agg(F.avg(value).alias("__m"), sd.alias("__s"))
        joined = attach_row(df, stats)
    return joined.withColumn(out, F.when(F.col("__s") > 0, (F.col(value) - F.col("__m")) / F.col("__s"))).drop("__m", "__s")


def nested_zscores(df: DataFrame, env: str, value: str, levels: list[str], prefix: str) -> DataFrame:
    """Within-environment z-score (sample SD) as one column per level, 0 in the other levels."""
    z = zscore(df, [env], value, "__z", sample=True)
    return z.withColumns({f"{prefix}_{lv}": F.when(F.col(env) == lv, F.col("__z")).otherwise(0.0) for lv in levels}).drop("__z")


def standardize_on_fit(df: DataFrame, vec: str, fit: str, out: str) -> DataFrame:
    """Scale array features by the mean and population SD of the fit rows, for all rows.

    The statistics are two arrays (one entry per dimension) attached to every row; a constant
    dimension is only centred.
    """
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    stats = df.where(F.col(fit)).agg(
        Summarizer.metrics("mean", "variance", "count").summary(array_to_vector(vec)).alias("s")
    ).select(
        vector_to_array("s.mean").alias("__m"),
        F.transform(
            vector_to_array("s.variance"),
            lambda v: F.sqrt(v * (F.col("s.count") - 1) / F.col("s.count")),
        ).alias("__s"),
    )
    joined = attach_row(df, stats)
    scaled = F.transform(
        F.arrays_zip(F.col(vec).alias("x"), F.col("__m").alias("m"), F.col("__s").alias("s")),
        lambda z: (z["x"] - z["m"]) / F.when(z["s"] > 0, z["s"]).otherwise(1.0),
    )
    return joined.withColumn(out, scaled).drop("__m", "__s")


# ---------------------------------------------------------------- grouped splits
def _group_table(df: DataFrame, group: str, limit: int) -> list:
    """Distinct groups with row counts; the split rules need them in order, so the list is bounded."""
    rows = (
        df.where(F.col(group).isNotNull()).groupBy(F.col(group).cast("string").alias("g")).agg(F.count(F.lit(1)).alias("n"))
        .orderBy("g").limit(limit + 1).collect()
    )
    if len(rows) > limit:
        raise ValueError(f"more than {limit} groups; use hashed_folds")
    return rows


def held_out_groups(df: DataFrame, group: str, frac: float, seed: int, limit: int = 1_000_000) -> list[str]:
    """Seeded group hold-out: sorted groups, numpy permutation, at least 1 and at most n - 1 held out."""
    names = np.array(sorted(r["g"] for r in _group_table(df, group, limit)))
    order = np.random.RandomState(seed).permutation(len(names))
    n = 0 if len(names) <= 1 or frac <= 0 else min(max(1, int(round(len(names) * frac))), len(names) - 1)
    return sorted(names[order[:n]].tolist())


def with_fit_flag(df: DataFrame, group: str, frac: float, seed: int, out: str = "is_fit") -> DataFrame:
    """True for fit rows; rows without a group are fit rows."""
    held = held_out_groups(df, group, frac, seed)
    side = df.sparkSession.createDataFrame([(g, False) for g in held], f"{group}_key string, __held boolean")
    joined = df.join(side, df[group].cast("string") == side[f"{group}_key"], "left")
    return joined.withColumn(out, F.col("__held").isNull()).drop("__held", f"{group}_key")


def group_kfold(df: DataFrame, group: str, k: int, out: str = "fold", limit: int = 1_000_000) -> DataFrame:
    """Group K-fold: groups by falling size, each to the fold with the fewest rows so far.

    The folds of at most ``limit`` groups are broadcast, so rows stay where they are and few groups make no large tasks.
    """
    sized = sorted(_group_table(df, group, limit), key=lambda r: (-r["n"], r["g"]))
    load, assigned = [0] * k, []
    for row in sized:
        f = min(range(k), key=lambda i: (load[i], i))
        load[f] += row["n"]
        assigned.append((row["g"], f))
    side = df.sparkSession.createDataFrame(assigned, f"__g string, {out} int")
    return df.join(F.broadcast(side), df[group].cast("string") == side["__g"]).drop("__g")


def hashed_folds(df: DataFrame, group: str, k: int, repeats: int = 1) -> DataFrame:
    """Random group folds for any number of groups: one seeded hash per repeat, as (repeat, fold) rows."""
    folds = F.explode(F.array(*[
        F.struct(F.lit(i).alias("repeat"), F.pmod(F.xxhash64(F.lit(i), F.col(group).cast("string")), F.lit(k)).cast("int").alias("fold"))
        for i in range(repeats)
    ]))
    return df.withColumn("__f", folds).select(*df.columns, "__f.repeat", "__f.fold")
