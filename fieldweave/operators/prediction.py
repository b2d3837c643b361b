"""Grouped prediction: ridge curves, random forests, importances and roll-ups."""

from __future__ import annotations

import itertools
import math
import random
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window as W, functions as F

from .crossproducts import array_matrix, gram_matrices, list_column, with_one
from .correlate import spearman_by_dimension
from .transforms import group_kfold, hashed_folds, standardize_on_fit

PENALTIES = [10 ** (-2 + i / 2) for i in range(13)]


def roll_up(crops: DataFrame, image: str, genotype: str, value: str) -> DataFrame:
    """Crop predictions to image means, then to genotype means over images."""
    images = crops.groupBy(genotype, image).agg(F.avg(value).alias(value))
    return images.groupBy(genotype).agg(F.avg(value).alias(value), F.count(F.lit(1)).alias("n_images"))


def importance_summary(folds: DataFrame, digits: int = 4) -> DataFrame:
    """(feature, mean, sd, low, high, rank) over folds; the feature table is bounded by dimensions."""
    v = lambda c: F.round(c + 1.37e-9, digits) + F.lit(0.0)
    s = folds.groupBy("feature").agg(
        v(F.avg("importance")).alias("mean"), v(F.stddev_samp("importance")).alias("sd"),
        v(F.min("importance")).alias("low"), v(F.max("importance")).alias("high"),
    )
    return s.withColumn("rank", F.row_number().over(W.orderBy(F.desc("mean"), "feature")))


# ---------------------------------------------------------------- ridge
def _ridge(g: np.ndarray, k: int, penalty: float) -> tuple[float, np.ndarray]:
    """Intercept and slopes on the first k features from the Gram matrix of [1, x, y]."""
    n = g[0, 0]
    mx, my = g[0, 1 : k + 1] / n, g[0, -1] / n
    sxx = g[1 : k + 1, 1 : k + 1] - n * np.outer(mx, mx)
    sxy = g[1 : k + 1, -1] - n * mx * my
    b = np.linalg.solve(sxx + penalty * np.eye(k), sxy)
    return float(my - b @ mx), b


def _rss(g: np.ndarray, k: int, a: float, b: np.ndarray) -> float:
    """Squared prediction error of a fit on the rows behind a Gram matrix."""
    beta = np.concatenate([[a], b])
    return float(g[-1, -1] - 2 * beta @ g[: k + 1, -1] + beta @ g[: k + 1, : k + 1] @ beta)


def leave_one_out_penalties(rows: DataFrame, vec: str, g: np.ndarray, counts: list[int], penalties: list[float]) -> dict[int, float]:
    """For every k the penalty with the least mean squared leave-one-out error of ridge on the first k features.

    ``vec`` holds [x, y] and ``g`` is the Gram matrix of [1, x, y] over all rows. The error of a row left out is
    its residual over one less its leverage, so one pass over the rows, in the eigenbasis of each k, adds up
    the errors of all counts and penalties.
    """
    n = g[0, 0]
    mean, my = g[0, 1:-1] / n, g[0, -1] / n
    sxx = g[1:-1, 1:-1] - n * np.outer(mean, mean)
    sxy = g[1:-1, -1] - n * mean * my
    bases = {k: np.linalg.eigh(sxx[:k, :k]) for k in counts}
    shared = rows.sparkSession.sparkContext.broadcast((mean, my, n, sxy, bases, np.array(penalties)))

    def fold(batches):
        mean, my, n, sxy, bases, pen = shared.value
        total = np.zeros((len(bases), len(pen)))
        for b in batches:
            if b.num_rows:
                v = array_matrix(b.column(0))
                for i, (k, (val, u)) in enumerate(bases.items()):
                    z = (v[:, :k] - mean[:k]) @ u
                    inv = 1.0 / (np.clip(val, 0, None)[:, None] + pen[None, :])
                    left = v[:, -1:] - my - z @ (inv * (u.T @ sxy[:k])[:, None])
                    total[i] += ((left / np.maximum(1.0 - 1.0 / n - (z * z) @ inv, 1e-12)) ** 2).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), list_column(total)], names=["i", "row"])

    part = rows.select(vec).mapInArrow(fold, "i int, row array<double>")
    summed = part.groupBy("i").agg(Summarizer.sum(array_to_vector("row")).alias("s")).select("i", vector_to_array("s").alias("row")).collect()
    by_place = {r["i"]: r["row"] for r in summed}  # one row a count of features
    return {k: penalties[int(np.argmin(by_place[i]))] for i, k in enumerate(counts)}


def ridge_curve(
    df: DataFrame, vec: str, target: str, group: str, counts: list[int], repeats: int = 8, folds: int = 5,
    penalties: list[float] | None = None,
) -> DataFrame:
    """(k, penalty, mean_r2, sd_r2): out-of-fold R2 of ridge on the k features best rank-correlated with the target.

    The penalty of each k is chosen once, by leave-one-out on all rows, and not by the score that is
    reported. One pass sums the cross products per (repeat, fold); training sets are totals minus a fold and
    held-out errors come from the fold's own cross products, so no further pass over rows is made.
    """
    penalties = penalties or PENALTIES
    ranked = spearman_by_dimension(df.withColumn("__all", F.lit(0)), ["__all"], vec, target)
    order = [r["dim"] for r in ranked.orderBy(F.abs("r").desc_nulls_last(), "dim").select("dim").collect()]
    picked = F.array(*[F.col(vec)[int(d)].cast("double") for d in order[: max(counts)]])
    known = df.where(F.col(target).isNotNull())
    whole = F.concat(picked, F.array(F.col(target).cast("double"))).alias("v")
    rows = hashed_folds(known, group, folds, repeats).select(F.concat_ws("/", "repeat", "fold").alias("part"), whole)
    grams = gram_matrices(rows, "v", by="part", prepare=with_one, hold=max(64, repeats * folds))
    every = sum(g for name, g in grams.items() if name.startswith("0/"))
    chosen = leave_one_out_penalties(known.select(whole), "v", every, list(counts), penalties)
    out = []
    for k in counts:
        scores = []
        for rep in range(repeats):
            parts = [g for name, g in grams.items() if name.startswith(f"{rep}/")]
            total = sum(parts)
            tested = [g for g in parts if g[0, 0] >= 2]
            rss = sum(_rss(g, k, *_ridge(total - g, k, chosen[k])) for g in tested)
            n, sy, syy = (sum(g[i, j] for g in tested) for i, j in ((0, 0), (0, -1), (-1, -1)))
            scores.append(1.0 - rss / (syy - sy * sy / n))
        out.append((int(k), chosen[k], float(np.mean(scores)), float(np.std(scores))))
    return df.sparkSession.createDataFrame(out, "k int, penalty double, mean_r2 double, sd_r2 double")


# ---------------------------------------------------------------- forest
#: The grid that the search draws from, as far as Spark's forest has the setting. Depths above
#: its limit of 30, and the least rows to split a node, have none here.
FOREST_GRID = {
    "numTrees": list(range(100, 1001, 100)),
    "featureSubsetStrategy": [*map(str, range(1, 11)), "sqrt"],
    "maxDepth": [10, 19, 28, 30],
    "minInstancesPerNode": [10, 15, 20],
    "bootstrap": [True, False],
}
ROWS_PER_PART, FITS_AT_ONCE = 1 << 15, 4


def few_parts(df: DataFrame, rows: int) -> DataFrame:
    """Rows in as few partitions as hold ``ROWS_PER_PART`` each, at most one a core.

    Every level of a forest sends, from each partition, the statistics of all its nodes, and nodes grow with the
    rows: what is sent grows with partitions times rows, and partitions that a shuffle made are too many.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.coalesce(max(1, min(cores, math.ceil(rows / ROWS_PER_PART))))


def forest_cross_validation(
    df: DataFrame, vec: str, target: str, group: str, outer: int = 5, inner: int = 3, tries: int = 10, seed: int = 0,
    grid: dict[str, list] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Nested grouped cross-validation of a random forest: (predictions, importances per fold).

    Outer and inner folds keep groups whole. Features are scaled on the training rows only. Every outer fold
    draws ``tries`` settings from the grid and keeps the one with the least inner error.
    """
    spark = df.sparkSession
    grid = grid or FOREST_GRID
    combinations = [dict(zip(grid, c)) for c in itertools.product(*grid.values())]
    known = df.where(F.col(target).isNotNull()).persist(StorageLevel.MEMORY_AND_DISK)
    folded = group_kfold(known, group, outer).persist(StorageLevel.MEMORY_AND_DISK)
    sizes = {r["fold"]: r["count"] for r in folded.groupBy("fold").count().collect()}  # one row a fold
    known.unpersist()
    predictions, importances = None, []

    def model(params: dict) -> RandomForestRegressor:
        return RandomForestRegressor(featuresCol="__v", labelCol=target, predictionCol="prediction", seed=seed, **params)

    score = RegressionEvaluator(labelCol=target, predictionCol="prediction", metricName="mse")
    for f in range(outer):
        choices = random.Random(seed + f).sample(combinations, min(tries, len(combinations)))
        rows = sum(n for fold, n in sizes.items() if fold != f)
        flagged = folded.withColumn("__fit", F.col("fold") != f)
        scaled = standardize_on_fit(flagged, vec, "__fit", "__z").withColumn("__v", array_to_vector("__z")).drop("__z")
        train = few_parts(scaled.where("__fit"), rows).persist(StorageLevel.MEMORY_AND_DISK)
        best = choices[0]
        if len(choices) > 1:
            parts = few_parts(group_kfold(train.drop("fold"), group, inner, "__inner"), rows).persist(StorageLevel.MEMORY_AND_DISK)

            def error(job: tuple[dict, int]) -> float:
                params, i = job
                return score.evaluate(model(params).fit(parts.where(F.col("__inner") != i)).transform(parts.where(F.col("__inner") == i)))

            with ThreadPool(FITS_AT_ONCE) as pool:
                mse = pool.map(inheritable_thread_target(spark)(error), list(itertools.product(choices, range(inner))), 1)
            best = choices[int(np.argmin(np.reshape(mse, (-1, inner)).mean(1)))]
            parts.unpersist()
        fitted = model(best).fit(train)
        out = fitted.transform(scaled.where("NOT __fit")).drop("__v", "__fit")
        predictions = out if predictions is None else predictions.unionByName(out)
        imp = fitted.featureImportances.toArray()
        importances.append(pd.DataFrame({"fold": f, "feature": np.arange(len(imp)), "importance": imp}))
        train.unpersist()
    return predictions, spark.createDataFrame(pd.concat(importances))
